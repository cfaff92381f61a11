"""Exact duplicates by content hash, with a comparison of the bytes themselves.

`exact_groups` groups equal keys of a text by a 128-bit hash. Every group's texts are then told
apart by their bytes: the aggregation that finds the row to keep has the hash *and* the bytes
as its key, so a collision makes two classes. Equal texts meet in the map tasks first; a text
that a third of all rows share crosses the shuffle once per task.

The way back to the rows carries no text: it goes by the hash and a second digest, and only
texts that occur more than once take part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.llm.registry import query, table
from propwell.operators.joins import join_per_key

#: Larger than twice any id.
_STEP = "100000000000000000000"


def without_white_space(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def exact_groups(
    rows: DataFrame,
    id_column: str,
    content: Column,
    rank: Column | None = None,
    digest: Callable[[Column], Column] | None = None,
    passed: Sequence[str] | None = None,
) -> DataFrame:
    """`rows` (their columns `passed`, all by default) with keep_id, group_size, kept and content_sha256.

    Rows are equal when `content` has equal bytes (null counts as empty). Of equal rows the one
    with the largest `rank` (a whole number, at most 10 digits) stays, then the smallest id; a
    row without an id stays only where no row has one (keep_id is then null). Where an id is
    repeated with equal content, each such row counts, and the row is `kept` on each. `digest`
    replaces the 128-bit hash, which tests use to force collisions. Other columns pass through;
    an empty table gives an empty result.
    """
    own = rows.columns if passed is None else list(passed)
    full = F.coalesce(content, F.lit(""))
    named = rows.select(
        *[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(own)],
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        full.alias("bytes"),
        (F.lit(0) if rank is None else rank).cast("bigint").alias("rank"),
    )
    hashed = F.md5(F.col("bytes")) if digest is None else digest(F.col("bytes"))
    step = F.lit(_STEP).cast("decimal(38,0)")
    # rank and id in one number, so that the aggregation keeps a fixed-width buffer per text
    order = (F.col("rank").cast("decimal(18,0)") * step - F.col("id").cast("decimal(20,0)")).cast("decimal(38,0)")
    classes = (
        named.select(hashed.alias("hash"), "bytes", order.alias("order"))
        .groupBy("hash", "bytes")
        .agg(F.max("order").alias("best"), F.count(F.lit(1)).alias("group_size"))
    )
    best_rank = F.round(F.col("best") / step).cast("decimal(18,0)")
    copies = classes.filter("group_size > 1").select(
        "hash",
        F.sha2("bytes", 256).alias("sha"),
        (best_rank * step - F.col("best")).cast("bigint").alias("keep"),
        "group_size",
    )
    members = named.select(
        *[f"in_{i}" for i in range(len(own))],
        "id",
        hashed.alias("hash"),
        F.sha2("bytes", 256).alias("sha"),
    )
    # Classes of one hash have different bytes; the way back tells them apart by a second digest.
    joined = join_per_key(members, copies, ["hash", "sha"], spread_by="id", how="left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return joined.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(own)],
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("content_sha256"),
    )


@query(
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
        FROM documents
    ),
    g AS (
        SELECT body, count(*) AS group_size,
               arg_max(doc_id, points::HUGEINT * 100000000000000000000 - doc_id) AS keep_id
        FROM d GROUP BY body
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM d JOIN g USING (body)
    """
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    groups = exact_groups(
        documents,
        "doc_id",
        without_white_space(F.col("text")),
        rank=F.length(F.coalesce("text", F.lit(""))),
        passed=["doc_id"],
    )
    return groups.withColumnRenamed("content_sha256", "text_sha256")
