"""Rendezvous sharding: every record goes where its own draw for that shard is best.

For each shard a record has a draw from a hash of (key, shard), scaled by the shard's weight;
the best draw wins. A record's draws for the old shards do not change when a shard is added, so
records move only into the new one. Nothing is shuffled to find the shard.

Slots (0, 1, ... within a shard) need an order of each shard's records without one task per
shard: records are dealt into blocks by range of a hash, counted per (shard, block), and numbered within
their block from the sum of the blocks before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propwell.llm.registry import UNIFORM_SQL, cut_lineage, query, table, uniform

ROWS_PER_BLOCK = 20_000


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. Weights are positive; a shard's share follows its weight.

    A draw u becomes -ln(1-u)/weight, exponential with the weight as rate, and the smallest
    wins. Equal draws go to the lower shard. A null key is a key like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    draws = [
        F.struct(
            (-F.log(F.lit(1.0) - uniform(key, F.lit(shard))) / F.lit(float(weight))).alias("draw"),
            F.lit(shard).alias("shard"),
        )
        for shard, weight in enumerate(weights)
    ]
    return F.array_min(F.array(*draws))["shard"]


def shard_slots(rows: DataFrame, shard: str, draw: str, order: Sequence[str], n_rows: int) -> DataFrame:
    """`rows` with `slot`: 0, 1, ... within each value of `shard`, without gaps, in order of
    `draw` (even in [0, 1)), then `order`.

    Rows equal in all of these are alike, and get slots of their own in some order. An empty
    table gives an empty result.
    """
    blocks = max(64, -(-n_rows // ROWS_PER_BLOCK))
    dealt = rows.withColumn("_block", F.floor(F.col(draw) * blocks).cast("int"))
    counts = dealt.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        shard, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(shard, "_block").orderBy(draw, *order)
    numbered = dealt.withColumn("_at", F.row_number().over(inside) - 1)
    return (
        numbered.join(starts, [shard, "_block"])
        .withColumn("slot", F.col("_start") + F.col("_at"))
        .drop("_block", "_start", "_at")
    )


def shard_records(rows: DataFrame, key: str, weights: Sequence[float], passed: Sequence[str]) -> DataFrame:
    """Columns `passed` of `rows` with shard and slot; slots are in order of a hash of `passed`."""
    names = [f"in_{i}" for i in range(len(passed))]
    own = [F.col(f"`{c}`") for c in passed]
    placed = cut_lineage(
        rows.select(
            *[c.alias(n) for c, n in zip(own, names, strict=True)],
            rendezvous_shard(F.col(f"`{key}`"), weights).alias("shard"),
            uniform(F.lit("slot"), *own).alias("draw"),
        )
    )
    slotted = shard_slots(placed, "shard", "draw", names, placed.count())
    return slotted.select(*[F.col(n).alias(c) for n, c in zip(names, passed, strict=True)], "shard", "slot")


SHARDS = 8


def document_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more), text_crc32; null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    placed = shard_records(
        document_sizes(documents), "doc_id", [1.0] * shards, ["doc_id", "size", "text_crc32"]
    )
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        rendezvous_shard(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"),
    )


_DRAW = "-ln(1.0::DOUBLE - " + UNIFORM_SQL.format("coalesce(doc_id::VARCHAR, '') || ':' || s") + ")"


@query(
    # The CRC-32 table follows from its polynomial.
    f"""
    WITH crc AS (
        SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_concat([i::BIGINT], range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
            FROM range(256) r(i))
    ),
    d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (
        SELECT doc_id, (length(h) // 2 + 1)::BIGINT AS size,
               xor(list_reduce(list_concat([4294967295], list_transform(
                       range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
        FROM d, crc
    ),
    w AS (
        SELECT *, (SELECT arg_min(s, ({_DRAW}, s)) FROM range(8) r(s))::INTEGER AS shard,
               (SELECT arg_min(s, ({_DRAW}, s)) FROM range(9) r(s))::INTEGER AS grown_shard,
               {UNIFORM_SQL.format("'slot:' || coalesce(doc_id::VARCHAR, '') || ':' || size || ':' || text_crc32")} AS draw
        FROM p
    )
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
           row_number() OVER (PARTITION BY shard ORDER BY draw, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
    FROM w
    """
)
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
