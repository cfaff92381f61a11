"""Mixing sources to target weights by exponential keys.

Every record draws an exponential key with its quality as rate; in ascending key order a source
is a weighted sample without replacement, of any length (Efraimidis and Spirakis). A source's
target is met by whole epochs first, then by the records that come first in that order, until
their running size reaches what is left; the record at the cut gives its first words only.

What a record gives depends on its key and on one row per source: epochs and the key at the cut.
To find the cut without sorting a source in one task, keys fall into blocks that keep their
order. Sums per block show in which block the cut lies, and only that block is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propwell.llm.registry import UNIFORM_SQL, cut_lineage, files, query, table, uniform
from propwell.operators.joins import join_per_key

WORDS = r"[^\x20\x09-\x0D]+"
ROWS_PER_BLOCK = 20_000
#: Rows of a table with one row per source that may be broadcast; more are joined by shuffle.
MOST_BROADCAST = 10_000
LEAST_WEIGHT = 0.05


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def prose_quality(text: Column, words: Column) -> Column:
    """A weight in [0.05, 1]: 1 where the mean word has 6 characters, less the farther from it."""
    mean = F.coalesce(F.length(text), F.lit(0)).cast("double") / (words + 1).cast("double")
    return F.greatest(F.lit(LEAST_WEIGHT), F.lit(1.0) / (F.lit(1.0) + F.abs(mean - 6.0) / 6.0))


def exponential_key(record: Column, quality: Column, seed: str) -> Column:
    return -F.log(F.lit(1.0) - uniform(F.lit(seed), record)) / quality


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size -> also weight and target.

    Sources in code point order, null last, take the weights in turn. Targets are
    min(most * size, level * weight), with the one level at which they sum to `share` of all
    sizes: what a full source cannot take goes to the others by weight. share <= most.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    leveled = sizes.withColumn("weight", weight).withColumn("level", level)
    # levels of sources that are not full are all the same, and those of full ones are larger than they can take
    open_ = F.when(F.col("level") <= full / F.col("weight"), F.col("level"))
    first = F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return leveled.withColumn("first", first).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("first").isNull(), full)
        .otherwise(F.least(full, F.col("first") * F.col("weight")))
        .alias("target"),
    )


def source_cuts(
    records: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """One row per source: source_size, target, epochs, and where the fraction ends.

    `records` has source, id, size, key. Rows alike in all four are one unit of the order: at
    the cut each gives the same number of words (`cut_words`). A source whose target leaves no
    fraction has a null `cut_key`. An empty table has no sources.
    """
    units = cut_lineage(
        records.groupBy("source", "id", "size", "key").agg(F.count(F.lit(1)).alias("alike"))
    )
    n = units.count()
    blocks = max(64, -(-n // ROWS_PER_BLOCK))
    # rises with the key, and spreads keys of any rate: a block has at most some ten times its share
    block = F.least(F.floor(F.col("key") / (F.col("key") + 1.0) * blocks), F.lit(blocks - 1)).cast("bigint")
    words = (F.col("size") * F.col("alike")).alias("words")
    sums = units.groupBy("source", block.alias("block")).agg(F.sum(words).alias("words"))
    sums = cut_lineage(sums, files(n))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    whole = F.floor(F.col("target")).cast("bigint")
    targets = cut_lineage(
        targets.withColumn(
            "epochs", F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(0)
        ).withColumn("left", whole - F.col("epochs") * F.col("source_size"))
    )
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    at_cut = starts.join(targets, same(starts, targets)).where("start < left AND left <= start + words").select(
        starts["source"], "block", "start", "left"
    )
    blocked = units.withColumn("block", block)
    inside = blocked.join(at_cut, same(blocked, at_cut) & (blocked["block"] == at_cut["block"])).select(
        blocked["source"], "key", "id", "size", "alike", "start", "left"
    )
    order = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first(), "size")
    until = F.col("start") + F.coalesce(
        F.sum(F.col("size") * F.col("alike")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    cuts = (
        inside.withColumn("until", until)
        .where("until < left AND left <= until + size * alike")
        .select(
            "source",
            F.col("key").alias("cut_key"),
            F.col("id").alias("cut_id"),
            F.col("size").alias("cut_size"),
            F.expr("(left - until) div alike").alias("cut_words"),
        )
    )
    return cut_lineage(
        targets.join(cuts, same(targets, cuts), "left").select(
            targets["source"], "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_words"
        ),
        files(n),
    )


def with_cuts(records: DataFrame, cuts: DataFrame) -> DataFrame:
    """`records` (source, id, size, key, ...) with source_size, target, epochs, and `part`: the
    words given beyond whole epochs."""
    keyed = lambda f: f.withColumn("_null", F.col("source").isNull()).withColumn(
        "_source", F.coalesce("source", F.lit(""))
    )
    rows, per_source = keyed(records), keyed(cuts).drop("source")
    if cuts.count() <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(per_source), ["_null", "_source"])
    else:
        joined = join_per_key(rows, per_source, ["_null", "_source"], spread_by="key", how="inner")
    here = F.struct("key", "id", "size")
    cut = F.struct(F.col("cut_key").alias("key"), F.col("cut_id").alias("id"), F.col("cut_size").alias("size"))
    part = (
        F.when(F.col("cut_key").isNull(), 0)
        .when(here == cut, F.col("cut_words"))
        .when(here < cut, F.col("size"))
        .otherwise(0)
    )
    return joined.withColumn("part", part.cast("bigint")).drop(
        "_null", "_source", "cut_key", "cut_id", "cut_size", "cut_words"
    )


SEED = "mix"


def document_records(documents: DataFrame, quality: str | None = None) -> DataFrame:
    """row (all columns of `documents`), source, id (doc_id), size (words) and key.

    `quality` names a column of weights above 0; without it, prose weighs most.
    """
    text = F.col("row")["text"]
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    sized = packed.select("row", F.col("row")["source"].alias("source"), F.col("row")["doc_id"].alias("id"), word_count(text).alias("size"))
    weight = prose_quality(text, F.col("size")) if quality is None else F.greatest(F.lit(LEAST_WEIGHT), F.col("row")[quality])
    return sized.withColumn("key", exponential_key(F.col("id"), weight, SEED))


def mix_documents(documents: DataFrame, quality: str | None = None) -> DataFrame:
    """row (all columns of `documents`, which has doc_id, text and source), id, size,
    source_size, target, epochs and part.

    Null texts have no words. Null sources are one source, the last. Repeated rows draw the
    same key and are treated alike. `quality` is as in `document_records`. Reruns agree, however rows are partitioned.
    """
    records = document_records(documents, quality)
    return with_cuts(records, source_cuts(records.select("source", "id", "size", "key"))).drop("key", "source")


@query(
    f"""
    WITH d AS (
        SELECT doc_id, source,
               coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
               coalesce(length(text), 0)::DOUBLE AS n_points
        FROM documents
    ),
    k AS (
        SELECT *, -ln(1.0::DOUBLE - {UNIFORM_SQL.format("'mix:' || coalesce(doc_id::VARCHAR, '')")})
            / greatest(0.05::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE
                + abs(n_points / (size + 1)::DOUBLE - 6.0::DOUBLE) / 6.0::DOUBLE)) AS key
        FROM d
    ),
    s AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
        FROM k GROUP BY source
    ),
    l AS (
        SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
                   - coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM s WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST)
    ),
    x AS (SELECT (SELECT level FROM l WHERE level <= source_size * 2.0::DOUBLE / weight
                  ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST LIMIT 1) AS level),
    t AS (
        SELECT s.source, s.source_size,
               CASE WHEN x.level IS NULL THEN s.source_size * 2.0::DOUBLE
                    ELSE least(s.source_size * 2.0::DOUBLE, x.level * s.weight) END AS target
        FROM s, x
    ),
    r AS (
        SELECT k.doc_id, k.size, t.source_size, t.target,
               CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
               coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
           (epochs * size
            + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
    FROM r
    """
)
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
    )
