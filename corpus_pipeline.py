"""The corpus pipeline: quality, near duplicates, benchmark leaks, mix, shards.

`STAGES` are applied in order; each gets what the one before kept, written and read again.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.llm import decontamination, mixing, near_dedup, quality, sharding
from propwell.llm.registry import table
from propwell.session import scratch_path



def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers accept; rows are judged one by one."""
    names = docs.columns
    scored = quality.score_quality(docs, quality.quality_model(spark, docs, sf_dir), names)
    return scored.where(F.col("score") >= quality.ACCEPTED).select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(names)]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest id; unlike texts under one id
    are documents of their own. Documents without words stay, one per id."""
    return near_dedup.first_of_classes(docs, "doc_id", "text")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; rows that share an id share the verdict."""
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontamination.leaks(docs, "doc_id", "text", items, "item_id", "text")
    leaks = found.select(F.col("doc_id").alias("leak")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak"]), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as whole epochs of its source have it, and once more where the
    fraction takes it; that at the cut if the fraction takes half of it or more. No text is cut.

    The quality classifier's score weighs documents."""
    names = docs.columns
    weight = next(n for n in (f"quality_{i}" for i in range(len(names) + 1)) if n not in names)
    model = quality.quality_model(spark, table(spark, sf_dir, "documents"), sf_dir)
    scored = quality.score_quality(docs, model, names)
    weighed = scored.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)], F.col("score").alias(weight))
    mixed = mixing.mix_documents(weighed, weight)
    repeats = F.col("epochs") + F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("size")), 1).otherwise(0)
    copies = mixed.where(repeats > 0).select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), repeats)))
    return copies.select(*[F.col("row")[c].alias(c) for c in names])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The quality stage is a fitted classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
