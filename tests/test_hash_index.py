"""The index of stored hashes: exact answers, few files read."""

import pytest
from pyspark.sql import functions as F

from propwell.operators import hash_index
from propwell.operators.hash_index import HashIndex
from propwell.operators.ingest import ingest_dedup


def hashes(spark, start, end):
    return spark.range(start, end).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    hashes(spark, 0, 40_000).write.parquet(path)
    return path


def test_few_files_are_read(spark, store, tmp_path):
    """The store's hashes lie in 40 files; a batch of 3 known and 500 new ones reads a few of them."""
    index = HashIndex(spark, str(tmp_path / "index"), rows_per_file=1_000)
    index.refresh(spark.read.parquet(store))
    assert len(index.files()) == 40
    batch = hashes(spark, 39_997, 40_500).withColumn("doc", F.monotonically_increasing_id())
    known = index.matching(batch)
    assert 1 <= len(known.inputFiles()) <= 10
    fresh = ingest_dedup(batch, known, ["doc"])
    assert {r.content_hash for r in fresh.collect()} == {r.content_hash for r in hashes(spark, 40_000, 40_500).collect()}
    assert index.matching(hashes(spark, 0, 40_000)).distinct().count() == 40_000


def test_no_stored_hash_is_missed_over_appends_and_merges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_index, "MOST_GENERATIONS", 2)
    path, index = str(tmp_path / "store"), HashIndex(spark, str(tmp_path / "index"), rows_per_file=500)
    assert index.matching(hashes(spark, 0, 10)).count() == 0
    for i in range(4):
        # names that a path must escape
        rows = hashes(spark, 700 * i, 700 * i + 700).withColumn("source_name", F.lit("a b:c%d/[e]"))
        rows.write.mode("append").partitionBy("source_name").parquet(path)
        assert index.refresh(spark.read.parquet(path)) > 0
        assert index.refresh(spark.read.parquet(path)) == 0
        assert sum(g.n for g in index._active()) == 700 * (i + 1)  # files of earlier rounds are not read again
        asked = hashes(spark, 0, 5_000)
        assert asked.join(index.matching(asked), "content_hash", "left_anti").count() == 5_000 - 700 * (i + 1)
    assert len(index._active()) <= 2


def test_nulls_repeats_and_an_empty_store(spark, tmp_path):
    index = HashIndex(spark, str(tmp_path / "index"))
    path = str(tmp_path / "store")
    spark.createDataFrame([("x",), ("",), ("x",)], "content_hash STRING").write.parquet(path)
    index.refresh(spark.read.parquet(path))
    batch = spark.createDataFrame([(None,), ("x",), ("x",), ("",), ("y",)], "content_hash STRING")
    known = {r.content_hash for r in index.matching(batch).collect()}
    assert {"x", ""} <= known and None not in known
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "content_hash STRING").write.parquet(empty)
    other = HashIndex(spark, str(tmp_path / "other"))
    other.refresh(spark.read.parquet(empty))
    assert other.matching(batch).count() == 0
