"""Ingest properties: repeat, order of columns, batch against stream, replay."""

import hashlib
import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propwell.functions.canonical import canonical_json, content_hash, listing_key_hash
from propwell.operators import dedup, ingest
from propwell.queries.base import table
from propwell.queries.views import document_items
from propwell.streaming.incremental import existing_rows, incremental_ingest, store_batch

SF_DIR = "/root/testdata/sf0.001"


def test_second_run_inserts_nothing(spark):
    batch = document_items(spark, SF_DIR)
    first = ingest.ingest_dedup(batch, None, ["position"])
    again = ingest.ingest_dedup(batch, first, ["position"])
    assert again.count() == 0
    counts = ingest.ingest_counts(batch, again, ["unit"]).agg(F.sum("inserted"), F.sum("skipped")).head()
    assert tuple(counts) == (0, batch.count())


def test_missing_hash_is_one_row(spark):
    rows = [("u", None, 1, i, "{}", None, None) for i in range(4)]
    batch = spark.createDataFrame(
        rows,
        "unit STRING, request_id STRING, page BIGINT, position BIGINT, payload_json STRING, "
        "content_hash STRING, listing_id STRING",
    )
    fresh = ingest.ingest_dedup(batch, None)
    assert [(r.content_hash, r.position) for r in fresh.collect()] == [("", 0)]


texts = st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\x7f"), max_size=30)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(texts, st.integers(-(2**62), 2**62), st.none() | texts), min_size=1, max_size=20))
def test_hash_is_that_of_sorted_json(spark, rows):
    rows = [tuple(x if not isinstance(x, str) else "".join(c for c in x if c >= " ") for x in r) for r in rows]
    frame = spark.createDataFrame(rows, "b STRING, a BIGINT, c STRING")
    digest = content_hash(canonical_json(frame)).alias("h")
    permuted = frame.select("c", "a", "b")
    expected = sorted(
        hashlib.sha256(
            json.dumps({"a": a, "b": b, "c": c}, sort_keys=True, ensure_ascii=False).encode()
        ).hexdigest()
        for b, a, c in rows
    )
    assert sorted(r.h for r in frame.select(digest).collect()) == expected
    other = content_hash(canonical_json(permuted)).alias("h")
    assert sorted(r.h for r in permuted.select(other).collect()) == expected


def test_nested_canonical_json(spark):
    frame = spark.sql(
        "SELECT named_struct('z', 1, 'y', array('a', NULL)) AS s, map('k', 2) AS m, "
        "CAST(NULL AS STRUCT<q: INT>) AS n, TIMESTAMP_NTZ '2024-01-05 10:00:00' AS t, true AS b, 3.5D AS d"
    )
    assert frame.select(canonical_json(frame).alias("j")).head().j == (
        '{"b": true, "d": 3.5, "m": {"k": 2}, "n": null, "s": {"y": ["a", null], "z": 1}, '
        '"t": "2024-01-05 10:00:00"}'
    )


def test_listing_hash_looks_at_three_fields(spark):
    frame = spark.createDataFrame(
        [("1", 5, "x", "a.jpg"), ("1", 5, "x", "b.jpg"), ("1", 6, "x", "a.jpg")],
        "listing_id STRING, price BIGINT, address STRING, image STRING",
    )
    same, also, new = [r.h for r in frame.select(listing_key_hash(frame).alias("h")).collect()]
    assert same == also != new
    text = json.dumps({"address": "x", "listing_id": "1", "price": 5})
    assert same == hashlib.sha256(text.encode()).hexdigest()


def test_first_seen_listing_keeps_rows_without_id(spark):
    rows = [("c", "a", 0), ("c", "a", 1), ("c", None, 2), ("c", None, 3), ("c", "", 4), ("d", "a", 5)]
    frame = spark.createDataFrame(rows, "city STRING, id STRING, position INT")
    fresh = dedup.first_seen_listing(frame, ["city"], "id", ["position"])
    assert sorted(r.position for r in fresh.collect()) == [0, 2, 3, 4, 5]


def hashed(batch):
    return batch.select("doc_id", content_hash(canonical_json(batch, ["lang", "text"])).alias("content_hash"))


@pytest.fixture
def landed(spark, tmp_path):
    """Documents landed as several files."""
    path = str(tmp_path / "landed")
    table(spark, SF_DIR, "documents").repartition(5).write.parquet(path)
    return path


def appender(path):
    return lambda fresh: fresh.write.mode("append").parquet(path)


def test_stream_equals_batch_and_resumes(spark, landed, tmp_path):
    documents = table(spark, SF_DIR, "documents")
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    store, sizes = str(tmp_path / "store"), []

    def run(checkpoint):
        incremental_ingest(
            stream, lambda: existing_rows(spark, store), appender(store), str(tmp_path / checkpoint),
            ["doc_id"], hashed, lambda rows: sizes.append(rows.count()),
        ).awaitTermination()
        return spark.read.parquet(store)

    stored = run("one")
    expected = {r.content_hash for r in hashed(documents).collect()}
    assert {r.content_hash for r in stored.collect()} == expected
    assert stored.count() == len(expected)
    assert len(sizes) == 3 and sum(sizes) == documents.count()
    assert run("one").count() == len(expected) and len(sizes) == 3
    assert run("other").count() == len(expected) and len(sizes) == 6


def test_batch_run_again_adds_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    batch = hashed(table(spark, SF_DIR, "documents"))
    half = batch.filter("doc_id < 60")  # what a first attempt got stored
    for rows in (half, batch, batch):
        store_batch(rows, lambda: existing_rows(spark, store), appender(store), ["doc_id"])
    stored = [r.content_hash for r in spark.read.parquet(store).collect()]
    assert len(stored) == len(set(stored)) == batch.select("content_hash").distinct().count()


def test_envelope_types(spark):
    from propwell import schema

    batch = ingest.record_envelope(
        document_items(spark, SF_DIR), source_name="s", source_url="u", retrieval_method="mock",
        job_id="j", ingested_at=datetime(2024, 1, 1),
    )
    expected = spark.createDataFrame([], schema.RAW_RECORDS)
    assert dict(batch.select(expected.columns).dtypes) == dict(expected.dtypes)
