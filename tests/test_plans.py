"""What the plans must look like at scale."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from propwell.functions.geometry import BBox
from propwell.operators import catalog, dedup, ingest, layers, records, segments, sinks
from propwell.queries import QUERIES
from propwell.queries.base import table
from propwell.queries.views import document_items, event_records, order_jobs, placed_customers
from propwell.sources import archive

SF_DIR = "/root/testdata/sf0.001"
#: Archives are unpacked in Python and written; what reads the XML from there has none.
PYTHON = {"element_text", "scan_listing_cards", "scan_listing_details"}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python_where_not_needed(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert ("Python" in text or "InPandas" in text) == (name in PYTHON)


@pytest.mark.parametrize("name", ["ingest_dedup", "first_seen_hash", "first_seen_listing", "latest_job_per_source"])
def test_repeats_collapse_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    before_exchange = text[text.index("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in before_exchange
    assert text.count("Exchange") == 1


def test_ingest_shuffles_the_batch_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = document_items(spark, SF_DIR)
        stored = batch.select("content_hash").distinct()
        text = plan(ingest.ingest_dedup(batch, stored, ["position"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2  # the batch, and the hashes of the store


def test_bucketed_store_is_not_shuffled(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS market LOCATION '{tmp_path}/market'")
    batch = document_items(spark, SF_DIR)
    sinks.save_bucketed(batch.select("content_hash", "payload_json"), "market.records", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = ingest.ingest_dedup(batch, spark.table("market.records"), ["position"])
        text = plan(fresh)
        assert fresh.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE market CASCADE")
    assert text.count("Exchange hashpartitioning") == 1
    assert re.search(r"Bucketed: true", text)


def test_predicates_and_columns_reach_the_scan(spark):
    found = records.filter_records(
        event_records(spark, SF_DIR), source_name="click", ingested_after=datetime(2024, 1, 5)
    )
    text = plan(records.count_records(found))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "EqualTo(event_type,click)" in pushed and "GreaterThanOrEqual(ts," in pushed
    assert "props" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_box_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "layer")
    sinks.save_layer(placed_customers(spark, SF_DIR), path)
    text = plan(layers.bbox_filter(spark.read.parquet(path), BBox(31, 32, 34, 35)))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(lng,34.0)" in pushed and "LessThanOrEqual(lat,32.0)" in pushed


def test_pages_are_one_top_k(spark):
    text = plan(records.page_records(event_records(spark, SF_DIR), limit=20, offset=40, tie="event_id"))
    assert "TakeOrderedAndProject(limit=60, offset=40" in text and "Exchange" not in text


def test_look_back_is_a_top_k_first(spark):
    text = plan(catalog.latest_job_per_source(order_jobs(spark, SF_DIR), lookback=200))
    assert "TakeOrderedAndProject(limit=200" in text


def test_hot_sequence_is_split(spark):
    """A third of the rows in one sequence, no broadcast: AQE splits its partition."""
    from propwell.operators.paging import page_prefix_cut

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128KB",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 300_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("unit"),
            (F.xxhash64("id") % 50).alias("page"),
            F.sha2(F.col("id").cast("string"), 256).alias("body"),
        )
        cut = page_prefix_cut(rows, ["unit"], "page", F.col("page") == 47)
        total = cut.agg(F.count("body"), F.sum(F.length("body")))
        total.collect()
        text = plan(total)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "SortMergeJoin(skew=true)" in text


def test_hot_listing_is_cut_into_chunks(spark):
    versions = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)).alias("listing"),
        F.timestamp_seconds(F.col("id") * 600).alias("at"),
        "id",
        (F.col("id") % 17).alias("price"),
    )
    history = records.listing_price_history(versions, ["listing"], "at", "id", "price", hot_rows=100)
    hot = [r for r in history.filter("listing = -1").orderBy("id").collect()]
    assert [r.previous_price for r in hot] == [None] + [r.price for r in hot[:-1]]
    assert history.filter("listing <> -1 AND previous_price IS NOT NULL").count() == 0
    assert history.count() == 3000


def test_chunks_are_bounded_and_carry_sums(spark):
    """A third of the rows in three weeks of one key, many of them at one instant."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 7).alias("listing"),
        F.timestamp_seconds(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id"))).alias("at"),
        "id",
    )
    chunked = segments.segmented(rows, ["listing"], ["at", "id"], 200)
    assert chunked.groupBy("listing", segments.CHUNK).count().agg(F.max("count")).head()[0] <= 200
    sums = segments.segmented_sum(chunked, ["listing"], ["at", "id"], F.col("id"), "so_far").collect()
    assert segments.CHUNK not in sums[0].asDict()
    expected, total = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.at, r.id)):
        expected[r.id] = total[r.listing] = total.get(r.listing, 0) + r.id
    assert {r.id: r.so_far for r in sums} == expected


def test_hot_hash_sends_one_row_per_task(spark):
    """A third of the rows has one hash: each of the 8 map tasks hands on one of them."""
    shared = F.col("id") % 3 == 0
    rows = spark.range(0, 90_000, 1, 8).select(
        F.when(shared, "same").otherwise(F.col("id").cast("string")).alias("content_hash"),
        F.lit("u").alias("unit"), F.lit(None).cast("string").alias("request_id"),
        F.lit(1).alias("page"), F.col("id").alias("position"),
    )
    fresh = dedup.first_seen_hash(rows)
    assert fresh.count() == 60_001
    assert fresh.filter("content_hash = 'same'").head().position == 0
    final = fresh._jdf.queryExecution()
    fresh.write.format("noop").mode("overwrite").save()
    text = final.executedPlan().toString()
    assert "Partial" in text[text.index("Exchange hashpartitioning"):]


def test_archives_are_only_unpacked_in_python(spark):
    frame = spark.createDataFrame([], "path STRING, content BINARY")
    assert "InPandas" in plan(archive.archive_parts(frame))
    parts = spark.createDataFrame([], archive.PART)
    about = archive.books(parts)
    cells = archive.sheet_cells(archive.numbered_rows(parts), archive.shared_strings(parts), about)
    for read in (about, cells):
        assert "InPandas" not in plan(read) and "Python" not in plan(read)


def test_shuffle_width():
    from propwell.session import shuffle_width

    assert [shuffle_width(n) for n in (0, 10**12, 10**14)] == [200, 7451, 745_059]


def test_parquet_store_keeps_source_folders(spark, tmp_path):
    path = str(tmp_path / "records")
    events = event_records(spark, SF_DIR).withColumns({"record_id": F.col("event_id"), "listing_id": F.lit("1")})
    sinks.append_records(events, path)
    text = plan(spark.read.parquet(path).filter("source_name = 'click'"))
    assert "PartitionFilters: [isnotnull(source_name" in text
    assert spark.read.parquet(path).count() == table(spark, SF_DIR, "events").count()
