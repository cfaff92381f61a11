"""The requests end to end, over a store in one folder."""

import json
from datetime import datetime, timezone

import pytest

from propwell import fixed, schema
from propwell.functions.geometry import BBox
from propwell.operators import layers, sinks
from propwell.operators.ingest import existing_hash_antijoin
from propwell.plans.requests import JobAlreadyRunning, MarketStore
from propwell.queries.workbooks import archive, workbook
from propwell.sources.registry import register_source
from test_sources import deal_page, index_page, state_page


@pytest.fixture
def market(spark, tmp_path):
    store = MarketStore(spark, str(tmp_path / "store"))
    store.create()
    return store


@pytest.fixture
def landed(spark, tmp_path):
    def save(name, rows):
        path = str(tmp_path / "landed" / name)
        spark.createDataFrame(rows, schema.LANDED_PAGE).write.parquet(path)
        return path

    save("deals/places", [("x", None, 1, 200, '{"results": [{"shape": "POINT(1 2)"}]}')])
    save("deals/polygons", [("x", None, 1, 200, '[{"polygon_id": "1"}]')])
    save("deals/deals", [("", "1", 1, 200, deal_page(1, 2, 2))])
    zips = tmp_path / "landed" / "zips"
    zips.mkdir()
    (zips / "a.zip").write_bytes(archive({"a.xlsx": workbook(["GUSH", "DEALAMOUNT"], [("6", 7), ("6", 7)])}))
    return {
        fixed.INDEX_SOURCE: save("index", [("40010", None, 1, 200, index_page(2020))]),
        fixed.LISTINGS_SOURCE: save("listings", [("haifa", None, 1, 200, state_page(["5", "6", "5"]))]),
        fixed.DEALS_SOURCE: str(tmp_path / "landed" / "deals"),
        fixed.ARCHIVE_SOURCE: str(zips),
    }


def test_collect_all(spark, market, landed):
    parent = market.collect_all(landed)
    jobs = {r.source_name: r for r in market.jobs().collect()}
    assert jobs["all"].job_id == parent and jobs["all"].status == "completed"
    assert len(jobs["all"].sub_job_ids) == 4 and jobs["all"].records_inserted == 0
    counts = {n: (r.status, r.records_inserted, r.records_skipped) for n, r in jobs.items() if n != "all"}
    assert counts == {
        fixed.INDEX_SOURCE: ("completed", 1, 0),
        fixed.LISTINGS_SOURCE: ("completed", 2, 0),
        fixed.DEALS_SOURCE: ("completed", 2, 0),
        fixed.ARCHIVE_SOURCE: ("completed", 1, 1),
    }
    assert market.count().head().total == 6
    page = market.list_records(limit=2, source_name=fixed.LISTINGS_SOURCE).collect()
    assert [r.total for r in page] == [2, 2] and page[0].record_id > page[1].record_id
    again = market.collect_source(fixed.LISTINGS_SOURCE, landed[fixed.LISTINGS_SOURCE])
    job = market.get_job(again).head()
    assert (job.records_inserted, job.records_skipped) == (0, 2)
    status = {r.source_name: r for r in market.collections_status().collect()}
    assert status[fixed.LISTINGS_SOURCE].last_job_id == again
    record = market.get_record(page[0].record_id).head()
    assert record.content_hash == page[0].content_hash
    assert market.get_record("not an id").count() == 0
    assert [r.job_id for r in market.list_jobs("completed", 1).collect()] == [again]
    assert market.list_all_jobs().count() == 6


def test_bucketed_store(spark, landed, tmp_path):
    """Records in a table bucketed by hash: same results, and ingest leaves the store in place."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/bucketed'")
    try:
        market = MarketStore(spark, str(tmp_path / "store"), records_table="bucketed.raw_records", buckets=8)
        market.create()
        market.create()
        for _ in range(2):
            job = market.get_job(market.collect_source(fixed.LISTINGS_SOURCE, landed[fixed.LISTINGS_SOURCE])).head()
        assert (job.status, job.records_inserted, job.records_skipped) == ("completed", 0, 2)
        market.collect_source(fixed.DEALS_SOURCE, landed[fixed.DEALS_SOURCE])
        assert market.count().head().total == 4
        assert market.count(source_name=fixed.DEALS_SOURCE).head().total == 2
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        batch = spark.range(5).selectExpr("sha2(string(id), 256) AS content_hash")
        fresh = existing_hash_antijoin(batch, market.records())
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_indexed_store(spark, landed, tmp_path):
    """Stored hashes found through sketches: same counts in batch and bit by bit."""
    market = MarketStore(spark, str(tmp_path / "store"), indexed=True)
    market.create()
    for inserted, skipped in ((2, 0), (0, 2)):
        job = market.get_job(market.collect_source(fixed.LISTINGS_SOURCE, landed[fixed.LISTINGS_SOURCE])).head()
        assert (job.status, job.records_inserted, job.records_skipped) == ("completed", inserted, skipped)
    checkpoint = str(tmp_path / "checkpoint")
    job = market.get_job(market.collect_incremental(fixed.LISTINGS_SOURCE, landed[fixed.LISTINGS_SOURCE], checkpoint)).head()
    assert (job.status, job.records_inserted, job.records_skipped) == ("completed", 0, 2)
    job = market.get_job(market.collect_source(fixed.DEALS_SOURCE, landed[fixed.DEALS_SOURCE])).head()
    assert (job.status, job.records_inserted) == ("completed", 2)
    assert market.count().head().total == 4


def test_incremental_equals_batch(spark, market, landed, tmp_path):
    """Cities land as files of their own; a bad one fails the job, the rest stays stored."""
    root = tmp_path / "cities"
    for city, ids in (("haifa", ["1", "2"]), ("lod", ["2", "3", "3"])):
        rows = [(city, None, 1, 200, state_page(ids))]
        spark.createDataFrame(rows, schema.LANDED_PAGE).coalesce(1).write.mode("append").parquet(str(root))
    checkpoint = str(tmp_path / "checkpoint")

    def run():
        return market.get_job(market.collect_incremental(fixed.LISTINGS_SOURCE, str(root), checkpoint, 1)).head()

    job = run()
    assert (job.status, job.records_inserted, job.records_skipped) == ("completed", 3, 1)
    assert market.count(source_name=fixed.LISTINGS_SOURCE).head().total == 3
    job = run()
    assert (job.status, job.records_inserted, job.records_skipped) == ("completed", 0, 0)
    job = market.get_job(market.collect_incremental(fixed.ARCHIVE_SOURCE, str(root), checkpoint)).head()
    assert job.status == "failed" and "pages" in job.error_message
    deals = market.collect_incremental(fixed.DEALS_SOURCE, landed[fixed.DEALS_SOURCE], str(tmp_path / "deals-checkpoint"))
    assert market.get_job(deals).head().records_inserted == 2


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_sequences_over_files_and_batches(spark, market, tmp_path, files_per_batch):
    """A city of 70 listings over two files, in two crawls with another price, beside a city that
    answers 502: the same rows for any number of files per batch, and a trace of the failure."""
    root = str(tmp_path / "cities")
    ids = [str(i) for i in range(70)]
    for run, price in (("a", "1250000"), ("b", "90")):
        for page, part in ((1, ids[:50]), (2, ids[50:])):
            body = state_page(part).replace("1250000", price)
            rows = [("haifa", None, page, 200, body, run), (f"bad{page}", None, 1, 502, "", run)]
            spark.createDataFrame(rows, schema.LANDED_PAGE_OF_RUN).coalesce(1).write.mode("append").parquet(root)
    job_id = market.collect_incremental(fixed.LISTINGS_SOURCE, root, str(tmp_path / "checkpoint"), files_per_batch)
    assert market.get_job(job_id).head().status == "completed"
    assert market.count(source_name=fixed.LISTINGS_SOURCE).head().total == 140
    failed = {(r.details["unit"], r.details["run_id"]) for r in market.job_log(job_id).collect()}
    assert failed == {(f"bad{page}", run) for page in (1, 2) for run in ("a", "b")}


def test_price_history(spark, market, tmp_path):
    for day, price in ((1, 100), (2, 90), (3, 95)):
        body = state_page(["5"]).replace("1250000", str(price))
        path = str(tmp_path / f"day{day}")
        spark.createDataFrame([("haifa", None, 1, 200, body)], schema.LANDED_PAGE).write.parquet(path)
        market.collect_source(fixed.LISTINGS_SOURCE, path)
    history = market.price_history(fixed.LISTINGS_SOURCE, "5").orderBy("ingested_at").collect()
    assert [(r.price, r.previous_price) for r in history] == [(100, None), (90, 100), (95, 90)]


def test_failures_end_in_the_job(spark, market):
    for name, message in (("unknown", "not_found"), (fixed.INDEX_SOURCE, "/nowhere")):
        job = market.get_job(market.collect_source(name, "/nowhere")).head()
        assert job.status == "failed" and message in job.error_message
        (entry,) = market.job_log(job.job_id).collect()
        assert entry.level == "error" and entry.details == {"source_name": name}


def test_listing_run_without_listings(spark, market, tmp_path):
    """Empty is fine; empty because every city failed is a failed run."""

    def run(name, *rows):
        path = str(tmp_path / name)
        spark.createDataFrame(list(rows), schema.LANDED_PAGE).write.parquet(path)
        return market.get_job(market.collect_source(fixed.LISTINGS_SOURCE, path)).head()

    assert run("empty", ("haifa", None, 1, 200, "")).status == "completed"
    job = run("bad", ("haifa", None, 1, 502, ""), ("lod", None, 1, 200, ""))
    assert job.status == "failed" and "haifa" in job.error_message and "lod" not in job.error_message
    assert run("mixed", ("haifa", None, 1, 502, ""), ("lod", None, 1, 200, state_page(["1"]))).records_inserted == 1


def test_hyphenated_name_and_own_source(spark, market, landed):
    job = market.get_job(market.collect_source("cbs-housing", landed[fixed.INDEX_SOURCE])).head()
    assert job.status == "completed" and job.records_inserted == 1
    register_source("own_source", lambda session, path: market.records())
    with pytest.raises(LookupError):
        market.runnable_source("nobody")
    assert market.runnable_source("own-source").name == "own_source"
    with pytest.raises(ValueError):
        register_source("x", lambda session, path: None, retrieval_method="pigeon")


def test_running_job_blocks_and_recovers(spark, market):
    job_id = market._new_job("cbs_housing")
    market._transition(job_id, "running", started_at=datetime(2024, 1, 1, tzinfo=timezone.utc))
    with pytest.raises(JobAlreadyRunning):
        market.collect_source("cbs_housing", "/nowhere")
    assert market.recover() == 1 and market.recover() == 0
    job = market.get_job(job_id).head()
    assert (job.status, job.error_message) == ("failed", fixed.STALE_JOB_MESSAGE)
    assert job.started_at is not None and job.completed_at is not None


def test_sources_are_seeded_once(market):
    market.create()
    assert [r.name for r in market.list_sources().collect()] == sorted(s[0] for s in fixed.SEED_SOURCES)


def test_map_features(spark, market):
    listings = spark.createDataFrame(
        [("1", 34.8, 32.1), ("2", 34.9, 32.2), ("3", 10.0, 10.0), ("4", None, 1.0)], "name STRING, lng DOUBLE, lat DOUBLE"
    )
    rows = layers.with_bounds(layers.listings_as_properties(listings))
    sinks.save_layer(rows, market.path("properties"))
    assert [r.id for r in market.layers().collect()] == ["properties", "districts"]
    features = market.map_features("properties", BBox(32, 33, 34, 35))
    found = [json.loads(r.j) for r in features.select(layers.feature_json(features).alias("j")).collect()]
    assert sorted(f["properties"]["name"] for f in found) == ["1", "2"]
    assert found[0]["geometry"]["coordinates"] == [34.8, 32.1]
    with pytest.raises(LookupError):
        market.map_features("parcels", BBox(32, 33, 34, 35))


def test_job_changes(spark):
    from propwell.operators.jobs import parent_children, child_links, rollup_parent_status, run_status, transition_jobs

    jobs = spark.createDataFrame(
        [("1", "pending", "old", ["2", "3", "9"]), ("2", "completed", None, []), ("3", "failed", None, []), ("4", "failed", None, ["3"])],
        "job_id STRING, status STRING, error_message STRING, sub_job_ids ARRAY<STRING>",
    )
    changes = spark.createDataFrame(
        [("1", "running", "x", 1, ["error_message"]), ("1", "completed", None, 2, ["error_message"]),
         ("2", "failed", "ignored", 1, []), ("8", "failed", "y", 1, ["error_message"])],
        "job_id STRING, status STRING, error_message STRING, seq INT, set_fields ARRAY<STRING>",
    )
    changed = {r.job_id: (r.status, r.error_message) for r in transition_jobs(jobs, changes, ["error_message"]).collect()}
    assert changed == {"1": ("completed", None), "2": ("failed", None), "3": ("failed", None), "4": ("failed", None)}
    family = parent_children(child_links(jobs), jobs)
    rolled = {r.job_id: (r.final, r.rolled_status) for r in rollup_parent_status(jobs, family).collect()}
    assert rolled == {"1": (True, "partial"), "2": (True, "completed"), "3": (True, "completed"), "4": (True, "partial")}
    runs = spark.createDataFrame(
        [("a", 0, 1, False), ("a", 1, 1, False), ("m", 0, 0, False), ("m", 0, 2, False), ("a", 5, 0, True)],
        "source_name STRING, records INT, errors INT, crashed BOOLEAN",
    )
    assert [r.run_status for r in run_status(runs, ["m"]).collect()] == ["empty", "success", "success", "failed", "failed"]


def test_page_limits(spark, market):
    with pytest.raises(ValueError):
        market.list_records(limit=101)
    with pytest.raises(ValueError):
        market.list_records(limit=1, offset=-1)
    assert market.records(source_name="", parsing_status=None).count() == 0


def test_columns_only_rename(spark):
    frame = spark.createDataFrame([(1, 2)], "monthDesc INT, other INT")
    from propwell.functions.canonical import canonical_columns

    assert canonical_columns(frame).columns == ["month_name_he", "other"]
