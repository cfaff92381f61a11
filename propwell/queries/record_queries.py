"""Record, job and registry queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell import fixed
from propwell.operators import catalog, deep_pages, jobs, records, sinks
from propwell.operators.paging import union_skip_failed as split_failed
from propwell.operators.state_log import StateLog
from propwell.queries.base import ORACLE, query, table
from propwell.queries.views import (
    CUSTOMER_SOURCES_SQL,
    JOBS_SQL,
    RECORDS_SQL,
    customer_sources,
    event_records,
    order_jobs,
)
from propwell.session import scratch_path
from propwell.sources import store

_FROM, _TO = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
_RANGE = "ingested_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'"
_NOW = datetime(2024, 6, 1)


# filters, counts, lookups


@query(f"SELECT * FROM {RECORDS_SQL} WHERE source_name = 'click' AND parsing_status = 'raw' AND {_RANGE}")
def filter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.filter_records(
        event_records(spark, sf_dir), source_name="click", parsing_status="raw", job_id="",
        ingested_after=_FROM, ingested_before=_TO,
    )


@query(f"SELECT count(*) AS total FROM {RECORDS_SQL} WHERE source_name = 'view' AND {_RANGE}")
def count_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.filter_records(
        event_records(spark, sf_dir), source_name="view", ingested_after=_FROM, ingested_before=_TO
    )
    return records.count_records(found)


@query("SELECT event_id, event_type, props FROM events WHERE event_id = 77")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return records.lookup_by_id(events, "77", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey::VARCHAR = '7'")
def lookup_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.col("o_orderstatus").alias("source_name"),
        F.col("o_custkey").cast("string").alias("listing_id"),
    )
    return records.lookup_listing(versions, "F", "7").select("o_orderkey", "o_totalprice")


@query(
    """SELECT o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) OVER
      (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_price FROM orders
    WHERE o_custkey IS NOT NULL"""
)
def listing_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"
    )
    history = records.listing_price_history(
        versions, ["o_custkey"], "o_orderdate", "o_orderkey", "o_totalprice"
    )
    return history.drop("o_orderdate")


# pages


@query(
    f"""SELECT event_id, source_name, ingested_at FROM {RECORDS_SQL}
    ORDER BY ingested_at DESC, event_id DESC LIMIT 20 OFFSET 40"""
)
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_records(spark, sf_dir).select("event_id", "source_name", "ingested_at")
    return records.page_records(rows, limit=20, offset=40, tie="event_id")


@query(
    """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
    ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC LIMIT 50
    OFFSET (SELECT count(*) // 2 FROM lineitem)"""
)
def page_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the middle of all line items; at most 1,000 rows are sorted before it, whatever the table's size."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    placed = rows.withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = deep_pages.page_at_depth(placed, "l_shipdate", True, 50, rows.count() // 2, "line", most_skipped=1_000)
    return found.drop("line")


@query(
    """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
    ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber DESC LIMIT 50 OFFSET 50"""
)
def page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of line items, by the cursor that the first one ends with."""
    placed = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line")
    )
    first = records.page_after(placed, None, "l_shipdate", limit=50, tie="line").collect()
    return records.page_after(placed, first[-1].asDict(), "l_shipdate", limit=50, tie="line").drop("line")


@query(
    f"""SELECT event_id, ingested_at, (SELECT count(*) FROM events WHERE event_type = 'click')
      AS total FROM {RECORDS_SQL} WHERE source_name = 'click'
    ORDER BY ingested_at DESC, event_id DESC LIMIT 20 OFFSET 20"""
)
def page_records_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.filter_records(event_records(spark, sf_dir), source_name="click")
    page = found.select("event_id", "ingested_at")
    return records.page_records_with_total(page, limit=20, offset=20, tie="event_id")


@query(
    f"""SELECT job_id, status, created_at FROM {JOBS_SQL} WHERE status = 'failed'
    ORDER BY created_at DESC, job_id DESC LIMIT 50 OFFSET 10"""
)
def page_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_jobs(spark, sf_dir).select("job_id", "status", "created_at")
    return jobs.page_jobs(rows, "failed", 50, 10)


@query(
    """SELECT event_id, ts FROM events WHERE user_id::VARCHAR = '5'
    ORDER BY ts, event_id LIMIT 7 OFFSET 2"""
)
def page_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"),
        F.col("user_id").cast("string").alias("job_id"),
        F.col("ts").alias("created_at"),
    )
    return jobs.page_logs(logs, "5", 7, 2).select(
        F.col("log_id").alias("event_id"), F.col("created_at").alias("ts")
    )


@query(f"SELECT * FROM {CUSTOMER_SOURCES_SQL} ORDER BY name LIMIT 20 OFFSET 40")
def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_sources(customer_sources(spark, sf_dir), 20, 40)


@query(f"SELECT count(*) AS total FROM {CUSTOMER_SOURCES_SQL}")
def count_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_sources(customer_sources(spark, sf_dir))


# status view

_STATUS_SQL = f"""SELECT s.name AS source_name, s.display_name, s.status,
  j.status AS last_job_status, j.job_id AS last_job_id, j.completed_at AS last_run_at,
  CASE WHEN j.job_id IS NULL THEN 0 ELSE j.records_inserted END AS last_records_inserted
  FROM {CUSTOMER_SOURCES_SQL} s LEFT JOIN
  (SELECT * FROM (SELECT *, row_number() OVER
    (PARTITION BY source_name ORDER BY created_at DESC, job_id DESC) AS rn FROM {{jobs}})
   WHERE rn = 1) j ON j.source_name = s.name"""


@query(_STATUS_SQL.format(jobs=JOBS_SQL))
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.source_status(customer_sources(spark, sf_dir), order_jobs(spark, sf_dir))


@query(
    _STATUS_SQL.format(
        jobs=f"(SELECT * FROM {JOBS_SQL} ORDER BY created_at DESC, job_id DESC LIMIT 200)"
    )
)
def source_status_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as it is when only the newest 200 jobs are looked at."""
    return catalog.source_status(
        customer_sources(spark, sf_dir), order_jobs(spark, sf_dir), fixed.STATUS_LOOKBACK_JOBS
    )


@query(
    f"""SELECT * FROM ({_STATUS_SQL.format(jobs=JOBS_SQL)})
    ORDER BY source_name LIMIT 20 OFFSET 110"""
)
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = catalog.source_status(customer_sources(spark, sf_dir), order_jobs(spark, sf_dir))
    return catalog.page_status(status, 20, 110)


@query(
    f"""SELECT source_name, job_id, created_at FROM (SELECT *, row_number() OVER
      (PARTITION BY source_name ORDER BY created_at DESC, job_id DESC) AS rn FROM {JOBS_SQL})
    WHERE rn = 1"""
)
def latest_job_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_jobs(spark, sf_dir).select("source_name", "job_id", "created_at")
    return catalog.latest_job_per_source(rows)


# jobs


@query(f"SELECT * FROM {JOBS_SQL} WHERE status = 'pending'")
def filter_jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.filter_jobs_by_status(order_jobs(spark, sf_dir), "pending")


@query(
    f"""SELECT * FROM {JOBS_SQL} UNION ALL SELECT 'new-' || c_custkey, 'c' || c_custkey,
      'pending', TIMESTAMP '2024-06-01', NULL, 0, NULL FROM customer"""
)
def create_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    requests = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("new-"), key).alias("job_id"), F.concat(F.lit("c"), key).alias("source_name")
    )
    return jobs.create_jobs(order_jobs(spark, sf_dir), requests, _NOW)


@query(
    f"""SELECT job_id, source_name, created_at,
      CASE WHEN n = 0 THEN status WHEN returned THEN 'failed' ELSE 'completed' END AS status,
      CASE WHEN n = 0 THEN completed_at ELSE last_ship END AS completed_at,
      CASE WHEN n = 0 THEN records_inserted ELSE n END AS records_inserted,
      CASE WHEN n = 0 THEN error_message END AS error_message
    FROM {JOBS_SQL} LEFT JOIN (SELECT l_orderkey::VARCHAR AS job_id, count(*) AS n,
      bool_or(l_returnflag = 'R') AS returned, max(l_shipdate) AS last_ship
      FROM lineitem GROUP BY 1) USING (job_id)""".replace("n = 0", "n IS NULL")
)
def transition_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with lines changes its status, three fields are set, one of them to NULL."""
    return jobs.transition_jobs(order_jobs(spark, sf_dir), _line_changes(spark, sf_dir), _CHANGED)


_CHANGED = ["completed_at", "records_inserted", "error_message"]


def _line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").cast("string").alias("job_id"))
        .agg(
            F.when(F.bool_or(F.col("l_returnflag") == "R"), "failed").otherwise("completed").alias("status"),
            F.max("l_shipdate").alias("completed_at"),
            F.count("*").alias("records_inserted"),
        )
        .withColumns(
            {
                "error_message": F.lit(None).cast("string"),
                "seq": F.lit(1),
                "set_fields": F.array(
                    F.lit("completed_at"), F.lit("records_inserted"), F.lit("error_message")
                ),
            }
        )
    )


@query(ORACLE["transition_jobs"])
def job_state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes, committed one after the other to a log that another writer compacts in between."""
    made = order_jobs(spark, sf_dir)
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields)
    log = StateLog(spark, scratch_path(spark, "jobs"), columns, "job_id")
    log.update(lambda _: made)
    changes = sinks.materialize(_line_changes(spark, sf_dir), "changes")
    for odd in (0, 1):
        some = changes.filter(F.col("job_id").cast("bigint") % 2 == odd)
        log.update(lambda now, some=some: jobs.transition_jobs(now.join(some.select("job_id"), "job_id", "left_semi"), some, _CHANGED))
        log.compact()
    return log.read()


@query(
    f"""SELECT job_id, source_name, created_at, records_inserted,
      CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status,
      CASE WHEN status IN ('pending', 'running') THEN TIMESTAMP '2024-06-01'
        ELSE completed_at END AS completed_at,
      CASE WHEN status IN ('pending', 'running') THEN
        'Recovered on service restart — job interrupted' ELSE error_message END AS error_message
    FROM {JOBS_SQL}"""
)
def recover_stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recover_stale_jobs(order_jobs(spark, sf_dir), _NOW)


@query(
    """SELECT event_id, user_id::VARCHAR AS job_id, 'info' AS level, ts AS created_at FROM events
    UNION ALL SELECT o_orderkey, o_custkey::VARCHAR, 'error', o_orderdate FROM orders
      WHERE o_orderstatus = 'F'"""
)
def append_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("job_id"),
        F.lit("info").alias("level"), F.col("ts").alias("created_at"),
    )
    entries = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("job_id"),
        F.lit("error").alias("level"), F.col("o_orderdate").alias("created_at"),
    )
    return jobs.append_logs(logs, entries)


@query(
    f"""SELECT name AS source_name FROM {CUSTOMER_SOURCES_SQL} s WHERE EXISTS
      (SELECT 1 FROM {JOBS_SQL} j WHERE j.source_name = s.name AND j.status = 'running')"""
)
def has_running_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = customer_sources(spark, sf_dir).select(F.col("name").alias("source_name"))
    return jobs.has_running_job(requests, order_jobs(spark, sf_dir))


def _family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as child jobs of their order."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("parent_id"),
        F.when(flag == "R", "failed").when(flag == "N", "running").otherwise("completed").alias("status"),
    )


@query(
    """SELECT o_orderkey::VARCHAR AS job_id, NOT coalesce(is_open, false) AS final,
      CASE WHEN is_open THEN 'running' WHEN any_failed THEN 'partial' ELSE 'completed' END
        AS rolled_status
    FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag = 'N') AS is_open,
      bool_or(l_returnflag = 'R') AS any_failed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def rollup_parent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rollup_parent_status(order_jobs(spark, sf_dir), _family(spark, sf_dir))


@query(
    """SELECT conv_id::VARCHAR AS parent_id, o_orderkey::VARCHAR AS job_id, o_orderstatus AS status
    FROM (SELECT conv_id, unnest([turn, conv_id, conv_id + turn, -1]) AS child FROM conversations)
    JOIN orders ON o_orderkey = child"""
)
def parent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parents that list four job ids, one of which does not exist."""
    conv, turn = F.col("conv_id"), F.col("turn")
    ids = F.array(turn, conv, conv + turn, F.lit(-1).cast("bigint")).cast("array<string>")
    parents = table(spark, sf_dir, "conversations").select(
        conv.cast("string").alias("job_id"), ids.alias("sub_job_ids")
    )
    children = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_orderstatus").alias("status")
    )
    return jobs.parent_children(jobs.child_links(parents), children)


@query(
    """WITH r AS (SELECT event_type AS source_name, user_id, count(*) FILTER (value > 30) AS records,
      count(*) FILTER (value < 1) AS errors FROM events GROUP BY 1, 2)
    SELECT *, CASE WHEN records > 0 THEN 'success'
      WHEN source_name = 'click' AND errors > 0 THEN 'failed'
      WHEN source_name = 'click' THEN 'success' ELSE 'empty' END AS run_status FROM r"""
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("source_name"), "user_id")
        .agg(
            F.count_if(F.col("value") > 30).alias("records"),
            F.count_if(F.col("value") < 1).alias("errors"),
        )
    )
    return jobs.run_status(runs, empty_ok=["click"])


@query(
    """SELECT user_id, count(*) AS records_count,
      (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS duration_ms FROM events GROUP BY 1"""
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_metrics(table(spark, sf_dir, "events"), ["user_id"], "ts", "ts")


# registry


@query(
    """SELECT coalesce(c_custkey, key) AS name,
      CASE WHEN key IS NOT NULL THEN last_day ELSE c_name END AS display_name,
      CASE WHEN key IS NOT NULL THEN status ELSE c_mktsegment END AS status, c_acctbal
    FROM customer FULL JOIN (SELECT o_custkey * 2 AS key, max(o_orderpriority) AS last_day,
      CASE WHEN min(o_orderstatus) <> 'F' THEN min(o_orderstatus) END AS status
      FROM orders GROUP BY 1) ON key = c_custkey"""
)
def upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the updates meet a row, half are new; some set a field to NULL."""
    registry = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("name"), F.col("c_name").alias("display_name"),
        F.col("c_mktsegment").alias("status"), "c_acctbal",
    )
    lowest = F.min("o_orderstatus")
    updates = (
        table(spark, sf_dir, "orders")
        .groupBy((F.col("o_custkey") * 2).alias("name"))
        .agg(
            F.max("o_orderpriority").alias("display_name"),
            F.when(lowest != "F", lowest).alias("status"),
        )
    )
    return catalog.upsert_sources(registry, updates)


_SEED_SQL = ", ".join(
    f"('{s[0]}', '{s[1]}', '{s[2]}', '{s[3]}', '{s[4]}', '{','.join(s[5])}')"
    for s in fixed.SEED_SOURCES
)


@query(
    f"""SELECT name, display_name, description, status, NULL::VARCHAR AS source_url,
      NULL::VARCHAR AS tags FROM {CUSTOMER_SOURCES_SQL} UNION ALL VALUES {_SEED_SQL}"""
)
def seed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed rows merged into a registry that holds other sources."""
    registry = customer_sources(spark, sf_dir).withColumns(
        {"source_url": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>")}
    )
    seeded = catalog.upsert_sources(registry, catalog.seed_sources(spark))
    return seeded.withColumn("tags", F.array_join("tags", ","))


@query(f"SELECT * FROM {CUSTOMER_SOURCES_SQL} WHERE status = 'active'")
def filter_active_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.filter_active_sources(customer_sources(spark, sf_dir))


@query(
    f"""SELECT o_orderkey, CASE WHEN status = 'planned' THEN 'planned'
      WHEN able IS NOT NULL THEN 'runnable' WHEN status IS NOT NULL THEN 'not_implemented'
      ELSE 'not_found' END AS verdict
    FROM (SELECT o_orderkey, replace('c' || (o_custkey * 2), '-', '_') AS asked FROM orders)
    LEFT JOIN {CUSTOMER_SOURCES_SQL} ON name = asked
    LEFT JOIN (SELECT 'c' || s_suppkey AS able FROM supplier) ON able = asked"""
)
def runnable_source_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = (F.col("o_custkey") * 2).cast("string")
    requests = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("c"), doubled).alias("source_name")
    )
    implemented = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("name")
    )
    registry = customer_sources(spark, sf_dir)
    return catalog.runnable_source_check(requests, registry, implemented).drop("source_name")


@query("SELECT o_orderkey, replace(o_orderpriority, '-', '_') AS source_name FROM orders")
def normalize_source_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = catalog.normalize_source_name(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("source_name"))


# scans of stored tables


@query(f"SELECT job_id, source_name, status, records_inserted FROM {JOBS_SQL} WHERE status = 'failed'")
def scan_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jobs")
    sinks.append_rows(order_jobs(spark, sf_dir).drop("created_at", "completed_at"), path)
    found = store.scan_jobs(spark, path, "failed")
    return found.select("job_id", "source_name", "status", "records_inserted")


@query("SELECT event_id::VARCHAR AS log_id, event_type AS message FROM events WHERE user_id = 3")
def scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "logs")
    logs = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("log_id"),
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_type").alias("message"),
    )
    sinks.append_rows(logs, path)
    return store.scan_logs(spark, path, "3").select("log_id", "message")


@query(f"SELECT name, display_name, status FROM {CUSTOMER_SOURCES_SQL}")
def scan_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sources")
    sinks.append_rows(customer_sources(spark, sf_dir), path)
    return store.scan_sources(spark, path).select("name", "display_name", "status")


@query(
    """SELECT user_id, count(*) AS n_rows, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS sum_k
    FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value < 0.5) GROUP BY 1"""
)
def union_skip_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit with one unreadable row is left out whole."""
    landed = F.when(F.col("value") < 0.5, F.replace("props", F.lit("}"), F.lit(""))).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.from_json(landed, "k BIGINT").getField("k").alias("k")
    )
    good, _ = split_failed(rows, ["user_id"], F.col("k").isNull(), "event_id")
    return good.groupBy("user_id").agg(F.count("*").alias("n_rows"), F.sum("k").alias("sum_k"))
