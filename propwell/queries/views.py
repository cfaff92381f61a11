"""The given tables seen as this engine's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.functions.canonical import canonical_json, content_hash
from propwell.queries.base import table
from propwell.sources.items import items

DOC_JSON = (
    """('{"lang": ' || to_json(lang)::VARCHAR || ', "n_chars": ' || n_chars::VARCHAR"""
    """ || ', "text": ' || to_json(text)::VARCHAR || '}')"""
)
DOC_HASH = f"sha256({DOC_JSON})"


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as collected items: the source is the unit, the id the place."""
    docs = table(spark, sf_dir, "documents")
    text = canonical_json(docs, ["lang", "n_chars", "text"])
    return items(
        docs, text, content_hash(text),
        unit=F.col("source"), page=F.lit(1), position=F.col("doc_id"),
    )


JOBS_SQL = """(SELECT o_orderkey::VARCHAR AS job_id, 'c' || o_custkey AS source_name,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS completed_at,
  o_orderkey AS records_inserted,
  CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS error_message
  FROM orders)"""


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs, the customer as source."""
    status = F.col("o_orderstatus")
    failed = status == "F"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_name"),
        F.when(failed, "failed").when(status == "O", "running").otherwise("pending").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(failed, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("completed_at"),
        F.col("o_orderkey").alias("records_inserted"),
        F.when(failed, F.col("o_orderpriority")).alias("error_message"),
    )


CUSTOMER_SOURCES_SQL = """(SELECT 'c' || c_custkey AS name, c_name AS display_name,
  c_mktsegment AS description,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'planned' WHEN 'MACHINERY' THEN 'disabled'
    ELSE 'active' END AS status
  FROM customer)"""


def customer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a source registry."""
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"),
        F.col("c_name").alias("display_name"),
        segment.alias("description"),
        F.when(segment == "BUILDING", "planned")
        .when(segment == "MACHINERY", "disabled")
        .otherwise("active")
        .alias("status"),
    )


RECORDS_SQL = """(SELECT event_id, event_type AS source_name, user_id::VARCHAR AS job_id,
  ts AS ingested_at, CASE WHEN value < 20 THEN 'raw' ELSE 'parsed' END AS parsing_status,
  props FROM events)"""


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw records."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("source_name"),
        F.col("user_id").cast("string").alias("job_id"),
        F.col("ts").alias("ingested_at"),
        F.when(F.col("value") < 20, "raw").otherwise("parsed").alias("parsing_status"),
        "props",
    )


PLACED_SQL = """(SELECT c_custkey, c_name, c_mktsegment,
  34 + (c_custkey % 200)::DOUBLE / 100 AS lng, 31 + (c_custkey * 37 % 300)::DOUBLE / 100 AS lat
  FROM customer)"""


def placed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a place derived from their key."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        (F.lit(34) + (key % 200).cast("double") / 100).alias("lng"),
        (F.lit(31) + (key * 37 % 300).cast("double") / 100).alias("lat"),
    )


def text(*parts: str | Column) -> Column:
    """Concatenation of literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
