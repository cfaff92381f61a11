"""Ingest, hashing and first-occurrence queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.functions import canonical
from propwell.operators import dedup, ingest, sinks
from propwell.operators.hash_index import HashIndex
from propwell.queries.base import query, table
from propwell.queries.views import DOC_HASH, document_items
from propwell.session import scratch_path
from propwell.sources import registry, store
from propwell.sources.items import items
from propwell.streaming.incremental import existing_rows, incremental_ingest

_RUN_AT = datetime(2024, 6, 1)


def _envelope(batch: DataFrame, source_name: str = "documents") -> DataFrame:
    return ingest.record_envelope(
        batch,
        source_name=source_name,
        source_url="https://example.org/documents",
        retrieval_method="http_get",
        job_id="job-1",
        ingested_at=_RUN_AT,
    )


@query(
    f"""SELECT content_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source
    FROM (SELECT doc_id, source, {DOC_HASH} AS content_hash FROM documents) GROUP BY 1"""
)
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = ingest.ingest_dedup(document_items(spark, sf_dir), None, ["position"])
    return fresh.select(
        "content_hash", F.col("position").alias("doc_id"), F.col("unit").alias("source")
    )


@query(
    f"""WITH h AS (SELECT doc_id, source, {DOC_HASH} AS content_hash FROM documents),
    k AS (SELECT source, doc_id = min(doc_id) OVER (PARTITION BY content_hash) AS is_new FROM h)
    SELECT source, count(*) FILTER (is_new)::BIGINT AS inserted,
      count(*) FILTER (NOT is_new)::BIGINT AS skipped FROM k GROUP BY 1"""
)
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = document_items(spark, sf_dir)
    fresh = ingest.ingest_dedup(batch.select("unit", "position", "content_hash"), None, ["position"])
    return ingest.ingest_counts(batch, fresh, ["unit"]).withColumnRenamed("unit", "source")


@query(
    f"""WITH h AS (SELECT doc_id, {DOC_HASH} AS content_hash FROM documents)
    SELECT doc_id, content_hash FROM h WHERE content_hash NOT IN
      (SELECT content_hash FROM h JOIN labels USING (doc_id))"""
)
def existing_hash_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents are the store, all documents the batch."""
    batch = document_items(spark, sf_dir).select(F.col("position").alias("doc_id"), "content_hash")
    stored = batch.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    known = stored.select("content_hash").distinct()
    return ingest.existing_hash_antijoin(batch, known, spread_by="doc_id")


@query(
    f"""SELECT count(DISTINCT h)::BIGINT AS inserted, (count(*) - count(DISTINCT h))::BIGINT AS skipped
    FROM (SELECT {DOC_HASH} AS h FROM documents)"""
)
def ingest_counts_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into a new store; both counts are taken by the writes, none by a second read."""
    items_, seen = sinks.materialize_counted(document_items(spark, sf_dir), "items")
    fresh = ingest.ingest_dedup(_envelope(items_), None)
    rows = fresh.drop("unit", "request_id", "page", "position")
    inserted = sinks.append_records(rows, scratch_path(spark, "raw-records"))
    return spark.range(1).select(F.lit(inserted).cast("bigint").alias("inserted"), F.lit(seen - inserted).cast("bigint").alias("skipped"))


@query(
    f"""WITH h AS (SELECT doc_id, {DOC_HASH} AS content_hash FROM documents)
    SELECT doc_id, content_hash FROM h WHERE content_hash NOT IN
      (SELECT content_hash FROM h JOIN labels USING (doc_id))"""
)
def hash_index_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `existing_hash_antijoin`, with the store's hashes read through sketches; two appends, an index of each."""
    batch = document_items(spark, sf_dir).select(F.col("position").alias("doc_id"), "content_hash")
    stored = batch.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "content_hash")
    path, index = scratch_path(spark, "stored"), HashIndex(spark, scratch_path(spark, "hash-index"))
    for part in (F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 != 0):
        stored.filter(part).write.mode("append").parquet(path)
        index.refresh(spark.read.parquet(path))
    return ingest.existing_hash_antijoin(batch, index.matching(batch), spread_by="doc_id")


@query(
    f"""SELECT doc_id, content_hash FROM
    (SELECT doc_id, {DOC_HASH} AS content_hash, row_number() OVER
      (PARTITION BY {DOC_HASH} ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1"""
)
def first_seen_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_items(spark, sf_dir).drop("payload_json")
    return dedup.first_seen_hash(rows).select(F.col("position").alias("doc_id"), "content_hash")


@query(f"SELECT doc_id, {DOC_HASH} AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = canonical.canonical_json(docs, ["text", "n_chars", "lang"])
    return docs.select("doc_id", canonical.content_hash(text).alias("content_hash"))


@query(
    """SELECT o_orderkey, sha256('{"address": ' || to_json(o_orderpriority)::VARCHAR ||
      ', "listing_id": "' || o_custkey || '", "price": ' || o_orderkey || '}') AS key_hash
    FROM orders"""
)
def listing_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("listing_id"),
        F.col("o_orderkey").alias("price"),
        F.col("o_orderpriority").alias("address"),
        F.col("o_orderstatus").alias("floor"),
        "o_orderkey",
    )
    return listings.select("o_orderkey", canonical.listing_key_hash(listings).alias("key_hash"))


@query(
    """SELECT conv_id, turn, 'documents' AS source_name,
      'https://example.org/documents' AS source_url, 'http_get' AS retrieval_method,
      'raw' AS parsing_status, 'v1' AS schema_version, 0 AS n_tags, 'job-1' AS job_id,
      role AS payload_role, h AS content_hash, substr(h, 1, 24) AS record_id
    FROM (SELECT *, sha256('{"conv_id": ' || conv_id || ', "role": "' || role || '", "text": ' ||
      to_json(text)::VARCHAR || ', "turn": ' || turn || '}') AS h FROM conversations)"""
)
def record_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    text = canonical.canonical_json(turns)
    batch = items(
        turns, text, canonical.content_hash(text),
        unit=F.col("conv_id"), page=F.lit(1), position=F.col("turn"),
    )
    return _envelope(batch).select(
        F.variant_get("raw_payload", "$.conv_id", "bigint").alias("conv_id"),
        F.variant_get("raw_payload", "$.turn", "bigint").alias("turn"),
        "source_name", "source_url", "retrieval_method", "parsing_status", "schema_version",
        F.array_size("tags").alias("n_tags"),
        "job_id",
        F.variant_get("raw_payload", "$.role", "string").alias("payload_role"),
        "content_hash", "record_id",
    )


@query(
    f"""SELECT content_hash, substr(content_hash, 1, 24) AS record_id, lang FROM
    (SELECT DISTINCT {DOC_HASH} AS content_hash, lang FROM documents)"""
)
def scan_raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest all documents into a new store, then scan it under every kind of predicate."""
    path = scratch_path(spark, "raw-records")
    batch = _envelope(document_items(spark, sf_dir))
    fresh = ingest.ingest_dedup(batch, None)
    sinks.append_records(fresh.drop("unit", "request_id", "page", "position"), path)
    found = store.scan_raw_records(
        spark, path, source_name="documents", parsing_status="raw", job_id="job-1",
        ingested_after=_RUN_AT, ingested_before=_RUN_AT,
    )
    lang = F.variant_get("raw_payload", "$.lang", "string").alias("lang")
    return found.select("content_hash", "record_id", lang)


@query(
    """SELECT event_id, source_name, listing_id FROM
    (SELECT *, row_number() OVER (PARTITION BY source_name, listing_id ORDER BY ts, event_id) AS rn
     FROM (SELECT event_id, ts, event_type AS source_name,
       CASE WHEN event_type <> 'error' THEN user_id::VARCHAR END AS listing_id FROM events))
    WHERE rn = 1 OR listing_id IS NULL"""
)
def first_seen_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing_id = F.when(F.col("event_type") != "error", F.col("user_id").cast("string"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("source_name"), listing_id.alias("listing_id")
    )
    fresh = dedup.first_seen_listing(rows, ["source_name"], "listing_id", ["ts", "event_id"])
    return fresh.select("event_id", "source_name", "listing_id")


@query(
    """SELECT vec_id, (i - 1)::INTEGER AS position, embedding[i]::DOUBLE AS member FROM embeddings,
    LATERAL (SELECT unnest(range(1, least(len(embedding), 50) + 1)) AS i)"""
)
def cap_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("position", "member")
    )
    return dedup.cap_per_group(members, "position", 50).withColumn(
        "member", F.col("member").cast("double")
    )


@query(f"SELECT DISTINCT {DOC_HASH} AS content_hash FROM documents")
def incremental_ingest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store_path = scratch_path(spark, "stream-store")
    documents = table(spark, sf_dir, "documents")
    # a glob, so that the table may be one file or a folder of files
    stream = spark.readStream.schema(documents.schema).parquet(
        f"{sf_dir.rstrip('/')}/documents.parquet*"
    )

    def prepare(batch: DataFrame) -> DataFrame:
        text = canonical.canonical_json(batch, ["lang", "n_chars", "text"])
        return batch.select("doc_id", "source", canonical.content_hash(text).alias("content_hash"))

    running = incremental_ingest(
        stream,
        lambda: existing_rows(spark, store_path),
        lambda fresh: fresh.write.mode("append").parquet(store_path),
        scratch_path(spark, "stream-checkpoint"),
        ["doc_id"],
        prepare,
    )
    running.awaitTermination()
    return spark.read.parquet(store_path).select("content_hash")


@query(
    """SELECT 'conversation-turns' AS source_name, h AS content_hash FROM
    (SELECT DISTINCT sha256('{"role": "' || role || '", "text": ' || to_json(text)::VARCHAR || '}')
      AS h FROM conversations)"""
)
def register_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own source goes through the shared ingest."""

    def scan(session: SparkSession, path: str) -> DataFrame:
        turns = table(session, path, "conversations")
        text = canonical.canonical_json(turns, ["role", "text"])
        return items(
            turns, text, canonical.content_hash(text),
            unit=F.col("conv_id"), page=F.lit(1), position=F.col("turn"),
        )

    source = registry.register_source("conversation_turns", scan)
    batch = _envelope(source.scan(spark, sf_dir), "conversation-turns")
    return ingest.ingest_dedup(batch, None).select("source_name", "content_hash")
