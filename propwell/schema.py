"""Explicit schemas of the landed payloads and of the stored tables."""

from __future__ import annotations

# One landed response: `unit` is the thing asked for (series id, city), `request_id`
# the finer key inside it (polygon), `page` counts from 1 within (unit, request_id).
LANDED_PAGE = "unit STRING, request_id STRING, page INT, status_code INT, body STRING"
# `run_id` tells the sequences of one crawl from those of the next; folders `run_id=...`
# also let ingest bit by bit read only the runs it is about. Files without it are one run.
LANDED_PAGE_OF_RUN = f"{LANDED_PAGE}, run_id STRING"

RAW_RECORDS = (
    "record_id STRING, source_name STRING, source_url STRING, ingested_at TIMESTAMP, "
    "retrieval_method STRING, raw_payload VARIANT, parsing_status STRING, content_hash STRING, "
    "schema_version STRING, tags ARRAY<STRING>, job_id STRING, listing_id STRING"
)

JOBS = (
    "job_id STRING, source_name STRING, status STRING, created_at TIMESTAMP, "
    "started_at TIMESTAMP, completed_at TIMESTAMP, records_inserted BIGINT, "
    "records_skipped BIGINT, error_message STRING, sub_job_ids ARRAY<STRING>"
)

SOURCES = (
    "name STRING, display_name STRING, description STRING, status STRING, "
    "source_url STRING, tags ARRAY<STRING>"
)

LOGS = (
    "log_id STRING, job_id STRING, level STRING, message STRING, created_at TIMESTAMP, "
    "details MAP<STRING, STRING>"
)

LAYERS = (
    "id STRING, name STRING, type STRING, color STRING, source STRING, "
    "min_zoom DOUBLE, max_zoom DOUBLE, opacity DOUBLE"
)

GEOMETRY = "STRUCT<type: STRING, coordinates: VARIANT>"

PLACE_RESPONSE = (
    "results ARRAY<STRUCT<shape: STRING, x: STRING, lon: STRING, y: STRING, lat: STRING>>"
)

# Numbers the listing pages give in no declared type stay VARIANT.
LISTING = (
    "STRUCT<id: STRING, address: STRING, price: VARIANT, beds: VARIANT, floor: VARIANT, "
    "area: VARIANT, baths: VARIANT, buildingYear: VARIANT, buildingClass: STRING, "
    "generalCondition: STRING, dealType: STRING, type: STRING, firstTimeSeen: STRING, "
    "lastUpdated: STRING, addressDetails: STRUCT<city: STRING, neighbourhood: STRING, "
    "streetName: STRING, streetNumber: STRING, district: STRING>, "
    "locationPoint: STRUCT<lat: DOUBLE, lng: DOUBLE>, images: ARRAY<STRUCT<imageUrl: STRING>>>"
)

EMBEDDED_STATE = (
    "reduxInitialState STRUCT<domainData: STRUCT<searchList: STRUCT<data: STRUCT<"
    f"searchPoiV2: STRUCT<total: VARIANT, poi: ARRAY<{LISTING}>>>>>>"
)
