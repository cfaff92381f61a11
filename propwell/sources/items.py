"""What every source hands to ingest: payload text, hash and place of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell import schema

ARRIVAL = ("unit", "request_id", "page", "position")


def items(
    df: DataFrame,
    payload_json: Column,
    content_hash: Column,
    *,
    unit: Column,
    page: Column,
    position: Column,
    request_id: Column | None = None,
    listing_id: Column | None = None,
) -> DataFrame:
    """The shared shape of collected rows, one per payload.

    (unit, request_id, page, position) is the order of arrival.
    """
    null_text = F.lit(None).cast("string")
    return df.select(
        unit.cast("string").alias("unit"),
        (null_text if request_id is None else request_id.cast("string")).alias("request_id"),
        page.cast("bigint").alias("page"),
        position.cast("bigint").alias("position"),
        payload_json.alias("payload_json"),
        content_hash.alias("content_hash"),
        (null_text if listing_id is None else listing_id).alias("listing_id"),
    )


def with_run(rows: DataFrame) -> DataFrame:
    """Rows with `run_id`, '' where the landed pages have none."""
    given = F.col("run_id") if "run_id" in rows.columns else F.lit(None)
    return rows.withColumn("run_id", F.coalesce(given.cast("string"), F.lit("")))


def read_landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """The landed responses under `path` (Parquet, `schema.LANDED_PAGE_OF_RUN`)."""
    return with_run(spark.read.schema(schema.LANDED_PAGE_OF_RUN).parquet(path))


def whole_sequences(pages: DataFrame, landed: DataFrame) -> DataFrame:
    """All landed pages of the sequences that `pages` has a page of."""
    touched = with_run(pages).select("run_id", "unit", "request_id").distinct()
    same = [landed[c].eqNullSafe(touched[c]) for c in ("unit", "request_id")]
    return landed.join(touched, [landed["run_id"] == touched["run_id"], *same], "left_semi")


def read_page_files(spark: SparkSession, path: str, suffix: str = "json") -> DataFrame:
    """Landed responses kept as `<unit>/<page>.<suffix>` files, one task per group of files."""
    files = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{suffix}")
        .text(path)
    )
    name = F.col("_metadata.file_path")
    return files.select(
        F.url_decode(F.regexp_extract(name, r"([^/]+)/[^/]+$", 1)).alias("unit"),
        F.lit(None).cast("string").alias("request_id"),
        F.regexp_extract(name, r"(\d+)\.[^./]+$", 1).try_cast("int").alias("page"),
        F.lit(200).alias("status_code"),
        F.col("value").alias("body"),
    )
