"""Price-index pages: nested month and quarter series -> one row per (series, period)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propwell.fixed import INDEX_PROVENANCE
from propwell.functions.canonical import canonical_json, content_hash
from propwell.functions.json_values import as_type, field, fields, is_empty, members
from propwell.operators.paging import page_prefix_cut, sequence_ends
from propwell.sources.items import items, with_run

_SHARED = (
    "series_code", "series_name", "period_type", "year", "percent_change",
    "percent_change_annual", "current_base", "base_description", "previous_base", "source",
)
MONTH_FIELDS = (*_SHARED, "month", "month_name_he")
QUARTER_FIELDS = (*_SHARED, "quarter", "quarterDesc")


#: Types of the typed view; rows keep every value as it was sent.
VIEW = {
    "series_code": "string", "series_name": "string", "year": "int", "percent_change": "double",
    "percent_change_annual": "double", "current_base": "double", "base_description": "string",
    "previous_base": "double", "month": "int", "month_name_he": "string", "quarter": "int", "quarterDesc": "string",
}


def _list(value: Column) -> Column:
    """Members of a list; an empty value is an empty list, anything else NULL."""
    return F.coalesce(members(value), F.when(is_empty(value), F.array().cast("array<variant>")))


def scan_index_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Adds `months` and `quarters` (series as sent, VARIANT), `next_url` and `failed`.

    A page fails when it is not a JSON object, or one of its two lists is no list.
    """
    kept = [name for name in pages.columns if name != body]
    opened = pages.select(*kept, fields(F.try_parse_json(body)).alias("_page"))
    listed = opened.select(
        *kept,
        F.col("_page").isNull().alias("_broken"),
        _list(field(F.col("_page"), "month")).alias("months"),
        _list(field(F.col("_page"), "quarter")).alias("quarters"),
        fields(field(F.col("_page"), "paging")).alias("_paging"),
    )
    return listed.select(
        *kept,
        "months",
        "quarters",
        F.nullif(as_type(field(F.col("_paging"), "next_url"), "string"), F.lit("")).alias("next_url"),
        (F.col("_broken") | F.col("months").isNull() | F.col("quarters").isNull()).alias("failed"),
    )


def flatten_index_entry(scanned: DataFrame) -> DataFrame:
    """UNION ALL of months and quarters, one row per entry, under canonical names.

    Both lists are exploded as one, series by series and entry by entry, so a page is
    parsed once. Page columns are carried; values are VARIANT, as sent. `position` is the place
    within the page, NULL on rows that empty lists leave. A series or an entry that is not what
    it should be is a row with `error`; its neighbours are not touched.
    """
    keep = [name for name in scanned.columns if name not in ("months", "quarters")]
    none = F.array().cast("array<variant>")
    months, quarters = (F.coalesce(name, none) for name in ("months", "quarters"))
    series = scanned.select(
        *keep,
        F.array_size(months).alias("_n_months"),
        F.posexplode_outer(F.concat(months, quarters)).alias("_turn", "_sent"),
    ).withColumn("_series", fields(F.col("_sent")))
    dated = series.withColumn("_dates", _list(field(F.col("_series"), "date")))
    bad_series = F.when(F.col("_sent").isNotNull() & F.col("_series").isNull(), "series is not an object").when(
        F.col("_series").isNotNull() & F.col("_dates").isNull(), "dates are not a list"
    )
    entries = dated.select(
        *keep,
        (F.col("_turn") < F.col("_n_months")).alias("_monthly"),
        "_turn",
        field(F.col("_series"), "code").alias("series_code"),
        field(F.col("_series"), "name").alias("series_name"),
        bad_series.alias("_bad_series"),
        F.posexplode_outer("_dates").alias("_at", "_sent"),
    ).withColumn("_entry", fields(F.col("_sent")))
    based = entries.withColumns({f"_{name}": field(F.col("_entry"), name) for name in ("currBase", "prevBase")})
    opened = based.withColumns({f"{name}_fields": fields(F.col(name)) for name in ("_currBase", "_prevBase")})
    bad_entry = F.when(F.col("_sent").isNotNull() & F.col("_entry").isNull(), "entry is not an object")
    for name in ("_currBase", "_prevBase"):
        bad_entry = bad_entry.when(F.col(f"{name}_fields").isNull() & ~is_empty(F.col(name)), f"{name[1:]} is not an object")
    monthly = F.col("_monthly")
    entry = lambda name: field(F.col("_entry"), name)
    return opened.select(
        *keep,
        F.coalesce("_bad_series", bad_entry).alias("error"),
        F.when(F.col("_at").isNotNull() | F.col("_bad_series").isNotNull(), F.shiftleft(F.col("_turn").cast("bigint"), 32) + F.coalesce("_at", F.lit(0))).alias("position"),
        "series_code",
        "series_name",
        F.when(monthly, "month").otherwise("quarter").alias("period_type"),
        entry("year").alias("year"),
        entry("percent").alias("percent_change"),
        entry("percentYear").alias("percent_change_annual"),
        field(F.col("_currBase_fields"), "value").alias("current_base"),
        field(F.col("_currBase_fields"), "baseDesc").alias("base_description"),
        field(F.col("_prevBase_fields"), "value").alias("previous_base"),
        F.lit(INDEX_PROVENANCE).alias("source"),
        F.when(monthly, entry("month")).alias("month"),
        F.when(monthly, entry("monthDesc")).alias("month_name_he"),
        F.when(~monthly, entry("quarter")).alias("quarter"),
        F.when(~monthly, entry("quarterDesc")).alias("quarterDesc"),
    )


def index_view(rows: DataFrame) -> DataFrame:
    """The good entries with typed values: a year sent as text is a number here."""
    typed = {name: as_type(F.col(name), dtype) for name, dtype in VIEW.items()}
    return rows.filter("error IS NULL AND position IS NOT NULL").withColumns(typed).drop("error")


def index_hash(entries: DataFrame) -> tuple[Column, Column]:
    """(payload text, hash) of the values as sent; months and quarters have different key sets."""
    text = F.when(
        F.col("period_type") == "month", canonical_json(entries, MONTH_FIELDS)
    ).otherwise(canonical_json(entries, QUARTER_FIELDS))
    return text, content_hash(text)


def scan_index_rows(pages: DataFrame) -> DataFrame:
    """Landed index pages (series id in `unit`) -> rows, before any page is cut off."""
    return flatten_index_entry(scan_index_pages(pages))


#: What a sequence of pages is asked for by: a series, once per crawl.
SEQUENCE = ["run_id", "unit"]


def _endings() -> tuple[Column, Column, Column]:
    """(server broke, sequence stops, sequence fails) of a page."""
    broken = F.coalesce(F.col("status_code") == 500, F.lit(False))
    failed = ~broken & (F.coalesce(F.col("status_code") >= 400, F.lit(False)) | F.col("failed"))
    return broken, broken | F.col("next_url").isNull(), failed


def failed_series(rows: DataFrame) -> DataFrame:
    """(run_id, unit) of the series whose pages break off with a bad one."""
    _, stop, failed = _endings()
    return sequence_ends(with_run(rows), SEQUENCE, "page", stop, failed).filter("failed").select(*SEQUENCE)


def collect_index(rows: DataFrame) -> DataFrame:
    """Rows of `scan_index_rows` -> items.

    A series ends at its first 500 or page without a successor; a series whose pages
    break off in any other way is left out of that crawl.
    """
    broken, stop, failed = _endings()
    kept = page_prefix_cut(with_run(rows), SEQUENCE, "page", stop, failed)
    entries = kept.filter(F.col("position").isNotNull() & F.col("error").isNull() & ~broken)
    text, digest = index_hash(entries)
    return items(
        entries, text, digest, unit=F.col("unit"), page=F.col("page"), position=F.col("position")
    )


def rejected_entries(rows: DataFrame) -> DataFrame:
    """(run_id, unit, page, error, n): bad members of the pages that count, by page and kind."""
    broken, stop, failed = _endings()
    kept = page_prefix_cut(with_run(rows), SEQUENCE, "page", stop, failed)
    return kept.filter(F.col("error").isNotNull() & ~broken).groupBy(*SEQUENCE, "page", "error").agg(F.count("*").alias("n"))
