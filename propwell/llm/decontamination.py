"""Benchmark items in documents, found by template even when their values were changed.

Texts become templates: numbers, units after them and names (capitalised words inside a
sentence) turn into typed placeholders, other words into lower case. Windows of eight template
tokens of the benchmark are hash-joined with those of the documents. Where they meet, the values
behind the placeholders are compared along the alignment: an item's value must stand for one
value of the document throughout, and the other way round. A document is contaminated by an item
when windows so confirmed make up most of the item.

Beside the templates stand literal windows of eight words, whatever their case, and items of
fewer words, literally as a whole: `leaks` unites what these find.

All of it is DataFrame expressions. Window hashes are looked up inside each row's array first,
against a literal set (only while that set is small; it saves work and changes no result), so
that only windows known to the benchmark become rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propwell.llm.registry import query, table

WINDOW = 8
#: Words among the tokens of a window that are not placeholders, at least.
LEAST_WORDS = 4
#: Share of an item's windows that must be confirmed.
LEAST_COVERAGE = 0.6
#: Windows in a row that are a leak whatever the item's length: 20 words.
RUN = 13
#: Hashes that may be looked up as a literal set.
MOST_LITERAL = 100_000

#: Words that are units when a number stands before them.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "lb", "lbs", "pound", "pounds",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
    "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros",
    "percent", "degree", "degrees", "kmh", "mph",
)

_LETTERS = r"[\p{L}\p{M}]"
_NAME = rf"\p{{Lu}}\p{{Ll}}{_LETTERS}*+"
#: A word that begins a sentence (with what stands before it), a name, a word, a number, a sign.
TOKENS = (
    rf"(?:^|[.!?\n])[^\p{{L}}\p{{N}}]{{0,8}}+{_LETTERS}++"
    rf"|{_NAME}"
    rf"|{_LETTERS}++"
    r"|[0-9]++(?:[.,:/][0-9]++){0,8}"
    r"|[$€£¥%°]"
)


def _is_number(token: Column) -> Column:
    return token.between("0", "9~")


def _template(token: Column, before: Column) -> Column:
    lowered = F.lower(token)
    first = F.substring(lowered, 1, 1)
    begins = ~F.rlike(first, F.lit(rf"^{_LETTERS}"))
    return (
        F.when(_is_number(token), "<num>")
        .when(token.isin("$", "€", "£", "¥", "%", "°"), "<unit>")
        .when((lowered == token) & _is_number(before) & token.isin(*UNITS), "<unit>")
        .when((lowered == token) & token.between("a", "zzzz"), token)
        .when((lowered != token) & F.rlike(token, F.lit(r"^\p{Lu}\p{Ll}")), "<name>")
        .when(begins, F.regexp_extract(lowered, rf"{_LETTERS}+$", 0))
        .otherwise(lowered)
    )


def template_windows(rows: DataFrame, row_id: str, text: str, known: list[int] | None = None) -> DataFrame:
    """row_id, n_windows, at, hash, words, slots for every window of every text.

    With `known`, only windows whose hash is in it. Texts of fewer than eight tokens, empty and
    null texts have no windows. `slots` are the values behind placeholders, in order.
    """
    tokens = rows.select(
        F.col(f"`{row_id}`").alias("row_id"), F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(TOKENS), F.lit(0)).alias("tokens")
    )
    template = tokens.withColumn(
        "template",
        F.transform("tokens", lambda t, i: _template(t, F.when(i > 0, F.col("tokens")[i - 1]).otherwise(""))),
    )
    hashed = template.withColumn("hashes", F.transform("template", lambda t: F.xxhash64(t)))
    last = F.size("hashes") - WINDOW
    windows = F.when(
        last >= 0,
        F.transform(
            F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.col("hashes")[i + k] for k in range(WINDOW)])
        ),
    )
    hashed = hashed.withColumn("windows", windows).drop("hashes")
    found = F.expr(
        "filter(transform(windows, (h, i) -> "
        + ("named_struct('hash', h, 'at', i)" if known is None else f"if(h IN ({', '.join(map(str, known))}), named_struct('hash', h, 'at', i), null)")
        + "), w -> w is not null)"
    )
    hits = hashed.withColumn("hits", found)
    is_slot = lambda j: F.col("template")[j].isin("<num>", "<unit>", "<name>")
    detailed = F.transform(
        "hits",
        lambda w: F.struct(
            w["hash"].alias("hash"),
            w["at"].alias("at"),
            F.transform(
                F.filter(F.sequence(w["at"], w["at"] + (WINDOW - 1)), is_slot),
                lambda j: F.lower(F.col("tokens")[j]),
            ).alias("slots"),
        ),
    )
    # No filter here or above: it would be pushed below, with every array computed again for each element.
    rows_out = hits.select("row_id", F.size("windows").alias("n_windows"), F.explode_outer(detailed).alias("w"))
    return rows_out.where(F.col("w").isNotNull()).select(
        "row_id", "n_windows", "w.hash", "w.at", "w.slots", (WINDOW - F.size("w.slots")).alias("words")
    )


#: Words and numbers, in text of one case.
LITERAL_TOKENS = rf"{_LETTERS}++|[0-9]++(?:[.,:/][0-9]++){{0,8}}"


def _one_case(text: Column) -> Column:
    return F.lower(F.upper(F.coalesce(text, F.lit(""))))


def _known(items: DataFrame) -> list[int] | None:
    """The hashes of items as a literal set, or None where they are too many."""
    hashes = [r["hash"] for r in items.select("hash").distinct().limit(MOST_LITERAL + 1).collect()]
    return (sorted(hashes) or [0]) if len(hashes) <= MOST_LITERAL else None


def literal_windows(rows: DataFrame, row_id: str, text: str, known: list[int] | None = None) -> DataFrame:
    """row_id, n_windows, at, hash for every window of eight words of every text, in one case."""
    hashed = rows.select(
        F.col(f"`{row_id}`").alias("row_id"),
        F.regexp_extract_all(_one_case(F.col(f"`{text}`")), F.lit(LITERAL_TOKENS), F.lit(0)).alias("tokens"),
    ).withColumn("hashes", F.transform("tokens", lambda t: F.xxhash64(t)))
    last = F.size("hashes") - WINDOW
    windows = F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.col("hashes")[i + k] for k in range(WINDOW)])),
    )
    found = F.expr(
        "filter(transform(windows, (h, i) -> "
        + ("named_struct('hash', h, 'at', i)" if known is None else f"if(h IN ({', '.join(map(str, known))}), named_struct('hash', h, 'at', i), null)")
        + "), w -> w is not null)"
    )
    hits = hashed.withColumn("windows", windows).withColumn("hits", found)
    rows_out = hits.select("row_id", F.size("windows").alias("n_windows"), F.explode_outer("hits").alias("w"))
    return rows_out.where(F.col("w").isNotNull()).select("row_id", "n_windows", "w.hash", "w.at")


def literal_matches(
    documents: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item_id: str, item_text: str, least_coverage: float = LEAST_COVERAGE
) -> DataFrame:
    """doc_id, item_id, coverage where most literal windows of an item, or RUN in a row, are in a document, whatever their case."""
    items = literal_windows(benchmark, item_id, item_text).select(
        F.col("row_id").alias("item_id"),
        "hash",
        F.col("at").alias("item_at"),
        F.count(F.lit(1)).over(Window.partitionBy("row_id")).alias("item_windows"),
    )
    found = literal_windows(documents, doc_id, text, _known(items)).select(F.col("row_id").alias("doc_id"), "hash", "at")
    aligned = (
        found.join(items, "hash")
        .groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.array_sort(F.collect_set("item_at")).alias("ats"), F.first("item_windows").alias("item_windows"))
    )
    in_a_row = F.size("ats") >= RUN
    run = F.exists(F.sequence(F.lit(0), F.size("ats") - RUN), lambda i: F.col("ats")[i + (RUN - 1)] - F.col("ats")[i] == RUN - 1)
    covered = (
        aligned.withColumn("run", F.when(in_a_row, run).otherwise(False))
        .select("doc_id", "item_id", "item_windows", "run", F.explode("ats").alias("item_at"))
        .groupBy("doc_id", "item_id")
        .agg(F.countDistinct("item_at").alias("n"), F.first("item_windows").alias("item_windows"), F.max("run").alias("run"))
    )
    return covered.withColumn("coverage", F.col("n") / F.col("item_windows")).where(
        F.col("run") | (F.col("coverage") >= least_coverage)
    ).select("doc_id", "item_id", "coverage")


#: Words, numbers and every other sign but white space.
SIGNS = rf"{_LETTERS}++|[0-9]++|[^\p{{L}}\p{{M}}0-9\s\p{{Z}}]"


def short_matches(documents: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """doc_id, item_id, coverage (1) where an item of fewer than eight words is in a document as a whole, sign by sign."""
    signs = lambda c: F.regexp_extract_all(_one_case(F.col(f"`{c}`")), F.lit(SIGNS), F.lit(0))
    words = F.size(F.regexp_extract_all(_one_case(F.col(f"`{item_text}`")), F.lit(LITERAL_TOKENS), F.lit(0)))
    items = (
        benchmark.where(words < WINDOW)
        .select(F.col(f"`{item_id}`").alias("item_id"), signs(item_text).alias("signs"))
        .select("item_id", F.size("signs").alias("length"), F.xxhash64("signs").alias("hash"))
        .where("length > 0")
    )
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), signs(text).alias("signs"))
    if not lengths:
        return rows.limit(0).select("doc_id", F.lit(None).cast(benchmark.schema[item_id].dataType).alias("item_id"), F.lit(1.0).alias("coverage"))
    known = _known(items)
    among = "true" if known is None else f"h IN ({', '.join(map(str, known))})"
    hits = F.concat(
        *[
            F.expr(
                f"transform(array_distinct(filter(transform(sequence(1, greatest(1, size(signs) - {n - 1})), i -> xxhash64(slice(signs, i, {n}))),"
                f" h -> {among})), h -> named_struct('length', {n}, 'hash', h))"
            )
            for n in lengths
        ]
    )
    found = rows.withColumn("hits", hits).select("doc_id", F.explode_outer("hits").alias("w")).where(F.col("w").isNotNull())
    return found.select("doc_id", "w.length", "w.hash").join(items, ["length", "hash"]).select(
        "doc_id", "item_id", F.lit(1.0).alias("coverage")
    ).distinct()


def leaks(documents: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """One row per document and item it contains, by template or literally: doc_id, item_id,
    coverage (that of the template where it is found so)."""
    rows = documents, doc_id, text, benchmark, item_id, item_text
    found = contaminated(*rows, by_window=True).withColumn("literal", F.lit(0))
    for other in (literal_matches, short_matches):
        found = found.unionByName(other(*rows).withColumn("literal", F.lit(1)))
    return found.groupBy("doc_id", "item_id").agg(F.min_by("coverage", "literal").alias("coverage"))


def contaminated(
    documents: DataFrame,
    doc_id: str,
    text: str,
    benchmark: DataFrame,
    item_id: str,
    item_text: str,
    least_coverage: float = LEAST_COVERAGE,
    by_window: bool = False,
) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, coverage.

    Null and repeated ids are ids like others; rows that share one are taken together. Items
    of fewer than eight tokens, or mostly of placeholders, cannot be told from chance and match
    nothing. Empty tables give an empty result. Values in conflict undo the whole alignment, or
    `by_window` only the windows they are in.
    """
    items = template_windows(benchmark, item_id, item_text).where(F.col("words") >= LEAST_WORDS)
    items = items.select(
        F.col("row_id").alias("item_id"),
        F.col("at").alias("item_at"),
        F.col("slots").alias("item_slots"),
        "hash",
        F.count(F.lit(1)).over(Window.partitionBy("row_id")).alias("item_windows"),
    )
    found = template_windows(documents, doc_id, text, _known(items)).select(
        F.col("row_id").alias("doc_id"), "at", "slots", "hash"
    )
    met = found.join(items, "hash").withColumn("shift", F.col("at") - F.col("item_at"))
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    aligned = met.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("item_at").alias("ats"),
        F.first("item_windows").alias("item_windows"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
        *([F.collect_set(F.struct("item_at", pairs.alias("pairs"))).alias("wins")] if by_window else []),
    )
    count = lambda field: F.size(F.array_distinct(F.transform("pairs", lambda p: p[field])))
    agree = (count("a") == F.size("pairs")) & (count("b") == F.size("pairs"))
    if by_window:
        clash = F.expr("filter(pairs, p -> exists(pairs, q -> (p.a = q.a) != (p.b = q.b)))")
        free = F.expr("transform(filter(wins, w -> NOT exists(w.pairs, p -> array_contains(clash, p))), w -> w.item_at)")
        consistent = aligned.withColumn("clash", F.when(agree, F.slice("pairs", 1, 0)).otherwise(clash)).withColumn("ats", free)
    else:
        consistent = aligned.where(agree)
    covered = (
        consistent.select("doc_id", "item_id", "item_windows", F.explode("ats").alias("item_at"))
        .groupBy("doc_id", "item_id")
        .agg(F.countDistinct("item_at").alias("n"), F.first("item_windows").alias("item_windows"))
    )
    return covered.select("doc_id", "item_id", (F.col("n") / F.col("item_windows")).alias("coverage")).where(
        F.col("coverage") >= least_coverage
    )


#: The tokens without possessive quantifiers, which SQL's expressions lack.
_SQL_TOKENS = re.sub(r"(?<=[+*}])\+", "", TOKENS)
_SQL_UNITS = ", ".join(f"'{unit}'" for unit in UNITS)


@query(
    f"""
    WITH t AS (
        SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(coalesce(text, ''), '{_SQL_TOKENS}') AS w FROM documents
        UNION ALL SELECT 'i', item_id, regexp_extract_all(coalesce(text, ''), '{_SQL_TOKENS}') FROM benchmark
    ),
    x AS (SELECT kind, id, len(w) AS n, unnest(w) AS raw, unnest(range(len(w))) AS i FROM t),
    y AS (SELECT *, lower(raw) AS low, coalesce(lag(raw) OVER (PARTITION BY kind, id ORDER BY i), '') AS prev FROM x),
    z AS (
        SELECT *, CASE
            WHEN regexp_matches(raw, '^[0-9]') THEN '<num>'
            WHEN raw IN ('$', '€', '£', '¥', '%', '°') THEN '<unit>'
            WHEN low = raw AND regexp_matches(prev, '^[0-9]') AND raw IN ({_SQL_UNITS}) THEN '<unit>'
            WHEN low <> raw AND regexp_matches(raw, '^\\p{{Lu}}\\p{{Ll}}') THEN '<name>'
            ELSE regexp_extract(low, '[\\p{{L}}\\p{{M}}]+$') END AS tok
        FROM y
    ),
    v AS (
        SELECT kind, id, i, n - 7 AS windows, string_agg(tok, ' ') OVER o AS key,
               list(CASE WHEN tok IN ('<num>', '<unit>', '<name>') THEN low END) OVER o AS slots
        FROM z WINDOW o AS (PARTITION BY kind, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
    ),
    k AS (SELECT kind, id, i, windows, key, list_filter(slots, lambda s: s IS NOT NULL) AS slots FROM v WHERE i < windows),
    b AS (SELECT *, count(*) OVER (PARTITION BY id) AS item_windows FROM k WHERE kind = 'i' AND len(slots) <= 4),
    g AS (
        SELECT k.id AS doc_id, b.id AS item_id, k.i - b.i AS shift, b.i AS place, b.item_windows,
               list_zip(b.slots, k.slots) AS pairs
        FROM k JOIN b USING (key) WHERE k.kind = 'd'
    ),
    a AS (
        SELECT doc_id, item_id, any_value(item_windows) AS item_windows, list(DISTINCT place) AS places,
               list_distinct(flatten(list(pairs))) AS pairs
        FROM g GROUP BY doc_id, item_id, shift
    ),
    c AS (
        SELECT doc_id, item_id, count(DISTINCT place) / any_value(item_windows)::DOUBLE AS coverage
        FROM (SELECT doc_id, item_id, item_windows, unnest(places) AS place FROM a
              WHERE len(list_distinct(list_transform(pairs, lambda p: p[1]))) = len(pairs)
                AND len(list_distinct(list_transform(pairs, lambda p: p[2]))) = len(pairs))
        GROUP BY doc_id, item_id
    ),
    e AS (
        SELECT doc_id, count(*) AS n_items, max((coverage, -item_id)) AS best FROM c WHERE coverage >= 0.6 GROUP BY doc_id
    )
    SELECT d.doc_id, e.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items,
           -(best[2]) AS item_id, best[1] AS coverage
    FROM documents d LEFT JOIN e USING (doc_id)
    """
)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    found = leaks(
        documents, "doc_id", "text", table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id", "text"
    )
    best = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max(F.struct("coverage", (-F.col("item_id")).alias("item"))).alias("best"),
    )
    flagged = documents.select("doc_id").join(
        best.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left"
    )
    return flagged.select(
        "doc_id",
        F.col("best").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        (-F.col("best.item")).alias("item_id"),
        F.col("best.coverage").alias("coverage"),
    )
