"""Spreadsheet archives: ZIP files of XLSX workbooks -> one row per sheet row.

Python unpacks the parts of each workbook and cuts long ones behind rows and items; nothing else. The
pieces are spread over all tasks, and the XML is read by `from_xml`, piece by piece, or fragment by fragment
where a piece holds a malformed one. Shared strings and cell styles are joined to the cells that refer to them.
"""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propwell.functions.canonical import canonical_rename, content_hash, json_map, json_string, let, open_payload
from propwell.operators.joins import join_per_key
from propwell.operators.sinks import materialize
from propwell.operators.spread import spread
from propwell.sources.items import items

PART = "path STRING, member STRING, member_index INT, part STRING, piece BIGINT, text STRING"
BOOK = ["path", "member", "member_index"]

WORKBOOK, RELATIONS, STYLES, STRINGS = (
    "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/sharedStrings.xml",
)
#: Characters of a sheet or of shared strings that travel as one piece; it ends with a row or an item.
PIECE = 1 << 20
_PIECE_END = re.compile(r"</(?:\w+:)?(?:row|si)>")
#: Rows of a piece that are numbered in one go: an array is built anew for each row added.
_BLOCK = 64
_OTHER_PARTS = ("xl/theme/", "xl/drawings/", "xl/charts/", "xl/media/")

# fixed values: built-in number formats that show dates or times
_DATE_FORMATS = [*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)]
_FORMAT_NOISE = r'(?i)"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]'

_XML = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "attributePrefix": "_", "valueTag": "_text"}
_WORKBOOK_XML = (
    "workbookPr STRUCT<_date1904: STRING>, bookViews STRUCT<workbookView: ARRAY<STRUCT<_activeTab: INT>>>, "
    "sheets STRUCT<sheet: ARRAY<STRUCT<_id: STRING>>>"
)
_RELATIONS_XML = "Relationship ARRAY<STRUCT<_Id: STRING, _Target: STRING>>"
_STYLES_XML = (
    "numFmts STRUCT<numFmt: ARRAY<STRUCT<_numFmtId: INT, _formatCode: STRING>>>, "
    "cellXfs STRUCT<xf: ARRAY<STRUCT<_numFmtId: INT>>>"
)
_RUNS = "t STRING, r ARRAY<STRUCT<t: STRING>>"
_ROW_XML = (
    "c ARRAY<STRUCT<_r: STRING, _t: STRING, _s: INT, v: STRING, is: STRUCT<t: STRING, r: ARRAY<STRUCT<t: STRING>>>>>"
)
_MALFORMED = "_malformed"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the ZIP files under `path`. A file must be under 2 GiB."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "content")
    )


def _text_pieces(part: IO[bytes], first: int) -> Iterator[str]:
    """The text of a part, cut behind rows and items."""
    decode = codecs.getincrementaldecoder("utf-16" if first == 2 else "utf-8-sig")().decode
    held = ""
    while chunk := part.read(PIECE):
        held += decode(chunk)
        if len(held) >= PIECE:
            cut = max((m.end() for m in _PIECE_END.finditer(held)), default=0)
            if cut:
                yield held[:cut]
                held = held[cut:]
    yield held + decode(b"", True)


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [*BOOK, "part", "piece", "text"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = [n for n in archive.namelist() if n.lower().endswith(".xlsx")]
                for index, name in enumerate(names):
                    yield pd.DataFrame([(path, name, index, "", 0, None)], columns=columns)
                    with archive.open(name) as member, zipfile.ZipFile(member) as book:
                        for part in book.namelist():
                            if not part.endswith((".xml", ".rels")) or part.startswith(_OTHER_PARTS):
                                continue
                            with book.open(part) as opened:
                                wide = 2 if opened.read(2) in (b"\xff\xfe", b"\xfe\xff") else 1
                            with book.open(part) as opened:
                                if part in (WORKBOOK, RELATIONS, STYLES):
                                    pieces = ["".join(_text_pieces(opened, wide))]
                                else:
                                    pieces = _text_pieces(opened, wide)
                                for number, text in enumerate(pieces):
                                    yield pd.DataFrame([(path, name, index, part, number, text)], columns=columns)


def archive_parts(archives: DataFrame) -> DataFrame:
    """The XML parts of the workbooks of each archive, in pieces; a workbook has a row without a part, too."""
    return archives.select("path", "content").mapInPandas(_unpack, PART)


def archive_members(archives: DataFrame) -> DataFrame:
    """The workbooks of each archive, in archive order."""
    return archive_parts(archives).filter("part = ''").select(*BOOK)


def archive_status(archives: DataFrame, members: DataFrame) -> DataFrame:
    """Adds `n_members` per archive; an archive without a workbook is `empty`."""
    counts = members.groupBy("path").agg(F.count("*").alias("_n"))
    joined = archives.select("path").join(counts, "path", "left")
    n_members = F.coalesce("_n", F.lit(0).cast("bigint"))
    return joined.select(
        "path",
        n_members.alias("n_members"),
        F.when(n_members == 0, "empty").otherwise("readable").alias("archive_status"),
    )


def _matches(text: Column, tag: str) -> Column:
    """The elements of a name in a piece, as text; elements of one name do not nest here."""
    name = rf"(?:\w+:)?{tag}"
    return F.regexp_extract_all(text, F.lit(rf"(?s)<{name}(?:\s[^>]*|/)?(?:(?<=/)>|(?<!/)>.*?</{name}>)"), F.lit(0))


def _together(fragments: str, tag: str, schema: str) -> Column:
    """The elements of an array of fragments, read as one document, which costs far less than one each.

    Empty if any is malformed; they are then to be read one by one.
    """
    whole = F.concat(F.lit("<all>"), F.array_join(fragments, ""), F.lit("</all>"))
    options = {**_XML, "columnNameOfCorruptRecord": _MALFORMED}
    read = F.from_xml(whole, f"{tag} ARRAY<STRUCT<{schema}>>, {_MALFORMED} STRING", options)
    good = let(read, lambda r: F.when(r[_MALFORMED].isNull() & (F.size(r[tag]) == F.size(fragments)), r[tag]))
    return F.coalesce(good, F.array().cast(f"ARRAY<STRUCT<{schema}>>"))


def _element(entry: str, schema: str) -> Column:
    """The element of an entry (`read` of `_together`, `xml`), by itself where it was not read with the others."""
    return F.coalesce(F.col(f"{entry}.read"), F.from_xml(f"{entry}.xml", schema, _XML))


def _all_text(item: Column) -> Column:
    """Text runs of a string item; phonetic hints are not part of it."""
    runs = F.transform(F.coalesce(item["r"], F.array()), lambda r: F.coalesce(r["t"], F.lit("")))
    return F.concat(F.coalesce(item["t"], F.lit("")), F.array_join(runs, ""))


def books(parts: DataFrame) -> DataFrame:
    """One row per workbook: the part of the sheet shown first, the epoch of its dates, and which
    cell styles show dates."""
    texts = {name: F.max(F.when(F.col("part") == part, F.col("text"))) for name, part in
             (("workbook", WORKBOOK), ("relations", RELATIONS), ("styles", STYLES))}
    small = parts.filter(F.col("part").isin(WORKBOOK, RELATIONS, STYLES))
    read = small.groupBy(*BOOK).agg(*[text.alias(name) for name, text in texts.items()]).select(
        *BOOK,
        F.from_xml("workbook", _WORKBOOK_XML, _XML).alias("workbook"),
        F.from_xml("relations", _RELATIONS_XML, _XML).alias("relations"),
        F.from_xml("styles", _STYLES_XML, _XML).alias("styles"),
    )
    sheets = F.col("workbook.sheets.sheet")
    active = F.coalesce(F.get(F.col("workbook.bookViews.workbookView"), F.lit(0))["_activeTab"], F.lit(0))
    relation = F.get(sheets, F.when(active < F.size(sheets), active).otherwise(0))["_id"]
    target = F.get(F.filter(F.col("relations.Relationship"), lambda r: r["_Id"] == relation), F.lit(0))["_Target"]
    custom = F.coalesce(F.col("styles.numFmts.numFmt"), F.array().cast("array<struct<_numFmtId:int,_formatCode:string>>"))

    def shows_date(style: Column) -> Column:
        own = F.get(F.filter(custom, lambda f: f["_numFmtId"] == style), F.lit(0))["_formatCode"]
        shown = F.regexp_replace(F.coalesce(own, F.lit("")), _FORMAT_NOISE, "")
        known = F.exists(custom, lambda f: f["_numFmtId"] == style)
        return F.when(known, shown.rlike("[dmhysDMHYS]")).otherwise(style.isin(*_DATE_FORMATS))

    styles = F.coalesce(F.col("styles.cellXfs.xf"), F.array().cast("array<struct<_numFmtId:int>>"))
    return read.select(
        *BOOK,
        F.when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(F.concat(F.lit("xl/"), target)).alias("part"),
        F.coalesce(F.col("workbook.workbookPr._date1904").isin("1", "true"), F.lit(False)).alias("from_1904"),
        F.transform(styles, lambda xf: shows_date(F.coalesce(xf["_numFmtId"], F.lit(0)))).alias("dates"),
    )


def shared_strings(parts: DataFrame) -> DataFrame:
    """(path, member, at, string) of every shared string; `at` counts over the pieces of the part."""
    items = parts.filter(F.col("part") == STRINGS).select("path", "member", "piece", _matches(F.col("text"), "si").alias("items"))
    sizes = items.select("path", "member", "piece", F.size("items").cast("bigint").alias("n"))
    before = Window.partitionBy("path", "member").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("path", "member", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    read = items.join(bases, ["path", "member", "piece"]).select(
        "path", "member", "base", F.col("items").alias("xml"), _together("items", "si", _RUNS).alias("read")
    )
    # entries are made first: an array beside an exploded one would be copied for each of its rows
    placed = read.select("path", "member", "base", F.arrays_zip("xml", "read").alias("entries")).select(
        "path", "member", "base", F.posexplode("entries").alias("i", "entry")
    )
    return placed.select(
        "path", "member", (F.col("base") + F.col("i")).alias("at"), _all_text(_element("entry", _RUNS)).alias("string")
    )


def numbered_rows(pieces: DataFrame) -> DataFrame:
    """Pieces of sheets -> (path, member, member_index, piece, number, before, cells): each row with its number,
    that of the row before it, 0 for none, and its cells.

    A row without a number follows the one before; that may lie in an earlier piece, of which one small
    row is enough to know.
    """
    listed = pieces.withColumn("rows", _matches(F.col("text"), "row"))
    listed = listed.withColumn(
        "given", F.transform("rows", lambda x: F.regexp_extract(x, r"""^<[^>]*?\sr=["'](\d+)""", 1).try_cast("bigint"))
    )
    # of a piece: rows from its last given number on, or all of them
    last = F.aggregate(
        "given",
        F.struct(F.lit(None).cast("bigint").alias("number"), F.lit(0).cast("bigint").alias("n")),
        lambda a, g: F.struct(
            F.coalesce(g, a["number"] + 1).alias("number"),
            F.when(g.isNull() & a["number"].isNull(), a["n"] + 1).otherwise(a["n"]).alias("n"),
        ),
    )
    ends = listed.select("path", "member", "piece", last.alias("end")).select("path", "member", "piece", "end.number", "end.n")
    order = Window.partitionBy("path", "member").orderBy("piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = ends.withColumn("loose", F.sum(F.when(F.col("number").isNull(), F.col("n")).otherwise(0)).over(order))
    known = F.struct("number", "loose")
    carried = counted.withColumns(
        {
            "known": F.last(F.when(F.col("number").isNotNull(), known), ignorenulls=True).over(before),
            "so_far": F.coalesce(F.lag("loose").over(order), F.lit(0)),
        }
    ).select(
        "path",
        "member",
        "piece",
        (F.coalesce("known.number", F.lit(0)) + F.col("so_far") - F.coalesce("known.loose", F.lit(0))).alias("carried"),
    )
    joined = listed.join(carried, ["path", "member", "piece"])
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("given") / _BLOCK).cast("int") - 1, F.lit(0)))
    with_blocks = joined.withColumn("blocks", F.transform(at, lambda b: F.slice("given", b * _BLOCK + 1, _BLOCK)))

    def number(last: Column, given: Column) -> Column:
        return F.coalesce(given, last + 1)

    def listed_from(start: Column, steps: Column, step: Callable[[Column, Column], Column]) -> Column:
        return F.aggregate(steps, F.array(start), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))

    starts = listed_from(F.col("carried"), F.col("blocks"), lambda last, block: F.aggregate(block, last, number))
    with_starts = with_blocks.withColumn("starts", F.slice(starts, 1, F.size("blocks")))
    of_blocks = F.zip_with("starts", "blocks", lambda start, block: F.slice(listed_from(start, block, number), 2, _BLOCK))
    with_numbers = with_starts.withColumn("numbers", F.concat(F.array("carried"), F.flatten(of_blocks)))
    entries = with_numbers.select(
        *BOOK, "piece",
        F.col("rows").alias("xml"), _together("rows", "row", _ROW_XML).alias("read"),
        F.slice("numbers", F.lit(2), F.size("rows")).alias("number"), F.slice("numbers", F.lit(1), F.size("rows")).alias("before"),
    ).select(*BOOK, "piece", F.arrays_zip("xml", "read", "number", "before").alias("entries"))
    rows = entries.select(*BOOK, "piece", F.explode("entries").alias("entry"))
    return rows.select(*BOOK, "piece", "entry.number", "entry.before", _element("entry", _ROW_XML)["c"].alias("cells"))


def _column(reference: Column) -> Column:
    """0 for A, 26 for AA; NULL without letters."""
    letters = F.nullif(F.upper(F.regexp_extract(reference, "^([A-Za-z]+)", 1)), F.lit(""))
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64)) - 1


def _number_text(raw: Column) -> Column:
    """A number as JSON: whole ones as they are, others in the shortest form."""
    short = raw.try_cast("double")
    plain = F.regexp_replace(F.regexp_replace(short.cast("string").try_cast("decimal(38,16)").cast("string"), "0+$", ""), r"\.$", ".0")
    decimal = F.when(short.isNull(), json_string(raw)).when(F.abs(short).between(1e-3, 1e15), plain).otherwise(short.cast("string"))
    return F.when(raw.rlike(r"^-?\d+$"), F.regexp_replace(raw, r"^(-?)0+(?=\d)", "$1")).otherwise(decimal)


def _date_text(raw: Column, from_1904: Column) -> Column:
    """Days since the epoch as date and time, or the time alone within the first day."""
    number = raw.try_cast("double")
    millis = F.round(number * 86_400_000).cast("bigint")
    epoch = F.when(from_1904, F.lit("1904-01-01")).otherwise(F.lit("1899-12-30")).cast("timestamp_ntz")
    moment = F.substr((epoch + F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)"))).cast("string"), F.lit(1), F.lit(19))
    rest = F.pmod(millis, F.lit(1000))
    fraction = F.when(rest > 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0"), F.lit("000"))).otherwise("")
    shown = F.concat(F.when(number.between(0, 1) & (number < 1), F.substr(moment, F.lit(12))).otherwise(moment), fraction)
    return json_string(shown)


def sheet_cells(rows: DataFrame, strings: DataFrame, books: DataFrame) -> DataFrame:
    """Cells of `numbered_rows`: (path, member, member_index, number, col, value), `value` as JSON, NULL for none."""
    parsed = rows.select(*BOOK, "number", "cells")
    columns = F.aggregate(
        F.transform("cells", lambda c: _column(c["_r"])),
        F.array(F.lit(-1)),
        lambda a, x: F.concat(a, F.array(F.coalesce(x, F.element_at(a, -1) + 1))),
    )
    cells = parsed.withColumn("cols", columns).select(*BOOK, "number", "cols", F.posexplode("cells").alias("i", "cell"))
    kind = F.coalesce(F.col("cell._t"), F.lit("n"))
    cells = cells.select(
        *BOOK,
        "number",
        F.get("cols", F.col("i") + 1).alias("col"),
        kind.alias("kind"),
        F.coalesce(F.col("cell._s"), F.lit(0)).alias("style"),
        F.col("cell.v").alias("raw"),
        F.when(kind == "inlineStr", _all_text(F.col("cell.is"))).alias("inline"),
        F.when(kind == "s", F.col("cell.v").try_cast("bigint")).alias("at"),
    )
    shared = cells.filter("kind = 's'").drop("kind", "style", "raw", "inline")
    shared = shared.join(strings, ["path", "member", "at"], "left").select(
        *BOOK, "number", "col", F.when(F.col("string").isNotNull(), json_string(F.col("string"))).alias("value")
    )
    others = join_per_key(
        cells.filter("kind <> 's'"), books.select("path", "member", "from_1904", "dates"), ["path", "member"], spread_by="number"
    )
    is_date = F.coalesce(F.get("dates", "style"), F.lit(False))
    value = (
        F.when(F.col("kind") == "inlineStr", json_string(F.col("inline")))
        .when(F.col("raw").isNull(), F.lit(None))
        .when(F.col("kind") == "b", F.when(F.col("raw") == "1", "true").otherwise("false"))
        .when(F.col("kind") != "n", json_string(F.col("raw")))
        .when(is_date, _date_text(F.col("raw"), F.col("from_1904")))
        .otherwise(_number_text(F.col("raw")))
    )
    return shared.unionByName(others.select(*BOOK, "number", "col", value.alias("value")))


def scan_archive_sheets(archives: DataFrame) -> DataFrame:
    """(path, content) -> rows of the first-shown sheet of every workbook, as JSON objects in `cells`.

    Python unpacks, in pieces; sheets of any length are spread by piece. The first row has the headers; columns
    without one are left out, and of equal headers the last column wins. Rows missing
    from the file are rows of nulls. A sheet without a first row has no rows.
    """
    parts = materialize(spread(archive_parts(archives), "path", "member", "part", "piece"), "parts")
    about = materialize(books(parts), "books")
    sheets = join_per_key(parts.filter("part <> ''"), about.select("path", "member", "part"), ["path", "member", "part"], spread_by="piece", how="left_semi")
    rows = materialize(numbered_rows(sheets), "rows")
    # from files, so that both sides of the join on strings are shuffled for it and AQE splits a frequent one
    strings = materialize(shared_strings(parts), "strings")
    cells = materialize(sheet_cells(rows, strings, about).filter("value IS NOT NULL"), "cells")
    named = cells.filter("number = 1").groupBy("path", "member").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("header"))
    name = lambda h: F.when(h["value"].startswith('"'), h["value"]).otherwise(F.concat(F.lit('"'), h["value"], F.lit('"')))
    # a name's place is that of its first column, its value that of the last
    named = named.select("path", "member", F.transform("header", lambda h: F.struct(h["col"].alias("col"), name(h).alias("name"))).alias("header")).select(
        "path",
        "member",
        F.transform(
            F.array_distinct(F.transform("header", lambda h: h["name"])),
            lambda n: F.struct(n.alias("name"), F.array_max(F.transform(F.filter("header", lambda h: h["name"] == n), lambda h: h["col"])).alias("col")),
        ).alias("header"),
    )
    filled = cells.filter("number > 1").groupBy(*BOOK, "number").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("values"))
    below = F.sequence(F.greatest(F.col("before"), F.lit(1)) + 1, F.col("number"))
    numbers = rows.filter("number > 1 AND number > before").select(*BOOK, F.explode(below).alias("number"))
    lines = numbers.join(filled, [*BOOK, "number"], "left")
    told = join_per_key(lines, named, ["path", "member"], spread_by="number", how="inner")
    texts = F.transform("header", lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(F.try_element_at("values", h["col"]), F.lit("null"))))
    return told.select(*BOOK, (F.col("number") - 2).alias("row_index"), F.concat(F.lit("{"), F.array_join(texts, ", "), F.lit("}")).alias("cells"))


def collect_archive(rows: DataFrame) -> DataFrame:
    """Rows of `scan_archive_sheets` -> items under canonical names."""
    payload = canonical_rename(open_payload(F.col("cells")))
    text = rows.withColumn("payload_json", json_map(payload, T.VariantType()))
    return items(
        text,
        F.col("payload_json"),
        content_hash(F.col("payload_json")),
        unit=F.col("path"),
        request_id=F.lpad(F.col("member_index").cast("string"), 10, "0"),
        page=F.lit(1),
        position=F.col("row_index"),
    )
