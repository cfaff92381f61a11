"""Landed payloads with their awkward shapes."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from propwell import schema
from propwell.functions.markup import with_elements
from propwell.operators.paging import listing_ends
from propwell.queries import QUERIES, source_queries
from propwell.queries.workbooks import ARCHIVE, archive, workbook
from propwell.sources import archive as archives
from propwell.sources import deals, index_pages, listings
from propwell.sources.items import read_page_files


def pages(spark, rows):
    return spark.createDataFrame(rows, schema.LANDED_PAGE)


# index pages


def index_page(year, next_url=None, **more):
    entry = {"year": year, "month": 1, "monthDesc": "ינואר", "percent": 0.5, "currBase": {"value": 101.5}, **more}
    return json.dumps(
        {"month": [{"code": "40010", "name": "x", "date": [entry]}], "quarter": None,
         "paging": {"next_url": next_url}}
    )


def test_index_sequences(spark):
    landed = pages(
        spark,
        [
            ("a", None, 1, 200, index_page(2020, "n")),
            ("a", None, 2, 200, index_page(2021)),
            ("a", None, 3, 200, index_page(2022)),  # after the last page
            ("b", None, 1, 200, index_page(2020, "n")),
            ("b", None, 2, 500, "oops"),  # ends the series, keeps page 1
            ("c", None, 1, 200, index_page(2020, "n")),
            ("c", None, 2, 403, ""),  # fails the series
            ("d", None, 1, 200, index_page(2020, "n")),
            ("d", None, 2, 200, "{not json"),  # fails the series
            ("e", None, 1, 200, index_page(2020, percent="n/a")),  # kept as it was sent
            ("f", None, 1, 200, "{}"),
        ],
    )
    found = index_pages.collect_index(index_pages.scan_index_rows(landed))
    rows = [(r.unit, r.page, json.loads(r.payload_json)) for r in found.collect()]
    assert sorted((unit, page) for unit, page, _ in rows) == [("a", 1), ("a", 2), ("b", 1), ("e", 1)]
    first = next(p for unit, page, p in rows if (unit, page) == ("a", 1))
    assert first == {
        "base_description": None, "current_base": 101.5, "month": 1, "month_name_he": "ינואר",
        "percent_change": 0.5, "percent_change_annual": None, "period_type": "month",
        "previous_base": None, "series_code": "40010", "series_name": "x", "source": "cbs", "year": 2020,
    }
    assert next(p for unit, _, p in rows if unit == "e")["percent_change"] == "n/a"


def test_index_values_and_members_are_not_lost(spark):
    entries = [{"year": "2020", "month": 1, "percent": "1.5"}, 7, {"year": "2021", "month": 1, "percent": "1.5"}, {"year": 2022, "currBase": "x"}]
    body = json.dumps({"month": [{"code": 1, "date": entries}, None, {"code": 2, "date": 5}], "quarter": [{"code": 3, "date": [{"year": 2023}]}]})
    rows = index_pages.scan_index_rows(pages(spark, [("a", None, 1, 200, body), ("b", None, 1, 200, '{"month": 3}'), ("c", None, 1, 200, "[]")]))
    found = index_pages.collect_index(rows).collect()
    payloads = [json.loads(r.payload_json) for r in sorted(found, key=lambda r: r.position)]
    assert [(p["series_code"], p["year"], p["percent_change"]) for p in payloads] == [(1, "2020", "1.5"), (1, "2021", "1.5"), (3, 2023, None)]
    assert len({r.content_hash for r in found}) == 3
    typed = index_pages.index_view(rows).filter("period_type = 'month'").orderBy("position").collect()
    assert [(r.year, r.percent_change) for r in typed] == [(2020, 1.5), (2021, 1.5)]
    rejected = {(r.unit, r.error): r.n for r in index_pages.rejected_entries(rows).collect()}
    assert rejected == {
        ("a", "series is not an object"): 1, ("a", "entry is not an object"): 1, ("a", "currBase is not an object"): 1, ("a", "dates are not a list"): 1,
    }
    assert {r.unit for r in index_pages.failed_series(rows).collect()} == {"b", "c"}


def test_quarter_keeps_its_label(spark):
    quarter = {"year": 2020, "quarter": 2, "quarterDesc": "q"}
    body = json.dumps({"quarter": [{"code": "7", "name": "y", "date": [quarter]}, {"code": "8", "date": None}]})
    found = index_pages.collect_index(index_pages.scan_index_rows(pages(spark, [("a", None, 1, 200, body)])))
    (row,) = found.collect()
    payload = json.loads(row.payload_json)
    assert payload["quarter"] == 2 and payload["quarterDesc"] == "q" and "month" not in payload


def test_page_files(spark, tmp_path):
    (tmp_path / "40010").mkdir()
    for page in (1, 2):
        (tmp_path / "40010" / f"{page}.json").write_text(index_page(2019 + page, "n" if page == 1 else None))
    landed = read_page_files(spark, str(tmp_path))
    assert sorted((r.unit, r.page) for r in landed.collect()) == [("40010", 1), ("40010", 2)]
    assert index_pages.collect_index(index_pages.scan_index_rows(landed)).count() == 2


# deals


def deal_page(*amounts, wrapped=True, **more):
    body = [{"dealAmount": amount, **more} for amount in amounts]
    return json.dumps({"data": body} if wrapped else body)


def test_deals(spark):
    place = json.dumps({"results": [{"shape": "POINT(1 2)"}]})
    places = pages(
        spark, [("x", None, 1, 200, place), ("y", None, 1, 200, place), ("z", None, 1, 200, '{"results": []}')]
    )
    polygons = pages(
        spark,
        [
            ("x", None, 1, 200, '[{"polygon_id": "1"}, {"polygonId": 2}, {"polygon_id": ""}]'),
            ("y", None, 1, 200, '[{"polygon_id": "1"}, {"polygon_id": "3"}]'),
            ("z", None, 1, 200, '[{"polygon_id": "1"}]'),
        ],
    )
    landed = pages(
        spark,
        [
            ("", "1", 1, 200, deal_page(*range(100))),
            ("", "1", 2, 200, deal_page(0, 100)),  # a short page ends the sequence
            ("", "1", 3, 200, deal_page(101)),
            ("", "2", 1, 200, deal_page(7, wrapped=False, polygonId="own")),
            ("", "2", 2, 200, deal_page(8)),
            ("", "3", 1, 404, "gone"),
        ],
    )
    found = deals.collect_deals(places, polygons, deals.scan_deal_pages(landed)).collect()
    assert {r.unit for r in found} == {"x"}  # y asks for polygon 1 too, the first city wins
    payloads = [json.loads(r.payload_json) for r in found]
    assert sorted(p["price"] for p in payloads if p["polygon_id"] == "1") == list(range(101))
    assert [p for p in payloads if p["polygon_id"] != "1"] == [
        {"polygon_id": "own", "price": 7, "source": "govmap"}
    ]


def test_deals_beside_bad_members_are_kept(spark):
    full = [{"b": i, "a": i} for i in range(98)] + ["{\"a\": 1}", None]
    landed = pages(
        spark,
        [
            ("", "1", 1, 200, json.dumps({"data": full})),
            ("", "1", 2, 200, json.dumps([{"propertyTypeDescription": "x", "dealNatureDescription": "y"}, 5])),
            ("", "0", 1, 200, json.dumps([3])),
        ],
    )
    rows = deals.scan_deal_pages(landed)
    assert {(r.request_id, r.page): r.n_on_page for r in rows.collect()} == {("1", 1): 100, ("1", 2): 2, ("0", 1): 1}
    assert not rows.filter("failed").count()
    kept = rows.filter("deal IS NOT NULL").selectExpr("page", "map_keys(deal) AS names").collect()
    assert len(kept) == 99 and all(r.names == ["b", "a"] for r in kept if r.page == 1)
    place = pages(spark, [("x", None, 1, 200, json.dumps({"results": [{"shape": "POINT(1 2)"}]}))])
    polygons = pages(spark, [("x", None, 1, 200, '[{"polygon_id": 0, "polygonId": 1}, 4, {"polygon_id": "0"}, {"polygonId": 0}]')])
    assert sorted(r.polygon_id or "-" for r in deals.scan_polygon_pages(polygons).collect()) == ["-", "-", "0", "1"]
    found = deals.collect_deals(place, polygons, rows).collect()
    assert len(found) == 99
    assert [json.loads(r.payload_json)["property_type"] for r in found if r.page == 2] == ["y"]
    rejected = {(r.unit, r.page): r.n for r in deals.rejected_deals(rows).collect()}
    assert rejected == {("1", 1): 2, ("1", 2): 1, ("0", 1): 1}


def test_city_with_bad_page_is_left_out(spark):
    place = json.dumps({"results": [{"x": 3, "lat": "4"}]})
    places = pages(spark, [("x", None, 1, 200, place), ("y", None, 1, 200, place)])
    polygons = pages(
        spark, [("x", None, 1, 200, '[{"polygon_id": "1"}]'), ("y", None, 1, 200, '[{"polygon_id": "2"}]')]
    )
    landed = pages(spark, [("", "1", 1, 200, "<html>"), ("", "2", 1, 200, deal_page(5))])
    found = deals.collect_deals(places, polygons, deals.scan_deal_pages(landed)).collect()
    assert [r.unit for r in found] == ["y"]


def test_polygon_cap_counts_members_without_id(spark):
    body = json.dumps([{"x": 1}] * 2 + [{"polygon_id": str(i)} for i in range(5)])
    place = json.dumps({"results": [{"shape": "POINT(1 2)"}]})
    asked = deals.asked_polygons(
        pages(spark, [("x", None, 1, 200, place)]), pages(spark, [("x", None, 1, 200, body)]), most=4
    )
    assert sorted(r.request_id for r in asked.collect()) == ["0", "1"]


# listings


def state_page(ids, total=0, tail=";window.b = {};</script>", **more):
    poi = [{"id": i, "price": 1250000, "address": "רחוב {1}", "beds": 3.5, **more} for i in ids]
    state = {"reduxInitialState": {"domainData": {"searchList": {"data": {"searchPoiV2": {"poi": poi, "total": total}}}}}}
    return "<script>window.__SSR_HYDRATED_CONTEXT__ =" + json.dumps(state, ensure_ascii=False) + tail


@pytest.mark.parametrize(
    "body",
    ["", "<html></html>", "window.__SSR_HYDRATED_CONTEXT__ = {broken", "window.__SSR_HYDRATED_CONTEXT__ = {}",
     'window.__SSR_HYDRATED_CONTEXT__ = {"reduxInitialState": {"domainData": null}}', state_page(["1"])[:-60]],
)
def test_unreadable_state_is_empty(spark, body):
    row = listings.scan_embedded_state(pages(spark, [("c", None, 1, 200, body)])).head()
    assert (row.poi, row.total) == ([], 0)


def test_listing_fields(spark):
    body = state_page(["9"], images=[{"imageUrl": "a"}, {"imageUrl": None}], locationPoint={"lat": 1.5, "lng": 2})
    rows = listings.scan_listing_rows(pages(spark, [("haifa", None, 1, 200, body)]))
    (found,) = listings.collect_listings(rows, F.lit(None).cast("string")).collect()
    payload = json.loads(found.payload_json)
    assert len(payload) == 25 and found.listing_id == "9"
    assert payload["price"] == 1250000 and payload["rooms"] == 3.5 and payload["lng"] == 2.0
    assert payload["address"] == "רחוב {1}" and payload["city_slug"] == "haifa"
    assert payload["image_urls"] == ["https://images2.madlan.co.il/a"]


def sequence(spark, *bodies, statuses=None):
    statuses = statuses or [200] * len(bodies)
    landed = [("c", None, i + 1, s, b) for i, (b, s) in enumerate(zip(bodies, statuses))]
    rows = listings.scan_listing_rows(pages(spark, landed))
    return sorted(int(r.listing_id) for r in listings.collect_listings(rows, F.lit(None)).collect())


def full(start):
    return [str(i) for i in range(start, start + 50)]


def test_listing_sequence_ends(spark):
    assert sequence(spark, state_page(full(0)), state_page(full(40)), state_page(["99"]), state_page(["500"])) == list(range(90)) + [99]
    # the announced total is reached by new listings only
    assert sequence(spark, state_page(full(0), 60), state_page(full(10), 60), state_page(full(100), 60)) == list(range(60))
    assert sequence(spark, state_page(full(0)), state_page([]), state_page(["7000"])) == list(range(50))
    assert sequence(spark, state_page(full(0)), state_page(["1"]), state_page(full(100)), statuses=[200, 403, 200]) == list(range(50))
    assert sequence(spark, state_page(full(0)), "", state_page(["1"]), statuses=[200, 502, 200]) == []
    assert len(sequence(spark, *[state_page(full(50 * i)) for i in range(12)])) == 600


def test_listing_window_is_bounded(spark):
    rows = listings.scan_listing_rows(pages(spark, [("c", None, 1, 200, state_page(full(0)))]))
    plan = listing_ends(rows, rows, max_pages=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "page" in plan and "<= 10" in plan


# cards and details

CARD = """<div data-testid='feed-item'><a href="/x/listing/55?a=1">go</a>
<div data-testid="price"><div>₪1,</div><div>250,000</div></div>
<span data-testid="rooms"> 3,5 חדרים </span><span data-testid="floor">קרקע</span>
<span data-testid=floor-size>85 מ"ר</span><p data-testid="address">a &amp; b<br>c</p></div>"""


def test_card(spark):
    row = listings.scan_listing_cards(spark.createDataFrame([(CARD,)], "html STRING")).head()
    assert row.asDict() == {
        "listing_id": "55", "listing_url": "/x/listing/55?a=1", "price": 1250000, "address": "a & bc",
        "rooms": 3.5, "area_sqm": 85, "floor": 0, "property_type": None, "neighborhood": None,
    }


@pytest.mark.parametrize(
    "html",
    [
        '<i data-testid="price">1</i><i data-testid="price"><b>2</b></i>',
        '<i data-testid="price"><b>2</b></i><i data-testid="price">1</i>',
        "<i data-testid='price' title='a > b'>3</i>",
        "<!-- <i data-testid='price'>4</i> --><i data-testid='price'>5</i>",
        "<script>'<i data-testid=\"price\">6</i>'</script><i class=x data-testid=price>7</i>",
        "<i data-testid='price'>&#8362;8 &lt;</i>",
        "<I DATA-TESTID='price'>9</I>",
        "<a href='/listing/1' data-testid='price'>10</a><a href=/listing/2>x</a>",
        "<a href=/listing/2>x</a><a href='/listing/1'>10</a>",
        "<i data-testid='price'>  </i>",
        "text only",
        "<i data-testid='price'>unclosed",
        "<i data-testid='prices'>11</i><i data-testid='price '>12</i>",
    ],
)
def test_native_reading_equals_parser(spark, html):
    from propwell.functions.markup import _parser_udf

    keys = {"price": "price"}
    frame = spark.createDataFrame([(html,)], "html STRING")
    native = with_elements(frame, "html", keys).head().elements
    parsed = frame.select(_parser_udf(keys)(F.col("html")).alias("e")).head().e
    assert (native.price, native.link) == (parsed.price, parsed.link)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("a &amp; b", "a & b"), ("a &amp", "a &amp"), ("&copy; &copy 1", "© &copy 1"), ("&check; &x", "&check; &x"),
     ("&#8362;5 &#8362 6", "₪5 ₪ 6"), ("R&D", "R&D"), ("&amp;lt;", "&lt;"), ("&apos;", "'")],
)
def test_references(spark, text, expected):
    frame = spark.createDataFrame([(f"<h1>{text}</h1><a href='/listing/1?a=1&copy=2'>x</a>",)], "html STRING")
    row = with_elements(frame, "html", {"h1": "h1"}, by_tag=True).head().elements
    assert (row.h1, row.link) == (expected, "/listing/1?a=1&copy=2")


# archives


def test_workbook_cells(spark):
    rows = [
        ("כותרת", 1, 1.5, True, (45296, 1), (45296.25, 1)),
        None,  # a row missing from the file
        (None, None, None, False, None, None),
    ]
    book = workbook(["FULLADRESS", "ASSETROOMNUM", "x", "y", "DEALDATE", "z"], rows)
    content = archive({"a.XLSX": book, "b.csv": b"1"})
    frame = spark.createDataFrame([("p.zip", content)], ARCHIVE)
    found = [json.loads(r.cells) for r in archives.scan_archive_sheets(frame).orderBy("row_index").collect()]
    assert found == [
        {"FULLADRESS": "כותרת", "ASSETROOMNUM": 1, "x": 1.5, "y": True,
         "DEALDATE": "2024-01-05 00:00:00", "z": "2024-01-05 06:00:00"},
        dict.fromkeys(["FULLADRESS", "ASSETROOMNUM", "x", "y", "DEALDATE", "z"]),
        {**dict.fromkeys(["FULLADRESS", "ASSETROOMNUM", "x", "DEALDATE", "z"]), "y": False},
    ]


def _sheet(rows: str, strings: str = "") -> bytes:
    """A workbook around the XML of its rows and shared strings."""
    book = workbook(["x"], [])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            text = old.read(name).decode()
            if name.endswith("sheet2.xml"):
                text = f"<x:worksheet xmlns:x='m'><x:sheetData>{rows}</x:sheetData></x:worksheet>"
            if name.endswith("sharedStrings.xml"):
                text = f"<sst>{strings}</sst>"
            new.writestr(name, text)
    return out.getvalue()


@pytest.mark.parametrize("piece", [300, 1 << 20])
def test_sheets_are_read_in_pieces(spark, monkeypatch, piece):
    """Rows and cells without places, gaps between pieces, rich and repeated shared strings, odd values."""
    monkeypatch.setattr(archives, "PIECE", piece)
    strings = "<si><t>H &amp; 1</t></si><si><r><t>ri</t></r><rPh><t>no</t></rPh><r><t xml:space='preserve'>ch </t></r></si><si/>"
    rows = "<x:row r='1'><x:c t='s'><x:v>0</x:v></x:c><x:c r='C1' t='inlineStr'><x:is><x:t>c</x:t></x:is></x:c><x:c><x:v>7</x:v></x:c></x:row>"
    expected = []
    for i in range(40):
        place = f" r='{2 + i + (i >= 20) * 3}'" if i % 10 == 0 else ""
        rows += f"<x:row{place} spans='1'><x:c t='s'><x:v>1</x:v></x:c><x:c r='C9'><x:v>00{i}.250</x:v></x:c><x:c t='e'><x:v>#N/A</x:v></x:c></x:row>"
        if i == 20:
            expected += [{"H & 1": None, "c": None, "7": None}] * 3
        expected.append({"H & 1": "rich ", "c": i + 0.25, "7": "#N/A"})
    rows += "<x:row/><x:row r='46'><x:c t='s'><x:v>2</x:v></x:c></x:row>"
    expected += [dict.fromkeys(["H & 1", "c", "7"])] * 1 + [{"H & 1": "", "c": None, "7": None}]
    content = archive({"a.xlsx": _sheet(rows, strings), "b.xlsx": workbook(["k"], [(i,) for i in range(30)])})
    late = _sheet("<x:row r='2'><x:c><x:v>1</x:v></x:c></x:row>")
    frame = spark.createDataFrame([("p.zip", content), ("q.zip", archive({"a.xlsx": workbook(["k"], [("v",)]), "late.xlsx": late}))], ARCHIVE)
    found = archives.scan_archive_sheets(frame).orderBy("path", "member", "row_index").collect()
    first = [json.loads(r.cells) for r in found if (r.path, r.member) == ("p.zip", "a.xlsx")]
    assert first == expected
    assert [r.row_index for r in found if (r.path, r.member) == ("p.zip", "a.xlsx")] == list(range(len(expected)))
    assert [json.loads(r.cells)["k"] for r in found if r.member == "b.xlsx"] == list(range(30))
    assert [(r.member, json.loads(r.cells)) for r in found if r.path == "q.zip"] == [("a.xlsx", {"k": "v"})]


def test_archive_status_and_files(spark, tmp_path):
    (tmp_path / "full.zip").write_bytes(archive({"a.xlsx": workbook(["GUSH"], [("1",)])}))
    (tmp_path / "none.zip").write_bytes(archive({"a.csv": b""}))
    (tmp_path / "bare.zip").write_bytes(archive({"a.xlsx": workbook([], [])}))
    landed = archives.read_archives(spark, str(tmp_path))
    status = archives.archive_status(landed, archives.archive_members(landed))
    found = {r.path.rsplit("/", 1)[1]: (r.n_members, r.archive_status) for r in status.collect()}
    assert found == {"full.zip": (1, "readable"), "none.zip": (0, "empty"), "bare.zip": (1, "readable")}
    collected = archives.collect_archive(archives.scan_archive_sheets(landed)).collect()
    assert [json.loads(r.payload_json) for r in collected] == [{"block": "1"}]


def test_malformed_fragments_are_read_by_themselves(spark):
    """A piece with a row or string that is no XML, or has a bad style, gives the rest as a piece without it does."""
    strings = "<si><t>h</t></si><si><t>a</b></si><si><t>last</t></si>"
    rows = (
        "<row r='1'><c t='s'><v>0</v></c></row><row r='2'><c t='s'><v>2</v></c></row><row r='3'><c><v>1</w></c></row>"
        "<row r='4'><c t='s'><v>1</v></c></row><row r='6'><c><v>9</v></c></row><row/>"
    )
    frame = spark.createDataFrame([("p.zip", archive({"a.xlsx": _sheet(rows, strings)}))], ARCHIVE)
    found = archives.scan_archive_sheets(frame).orderBy("row_index").collect()
    assert [json.loads(r.cells)["h"] for r in found] == ["last", None, "", None, 9, None]


def test_rows_without_numbers_follow_across_blocks(spark):
    rows = "<row/>" * 70 + "<row r='90'/>" + "<row/>" * 70
    piece = spark.createDataFrame([("p", "m", 0, "s", 0, rows), ("p", "m", 0, "s", 1, "<row/>")], archives.PART)
    found = [(r.before, r.number) for r in archives.numbered_rows(piece).orderBy("piece", "number").collect()]
    numbers = [*range(1, 71), *range(90, 162)]
    assert found == list(zip([0, *numbers], numbers))


def test_narrow_tables_are_dealt_before_they_grow(spark):
    assert source_queries._archives(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8
    for name in ("scan_listing_cards", "scan_listing_details"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8


def test_no_join_of_collect_deals_holds_the_deal(spark):
    def nodes(node):
        yield node
        for i in range(node.children().size()):
            yield from nodes(node.children().apply(i))

    plan = source_queries.collect_deals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    joins = [n for n in nodes(plan) if n.nodeName() == "Join"]
    assert joins
    for join in joins:
        names = [join.output().apply(i).name() for i in range(join.output().size())]
        assert "deal" not in names and "_deals" not in names
