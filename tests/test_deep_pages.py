"""Pages far into an order against a full sort."""

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from propwell.operators import records
from propwell.operators.deep_pages import page_at_depth

DICE = Random(11)
#: Half of all rows share one time, some have none; ids share beginnings.
ROWS = [
    (
        f"{DICE.choice(['', 'a', 'ab', 'é'])}{i}",
        datetime(2024, 5, 1) if i % 2 else datetime(2024, 1, 1) + timedelta(seconds=DICE.randrange(10**7)),
        DICE.choice([1.5, -0.0, float(i), None]),
    )
    for i in range(1500)
] + [(f"n{i}", None, None) for i in range(200)]


@pytest.fixture(scope="module")
def table(spark):
    frame = spark.createDataFrame(ROWS, "id STRING, at TIMESTAMP, n DOUBLE")
    return frame.withColumn("ntz", F.col("at").cast("timestamp_ntz")).withColumn("number", F.hash("id")).repartition(8).cache()


@pytest.mark.parametrize("sort_by,tie", [("at", "id"), ("ntz", "number"), ("n", "id"), ("id", "id")])
@pytest.mark.parametrize("descending", [True, False])
def test_every_depth(table, sort_by, tie, descending):
    def order(name):
        return F.col(name).desc() if descending else F.col(name).asc()

    want = [r.id for r in table.orderBy(order(sort_by), order(tie)).select("id").collect()]
    for offset in (0, 30, 777, 1695):
        page = page_at_depth(table, sort_by, descending, 12, offset, tie, most_skipped=25)
        assert [r.id for r in page.collect()] == want[offset : offset + 12], offset
    assert page_at_depth(table, sort_by, descending, 12, 5_000, tie, most_skipped=25).count() == 0


def test_few_rows_are_sorted(table):
    """The top-k of a page at offset 600, in the middle of equal times, skips at most 25 rows."""
    page = page_at_depth(table, "at", True, 12, 600, "id", most_skipped=25)
    text = page._jdf.queryExecution().optimizedPlan().toString()
    skipped = int(text.split("Offset ")[1].split("\n")[0])
    assert skipped <= 25


def test_cursor_walks_all_rows(table):
    rows = table.filter("at IS NOT NULL")
    want = [r.id for r in rows.orderBy(F.col("at").desc(), F.col("id").desc()).collect()]
    found, last = [], None
    while page := records.page_after(rows, last, "at", limit=500, tie="id").collect():
        found += [r.id for r in page]
        last = page[-1].asDict()
    assert found == want


def test_one_value_holds_nearly_all_rows(spark):
    """Its neighbours are many and rare; ids begin with more characters than there are ranges."""
    rows = spark.range(0, 20_300, 1, 8).select(
        F.when(F.col("id") < 20_000, 500).otherwise(F.col("id") - 19_700).alias("n"),
        F.concat(F.decode(F.unhex(F.concat(F.lit("E4"), F.hex(F.expr("184 + id div 64 % 4")), F.hex(F.col("id") % 64 + 128))), "UTF-8"), F.col("id") % 131, F.lit("-"), "id").alias("id"),
    ).cache()
    want = [tuple(r) for r in rows.orderBy("n", "id").collect()]
    for offset in (100, 9_000, 20_150, 20_295):
        page = page_at_depth(rows, "n", False, 5, offset, "id", most_skipped=50)
        assert [tuple(r) for r in page.collect()] == want[offset : offset + 5]
