"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with equivalent SQL where there is one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return frame.select(*columns) if columns else frame


#: Files of a checkpoint that are written at least where there are as many partitions, and rows for each file beyond.
LEAST_FILES = 24
ROWS_PER_FILE = 100_000


def files(rows: int, per_file: int = ROWS_PER_FILE) -> int:
    """How many files so many rows are worth."""
    return max(LEAST_FILES, -(-rows // per_file))


def cut_lineage(frame: DataFrame, at_most: int | None = None) -> DataFrame:
    """The frame, written once to the shared checkpoint folder and read from there.

    Every partition is a file, an empty one too, and where Hadoop runs without its native library, as on a
    local disk, an executor starts processes for each. `at_most` files are for frames of known size and
    little work per row: their partitions are joined, which takes as many tasks less.
    """
    from propwell.session import scratch_path

    if at_most is not None:
        frame = frame.coalesce(at_most)

    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_path(frame.sparkSession, "checkpoints"))
    return frame.checkpoint(eager=True)


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from a hash of the parts' text that any SQL engine can compute.

    The first 52 bits of an MD5 digest, so that it is exact as a double. Null parts are `''`.
    """
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


#: The same in DuckDB; {} is an expression of type text.
UNIFORM_SQL = "(('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
