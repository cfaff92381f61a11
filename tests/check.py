"""Spark result against SQL result: names, types, rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "JSON": "json", "FLOAT": "float",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir) / (name + '.parquet')}'"
        )
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def difference(frame, connection, sql: str) -> str | None:
    """What differs between a DataFrame and the SQL result, None when nothing does."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    ours = dict(frame.dtypes)
    theirs = {column[0]: _TYPES.get(str(column[1]), str(column[1])) for column in result.description}
    if ours != theirs:
        return "types " + str({n: (ours[n], theirs[n]) for n in ours if ours[n] != theirs[n]})
    order = sorted(names)
    place = [names.index(name) for name in order]
    expected = Counter(tuple(_cell(row[i]) for i in place) for row in result.fetchall())
    actual = Counter(
        tuple(_cell(value) for value in row) for row in frame.select(*order).collect()
    )
    if actual == expected:
        return None
    missing, extra = expected - actual, actual - expected
    return (
        f"{sum(actual.values())} rows against {sum(expected.values())}; "
        f"missing {list(missing)[:2]}, extra {list(extra)[:2]}"
    )
