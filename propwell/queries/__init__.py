"""Every registered query, with the SQL that checks it."""

from propwell.queries import (  # noqa: F401
    ingest_queries,
    layer_queries,
    record_queries,
    scalar_queries,
    source_queries,
)
from propwell.queries.base import ORACLE, QUERIES  # noqa: F401
