"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_root: tempfile.TemporaryDirectory | None = None
_SHUFFLE_BYTES = 128 * 2**20


def shuffle_width(input_bytes: int) -> int:
    """How many partitions a shuffle of the whole input should start with."""
    return max(200, -(-input_bytes // _SHUFFLE_BYTES))


def build_session(
    app_name: str = "propwell",
    master: str | None = None,
    input_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the operators are written for.

    Name the size of the input, and shuffles start wide enough for it; AQE merges
    partitions that turn out small and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    if input_bytes is not None:
        width = str(shuffle_width(input_bytes))
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = width
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder all executors share (`spark.checkpoint.dir`).

    A machine-local folder, removed at exit, is used only by a local session that names none.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        global _local_root
        if _local_root is None:
            _local_root = tempfile.TemporaryDirectory(prefix="propwell-", ignore_cleanup_errors=True)
        root = _local_root.name
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
