"""A small table that several writers change: an append-only log under numbered manifests.

A change writes the rows it touches, as they are afterwards, to a folder of their own, and then commits a
manifest, which names the folders of the state, under the next number. Manifests are never
overwritten: who finds the number taken reads the new state, applies the change to that and tries
again, so no change is lost. A reader sees the state of the last manifest; a writer that dies in
between leaves a folder that no manifest names. The newest row of a key counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

#: Folders of a state after which a change is followed by a compaction.
COMPACT_AFTER = 32
ATTEMPTS = 50


class StateChanged(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class StateLog:
    """The table at `path`, with `columns` (a schema in DDL) and one row per `key`."""

    spark: SparkSession
    path: str
    columns: str
    key: str

    # files

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.path.rstrip('/')}/manifest/{version:020d}.json"

    def version(self) -> int:
        """The number of the last manifest, 0 before the first."""
        place, files = self._hadoop(f"{self.path.rstrip('/')}/manifest")
        if not files.exists(place):
            return 0
        names = [status.getPath().getName() for status in files.listStatus(place)]
        return max((int(name[:20]) for name in names if name[:20].isdigit()), default=0)

    def folders(self, version: int | None = None) -> dict[str, int]:
        """The folders of a state, and the numbers they were committed under."""
        version = self.version() if version is None else version
        if not version:
            return {}
        place, files = self._hadoop(self._manifest(version))
        stream = files.open(place)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, folders: dict[str, int], version: int) -> int:
        """Name `folders` the state of the number, unless another writer has it."""
        jvm = self.spark._jvm
        target, files = self._hadoop(self._manifest(version))
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/draft/{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        files.mkdirs(target.getParent())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        never_over = self.spark.sparkContext._gateway.new_array(rename, 1)
        never_over[0] = rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, never_over)
        except (Py4JJavaError, PySparkException) as error:
            if not files.exists(target):
                raise
            raise StateChanged(f"{self.path}: {version} is taken") from error
        return version

    def _write(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        fields = self.spark.createDataFrame([], self.columns).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(f"{self.path.rstrip('/')}/data/{folder}")
        return folder

    # table

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a state, the last one by default."""
        folders = self.folders(version)
        if not folders:
            return self.spark.createDataFrame([], self.columns)
        rows = self.spark.read.schema(self.columns).parquet(*[f"{self.path.rstrip('/')}/data/{f}" for f in folders])
        if len(folders) == 1:
            return rows
        numbers = F.create_map(*[F.lit(part) for pair in folders.items() for part in pair])
        number = numbers[F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)]
        newest = rows.select(F.struct(*rows.columns).alias("row"), number.alias("number")).groupBy(F.col(f"row.{self.key}").alias("key"))
        return newest.agg(F.max_by("row", "number").alias("row")).select("row.*")

    def commit(self, rows: DataFrame, version: int) -> int:
        """Add rows, at most one per key, to the state of that number; the new number.

        Raises `StateChanged` if that is no longer the last state; nothing is changed then.
        """
        return self._commit({**self.folders(version), self._write(rows): version + 1}, version + 1)

    def update(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Commit what `change` makes of the state: the rows it touches. Applied anew if another writer comes first."""
        for _ in range(ATTEMPTS):
            version = self.version()
            try:
                done = self.commit(change(self.read(version)), version)
            except StateChanged:
                continue
            if len(self.folders(done)) > COMPACT_AFTER:
                self.compact()
            return done
        raise StateChanged(f"{self.path}: {ATTEMPTS} attempts")

    def compact(self) -> bool:
        """Write the state to one folder; False if another writer came first, which loses nothing."""
        version = self.version()
        try:
            self._commit({self._write(self.read(version)): version + 1}, version + 1)
        except StateChanged:
            return False
        return True
