"""Which hashes a large store has, without reading all of them.

Hashes of the store's files are kept apart, in generations: files in order of a 64-bit key of the hash, and
beside them a sketch, one Bloom filter of 32,768 bits per slot (leading bits of the key) and file. A batch is
joined with the sketches, which are some twelve times smaller than the hashes, and only files of which a sketch says
that they may hold one of its hashes are read. The answer is exact: those files are compared hash by hash.

The index follows from the store. `refresh` adds the store's files it has not seen, so a
writer that dies after an append leaves nothing to repair, and two writers that add the same files only
add them twice. The list of generations is a state log.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.operators.state_log import StateLog

#: Bits of a slot's filter: what one bitmap of `bitmap_construct_agg` holds.
BITS = 32_768
#: Hashes a slot is laid out for (at most; half of it at least), and bits set for each.
PER_SLOT = 2_048
PROBES = 4
#: Generations after which they are merged into one.
MOST_GENERATIONS = 16

_GENERATION = "generation STRING, level INT, n BIGINT, files ARRAY<STRING>, active BOOLEAN"
_HASHES = "slot BIGINT, content_hash STRING"
_SKETCH = "generation STRING, slot BIGINT, file STRING, bitmap BINARY"


def _slot(level: Column | int) -> Column:
    """The leading `level` bits of the hash's key; at least one."""
    shift = F.lit(64) - level
    return F.call_function("shiftrightunsigned", F.xxhash64("content_hash"), shift.cast("int"))


def _bits() -> list[Column]:
    """Where a hash sets its bits: 15 bits each of another key."""
    key = F.xxhash64("content_hash", F.lit("bits"))
    return [F.shiftright(key, 15 * i).bitwiseAND(F.lit(BITS - 1)) for i in range(PROBES)]


def _is_set(bitmap: Column, position: Column) -> Column:
    byte = F.substring(bitmap, F.shiftright(position, 3).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.call_function("shiftright", value, position.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _as_read(file: str) -> str:
    """A listed name as `_metadata.file_path` writes it: local files have one slash there."""
    return file.replace("file:///", "file:/", 1) if file.startswith("file:///") else file


@dataclass(frozen=True)
class HashIndex:
    """The hashes of a store, at `path`. Files hold some `rows_per_file` hashes each."""

    spark: SparkSession
    path: str
    rows_per_file: int = 4_000_000

    @property
    def _log(self) -> StateLog:
        return StateLog(self.spark, f"{self.path.rstrip('/')}/generations", _GENERATION, "generation")

    def _folder(self, generation: str, part: str) -> str:
        return f"{self.path.rstrip('/')}/{generation}/{part}"

    def _active(self) -> list:
        return self._log.read().filter("active").collect()

    def refresh(self, records: DataFrame) -> int:
        """Add the files of `records` (a scan of files, with `content_hash`) that are not in the index; how many.

        Which files there are comes from the listing that Spark plans the scan by.
        """
        known = {file for generation in self._active() for file in generation.files}
        new = sorted({_as_read(file) for file in records.inputFiles()} - known)
        if new:
            # by what is known, so that a name written in yet another way is read once more, not left out
            unseen = records.filter(~F.col("_metadata.file_path").isin(*known)) if known else records
            self._add(unseen.select("content_hash"), new, lambda row: row)
        if len(self._active()) > MOST_GENERATIONS:
            self.compact()
        return len(new)

    def _add(self, hashes: DataFrame, files: list[str], commit: Callable[[DataFrame], DataFrame]) -> None:
        """Write a generation: hashes in order of their key, then the sketches of what was written."""
        n = hashes.count()
        level = max(1, (max(n, 1) * 2 // PER_SLOT).bit_length())
        generation = uuid.uuid4().hex
        slotted = hashes.select(_slot(F.lit(level)).alias("slot"), "content_hash")
        parts = max(1, -(-n // self.rows_per_file))
        laid = slotted.repartitionByRange(parts, "slot", "content_hash").sortWithinPartitions("slot", "content_hash")
        laid.write.parquet(self._folder(generation, "hashes"))
        written = self.spark.read.schema(_HASHES).parquet(self._folder(generation, "hashes"))
        sketches = (
            written.select("slot", F.col("_metadata.file_name").alias("file"), F.explode(F.array(*_bits())).alias("bit"))
            .groupBy("slot", "file").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
            .select(F.lit(generation).alias("generation"), "slot", "file", "bitmap")
        )
        sketches.write.parquet(self._folder(generation, "sketches"))
        row = self.spark.createDataFrame([(generation, level, n, files, True)], _GENERATION)
        self._log.update(lambda _: commit(row))

    def compact(self) -> None:
        """Merge all generations into one; readers see the old ones or the new one."""
        old = self._active()
        if len(old) < 2:
            return
        every = self.spark.read.schema(_HASHES).parquet(*[self._folder(g.generation, "hashes") for g in old])
        gone = self.spark.createDataFrame([(g.generation, g.level, g.n, [], False) for g in old], _GENERATION)
        files = sorted({file for g in old for file in g.files})
        self._add(every.select("content_hash").distinct(), files, lambda row: row.unionByName(gone))

    def files(self) -> list[str]:
        """Every file of hashes."""
        folders = [self._folder(g.generation, "hashes") for g in self._active()]
        return self.spark.read.schema(_HASHES).parquet(*folders).inputFiles() if folders else []

    def matching(self, batch: DataFrame) -> DataFrame:
        """(content_hash) of the files that may hold a hash of `batch`: all its hashes that are stored, and others.

        The names of those files, no more than the index has, come to the driver. Null hashes match nothing.
        """
        active = self._active()
        none = self.spark.createDataFrame([], "content_hash STRING")
        if not active:
            return none
        levels = F.array(*[F.struct(F.lit(g.generation).alias("generation"), F.lit(g.level).alias("level")) for g in active])
        asked = batch.filter("content_hash IS NOT NULL").select("content_hash").distinct()
        probes = asked.withColumn("_at", F.explode(levels)).select(
            "_at.generation", _slot(F.col("_at.level")).alias("slot"), *[bit.alias(f"_bit{i}") for i, bit in enumerate(_bits())]
        )
        sketches = self.spark.read.schema(_SKETCH).parquet(*[self._folder(g.generation, "sketches") for g in active])
        found = probes.join(sketches, ["generation", "slot"])
        for i in range(PROBES):
            found = found.filter(_is_set(F.col("bitmap"), F.col(f"_bit{i}")))
        files = [f"{self._folder(r.generation, 'hashes')}/{r.file}" for r in found.select("generation", "file").distinct().collect()]
        return self.spark.read.schema(_HASHES).parquet(*sorted(files)).select("content_hash") if files else none
