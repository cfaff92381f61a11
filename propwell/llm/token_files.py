"""Token ids in Arrow stream files of equal-length sequences, and their reading.

Documents in order of their ids are tokenized, each closed by an end id, and laid end to end.
Every partition of the range of ids makes one stream file whose batches are fixed-size lists:
`ids` and `mask` (false on the padding at the file's end). All batches but the last have the
same number of sequences, hence the same size in bytes, so sequence i of a file is found by
arithmetic and is read, memory-mapped, without copying. A second stream file beside it has the
documents' places. A manifest names the files that belong to the result; a task that is run
again writes files of its own, and what a lost attempt left is named nowhere.

Equal pieces of text get equal ids, so a worker tokenizes each piece once. Pieces begin at
a space after a visible character, where the tokenizer's own pattern always divides.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propwell.llm import words as W
from propwell.llm.registry import cut_lineage, query, table
from propwell.session import scratch_path

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 256
END_ID = 2
#: Pieces, and their bytes, whose ids a worker process remembers; once full, new ones are encoded each time.
REMEMBERED = 600_000
REMEMBERED_BYTES = 1 << 25
#: Bytes of pieces that are encoded as one text.
JOINED_BYTES = 1 << 13


def _visible(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Bytes that end a character that is certainly not white space."""
    return ((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (before == 0xC3))


class PieceEncoder:
    """Ids of whole texts, each distinct piece encoded once."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        # in a byte-level vocabulary every character of a token stands for a byte
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.place: dict[int, int] = {}
        self.bytes, self.begin = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # of the pieces remembered
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and how many each has.

        Pieces that begin with a space and end visibly keep their ids when they are laid end
        to end, so they are encoded many at a time; where one ends is found by counting bytes.
        """
        plain = (data[start] == 0x20) & _visible(data[end - 1], np.where(end - start > 1, data[end - 2], 0))
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        n_plain = int(plain.sum())
        size = (end - start)[order]
        flat = data[W.ragged(start[order], size)].tobytes()
        ends = np.cumsum(size)
        joined = np.flatnonzero(np.diff(ends[:n_plain] // JOINED_BYTES, append=-1))
        cuts = np.r_[0, ends[joined], ends[n_plain:]] if n_plain else np.r_[0, ends]
        parts = self._ids([flat[a:b].decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
        ids = np.concatenate(parts) if parts else self.ids[:0]
        count = np.zeros(len(order), np.int64)
        lengths = np.array([len(x) for x in parts], np.int64)
        count[n_plain:] = lengths[len(joined) :]
        if n_plain:
            reach = np.cumsum(self.token_bytes[ids[: lengths[: len(joined)].sum()]])
            until = np.searchsorted(reach, ends[:n_plain]) + 1
            if not np.array_equal(reach[until - 1], ends[:n_plain]):
                raise ValueError("the tokenizer is not byte-level, or divides otherwise than at spaces")
            count[:n_plain] = np.diff(until, prepend=0)
        first = np.cumsum(count) - count
        back = np.argsort(order)
        return ids[W.ragged(first[back], count[back])], count[back]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and how many each has; no end id."""
        n = len(data)
        if not n:
            return self.ids[:0], np.zeros(len(offsets) - 1, np.int64)
        begins = np.zeros(n + 1, bool)
        begins[1:n] = (data[1:] == 0x20) & _visible(data[:-1], np.r_[0, data[:-2]] if n > 1 else data[:0])
        begins[offsets] = True
        start = np.flatnonzero(begins[:n])
        end = np.r_[start[1:], n]
        keys = W.word_hashes(data, start, end)
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        known = distinct.tolist()
        place = np.fromiter((self.place.get(k, -1) for k in known), np.int64, len(known))
        new = np.flatnonzero(place < 0)
        place[new] = len(self.count) + np.arange(len(new))
        first, last = start[at[new]], end[at[new]]
        got, counts = self._encode_pieces(data, first, last)
        own = data[W.ragged(first, last - first)]
        begin = np.r_[self.begin, self.begin[-1] + np.cumsum(last - first)]
        held, count, ids = np.r_[self.bytes, own], np.r_[self.count, counts], np.r_[self.ids, got]
        if len(self.place) + len(new) <= REMEMBERED and len(held) <= REMEMBERED_BYTES:
            self.place.update(zip(distinct[new].tolist(), place[new].tolist(), strict=True))
            self.bytes, self.begin, self.count, self.ids = held, begin, count, ids
        place = place[back]
        same = (np.diff(begin)[place] == end - start) & W.same_bytes(data, start, end, held, begin[place])
        odd = np.flatnonzero(~same)
        if len(odd):  # equal hashes of unequal pieces
            got, counts = self._encode_pieces(data, start[odd], end[odd])
            place[odd] = len(count) + np.arange(len(odd))
            count, ids = np.r_[count, counts], np.r_[ids, got]
        first = np.cumsum(count) - count
        sizes = count[place]
        total = np.r_[0, np.cumsum(sizes)][np.searchsorted(start, offsets)]
        return ids[W.ragged(first[place], sizes)], np.diff(total)


def worker_encoder(tokenizer_path: str) -> PieceEncoder:
    """The encoder of this worker process, which tasks after each other share."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_propwell_encoders", {})
    if tokenizer_path not in kept:
        kept[tokenizer_path] = PieceEncoder(tokenizer_path)
    return kept[tokenizer_path]


def sequence_schema(dtype: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))])


PLACES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "part bigint, path string, places_path string, n_docs bigint, n_tokens bigint, first_batch bigint, batch_bytes bigint"


class SequenceWriter:
    """One stream file of equal-length sequences, filled from ids end to end."""

    def __init__(self, sink, dtype: np.dtype, length: int, per_batch: int):
        self.sink, self.length, self.size = sink, length, length * per_batch
        self.dtype = pa.from_numpy_dtype(dtype)
        self.stream = ipc.new_stream(sink, sequence_schema(self.dtype, length))
        self.waiting: list[np.ndarray] = []
        self.held = 0
        # the stream begins with its schema, written along with the first batch
        self.first_batch, self.batch_bytes = sequence_schema(self.dtype, length).serialize().size, 0

    def put(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.size * self.size
            for at in range(0, whole, self.size):
                self._write(flat[at : at + self.size], self.size)
            self.waiting, self.held = [flat[whole:].copy()], len(flat) - whole

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(flat, self.dtype), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, ["ids", "mask"]))
        if not self.batch_bytes:
            self.batch_bytes = self.sink.tell() - self.first_batch

    def close(self) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0)
        if len(flat):
            full = -(-len(flat) // self.length) * self.length
            self._write(np.r_[flat, np.zeros(full - len(flat), flat.dtype)], len(flat))
        self.stream.close()


def _writer(folder: str, tokenizer_path: str, end_id: int, length: int, per_batch: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        encoder, n_docs, n_tokens, writer, places = worker_encoder(tokenizer_path), 0, 0, None, None
        with store.open_output_stream(f"{name}.tokens.arrows") as sink, store.open_output_stream(f"{name}.places.arrows") as other:
            writer = SequenceWriter(sink, encoder.dtype, length, per_batch)
            places = ipc.new_stream(other, PLACES)
            for batch in batches:
                for first, end, data, offsets in W.pieces(batch.column("text")):
                    ids, count = encoder.encode(data, offsets)
                    closed = np.full(len(ids) + len(count), end_id, encoder.dtype)
                    closed[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                    writer.put(closed)
                    count = count + 1
                    places.write_batch(
                        pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").slice(first, end - first), pa.array(n_tokens + np.cumsum(count) - count), pa.array(count)],
                            schema=PLACES,
                        )
                    )
                    n_docs, n_tokens = n_docs + len(count), n_tokens + int(count.sum())
            writer.close()
            places.close()
        if n_docs:
            scheme = folder[: -len(root)] if folder.endswith(root) else ""
            values = (part, f"{scheme}{name}.tokens.arrows", f"{scheme}{name}.places.arrows", n_docs, n_tokens, writer.first_batch, writer.batch_bytes)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["part", "path", "places_path", "n_docs", "n_tokens", "first_batch", "batch_bytes"])

    return write


def write_token_files(
    documents: DataFrame,
    doc_id: str,
    text: str,
    folder: str,
    tokenizer_path: str,
    end_id: int = END_ID,
    length: int = SEQUENCE,
    per_batch: int = SEQUENCES_PER_BATCH,
) -> DataFrame:
    """Write `folder`; the manifest: one row per file, with `start`, the ids in files before it.

    Null texts are empty and give an end id alone. Null ids come first; rows that share an id
    follow each other by text. An empty table makes no files.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text")
    files = cut_lineage(ordered.mapInArrow(_writer(folder, tokenizer_path, end_id, length, per_batch), MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("bigint")))


def _open(path: str):
    store, at = fs.FileSystem.from_uri(path)
    return pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)


def sequence_at(path: str, first_batch: int, batch_bytes: int, i: int, per_batch: int = SEQUENCES_PER_BATCH) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence i of a file, by seeking to its batch."""
    with _open(path) as source:
        schema = ipc.open_stream(source).schema
        source.seek(first_batch + i // per_batch * batch_bytes)
        batch = ipc.read_record_batch(ipc.read_message(source), schema)
        ids, mask = batch.column("ids")[i % per_batch].values, batch.column("mask")[i % per_batch].values
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_documents(path: str, places_path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of places, and the ids of each document in them, from one pair of files."""
    with _open(path) as source, _open(places_path) as other:
        stream = ipc.open_stream(source)
        held, begin = np.zeros(0, np.uint16), 0
        for places in ipc.open_stream(other):
            if not places.num_rows:
                continue
            start, count = places.column("start").to_numpy(), places.column("n_tokens").to_numpy()
            held, begin = held[start[0] - begin :], start[0]
            parts, have = [held], len(held)
            while have < start[-1] + count[-1] - begin:
                batch = stream.read_next_batch()
                ids = batch.column("ids").flatten().to_numpy()
                used = ids[batch.column("mask").flatten().to_numpy(zero_copy_only=False)]
                parts.append(used)
                have += len(used)
            held = np.concatenate([p for p in parts if len(p)]) if have else held
            yield places, [held[s - begin : s - begin + c] for s, c in zip(start.tolist(), count.tolist(), strict=True)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, places_path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "places_path", "start")), strict=True):
            for places, documents in read_documents(path, places_path):
                sums = [zlib.crc32(ids.astype("<u4")) for ids in documents]
                yield pa.RecordBatch.from_arrays(
                    [places.column("doc_id"), pa.array(places.column("start").to_numpy() + base), places.column("n_tokens"), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def token_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, read back from the files of a manifest.

    A manifest row is small and its file large, so rows are dealt out by number, not by size.
    """
    return (
        manifest.select("path", "places_path", "start")
        .repartition(max(1, manifest.count()), "path")
        .mapInArrow(_digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        "doc_id",
        "text",
        scratch_path(spark, "tokens"),
        public_tokenizers.path("byte_bpe_50k.json"),
    )
    return token_digests(manifest)
