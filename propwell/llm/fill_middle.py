"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most FRAME_BYTES of text. Each frame
carries cumulative counts: the units (words with the white space before them, or trailing white
space), code points and bytes up to its end. To cut after unit u, the one frame in which that unit ends is found by
its count and decompressed. The output is again a list of frames: markers, new frames of
the parts that a cut frame falls into, and all other frames as they are. Digests
stream frames in order, so no step holds more than a frame of a text beside its compressed form.

One row is one document throughout; nothing is shuffled, and a lost task is run again from the store.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.llm import words as W
from propwell.llm.registry import query, table
from propwell.session import scratch_path

FRAME_BYTES = 1 << 16
LEVEL = 1
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Percent of documents that are transformed, and of those the ones with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42

FRAME = "struct<units:bigint,chars:bigint,bytes:bigint,frame:binary>"
STORE = f"doc_id bigint, marked boolean, frames array<{FRAME}>"
OUTPUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, frames array<binary>"
DIGESTS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
_FRAME = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("frame", pa.binary())])


def unit_ends(data: np.ndarray, after: int | None) -> np.ndarray:
    """Places in `data` just behind which a unit ends; `after` is the byte that follows, None at the text's end."""
    if not len(data):
        return np.zeros(0, np.int64)
    white = np.append(W.WHITE[data], True if after is None else W.WHITE[after])
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return np.append(ends, len(data)) if after is None and white[len(data) - 1] else ends


def _characters(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


def cut_frames(text: memoryview, size: int, compress) -> list[dict]:
    """The frames of one text (UTF-8); an empty text has none. Frames end between code points."""
    frames, at, units, chars = [], 0, 0, 0
    data = np.frombuffer(text, np.uint8)
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        part = data[at:end]
        units += len(unit_ends(part, int(data[end]) if end < len(data) else None))
        chars += _characters(part)
        frames.append({"units": units, "chars": chars, "bytes": end, "frame": compress(text[at:end])})
        at = end
    return frames


def _framer(size: int, markers: tuple[bytes, ...]):
    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at, held = 0, 0
            rows: list[list[dict]] = []
            marked: list[bool] = []
            for i in range(batch.num_rows):
                buffer = texts[i].as_buffer()
                view = memoryview(buffer) if buffer is not None else memoryview(b"")
                whole = np.frombuffer(view, np.uint8)
                # a marker has a closing bracket, which most texts do not have
                marked.append(bool((whole == 0x3E).any()) and any(m in buffer.to_pybytes() for m in markers))
                rows.append(cut_frames(view, size, compress))
                held += len(view)
                if held > 1 << 25 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(rows)), pa.array(marked, pa.bool_()), pa.array(rows, pa.list_(_FRAME))], ["doc_id", "marked", "frames"]
                    )
                    at, held, rows, marked = i + 1, 0, [], []

    return frame


def write_frames(documents: DataFrame, doc_id: str, text: str, path: str, size: int = FRAME_BYTES, markers: tuple[bytes, ...] = MARKERS) -> DataFrame:
    """Write the frames of every row to `path` and read them: doc_id, marked (the text has a marker), frames.

    Null texts are empty and have no frames. Repeated rows and ids, and null ids, stay as rows
    of their own. Other columns are left out. An empty table gives an empty store.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows.mapInArrow(_framer(size, markers), STORE).write.parquet(path)
    return documents.sparkSession.read.schema(STORE).parquet(path)


class FrameReader:
    """Frames of one text by unit; counts the frames that were decompressed to find a place."""

    def __init__(self, frames: list[dict], decompress):
        self.frames, self.decompress, self.opened = frames, decompress, 0
        self.units = [f["units"] for f in frames]
        self.n = self.units[-1] if frames else 0

    def place(self, unit: int) -> tuple[int, bytes, int, int]:
        """Where `unit` units end: frame, its text, bytes in it that belong to them, code points up to there."""
        if not unit:
            return 0, b"", 0, 0
        i = bisect_left(self.units, unit)
        before = self.frames[i - 1] if i else {"units": 0, "chars": 0}
        text = self.decompress(self.frames[i]["frame"])
        self.opened += 1
        data = np.frombuffer(text, np.uint8)
        # the last unit that ends in a frame may end with it, which only its count tells
        ends = unit_ends(data, 0x41)
        k = unit - before["units"] - 1
        at = int(ends[k]) if k < len(ends) else len(data)
        return i, text, at, before["chars"] + _characters(data[:at])


def split_frames(frames: list[dict], places: list[tuple[int, bytes, int, int]], compress) -> list[list[bytes]]:
    """The frames of the parts between the places, in order; only cut frames are made anew."""
    cuts = [(frame + 1, 0, b"") if text and at == len(text) else (frame, at, text) for frame, text, at, _ in places]
    parts = []
    for (i, a, left), (j, b, right) in zip([(0, 0, b""), *cuts], [*cuts, (len(frames), 0, b"")], strict=True):
        if i == j:
            parts.append([compress(right[a:b])] if b > a else [])
            continue
        head = [compress(left[a:])] if a else [frames[i]["frame"]]
        parts.append([*head, *(f["frame"] for f in frames[i + 1 : j]), *([compress(right[:b])] if b else [])])
    return parts


def transform(frames: list[dict], plain: bool, suffix_first: bool, one: int, two: int, compress, decompress) -> tuple:
    """n, form, prefix_chars, middle_chars and the output's frames; `one` and `two` are hashes for the cuts."""
    reader = FrameReader(frames, decompress)
    if plain or not frames:
        return reader.n, "plain", None, None, [f["frame"] for f in frames]
    low, high = sorted((one % (reader.n + 1), two % (reader.n + 1)))
    places = [reader.place(low), reader.place(high)]
    prefix, middle, suffix = split_frames(frames, places, compress)
    order = ((SUFFIX, suffix), (PREFIX, prefix)) if suffix_first else ((PREFIX, prefix), (SUFFIX, suffix))
    out = [f for marker, part in (*order, (MIDDLE, middle)) for f in (compress(marker), *part)]
    return reader.n, "spm" if suffix_first else "psm", places[0][3], places[1][3] - places[0][3], out


def _transformer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress, decompress = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            plain, first, one, two = (some.column(c).to_pylist() for c in ("plain", "suffix_first", "h1", "h2"))
            rows = [
                transform(some.column("frames")[i].as_py(), plain[i], first[i], one[i], two[i], compress, decompress)
                for i in range(some.num_rows)
            ]
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), *columns], ["doc_id", *schema.names])


def _hash(doc_id: Column, seed: int, group: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * group - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(store: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, frames (of the output) per row of a store.

    Cuts and form follow from hashes of the seed and the id (null as ''), so rows with equal ids are
    alike. Empty texts and texts with a marker in them stay plain.
    """
    h = [_hash(F.col("doc_id"), seed, i) for i in range(1, 5)]
    return store.select(
        "doc_id",
        "frames",
        (F.col("marked") | (h[2] % 100 >= rate)).alias("plain"),
        (h[3] % 100 < suffix_first).alias("suffix_first"),
        h[0].alias("h1"),
        h[1].alias("h2"),
    ).mapInArrow(_transformer, OUTPUT)


def read_text(frames: list[bytes], decompress) -> Iterator[bytes]:
    for frame in frames:
        yield decompress(frame)


def find_markers(frames: list[bytes], markers: tuple[bytes, ...], decompress, see) -> list[tuple[int, int]]:
    """Frame and byte where each of the markers, in that order, begins; `see` gets every frame's text.

    A marker may lie across frames.
    """
    found: list[tuple[int, int]] = []
    tail, offsets = b"", []  # the end of what came before, and where its bytes are
    for i, text in enumerate(read_text(frames, decompress)):
        see(text)
        data, at = tail + text, 0
        while len(found) < len(markers) and (hit := data.find(markers[len(found)], at)) >= 0:
            found.append(offsets[hit] if hit < len(tail) else (i, hit - len(tail)))
            at = hit + len(markers[len(found) - 1])
        keep = min(2, len(data) - at)
        cut = len(data) - keep
        offsets = [offsets[p] if p < len(tail) else (i, p - len(tail)) for p in range(cut, len(data))]
        tail = data[cut:]
    return found


def stream_part(frames: list[bytes], begin: tuple[int, int], end: tuple[int, int] | None, decompress) -> Iterator[bytes]:
    """The text from one place to another, frame by frame."""
    last = len(frames) if end is None else end[0] + (end[1] > 0)
    for i in range(begin[0], last):
        text = decompress(frames[i])
        yield text[begin[1] if i == begin[0] else 0 : end[1] if end is not None and i == end[0] else len(text)]


def _behind(frames: list[bytes], place: tuple[int, int], n: int, decompress) -> tuple[int, int]:
    """The place n bytes on."""
    i, at = place[0], place[1] + n
    while i < len(frames) and at >= (size := len(decompress(frames[i]))):
        i, at = i + 1, at - size
    return i, at


def restore(frames: list[bytes], form: str, decompress, see=lambda text: None) -> Iterator[bytes]:
    """The original text, in parts, from an output's frames and form alone."""
    if form == "plain":
        for text in read_text(frames, decompress):
            see(text)
            yield text
        return
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    found = find_markers(frames, order, decompress, see)
    begins = [_behind(frames, p, len(m), decompress) for p, m in zip(found, order, strict=True)]
    parts = dict(zip(order, zip(begins, [*found[1:], None], strict=True), strict=True))
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from stream_part(frames, *parts[marker], decompress)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decompress = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        frames, form, output, restored = batch.column("frames"), batch.column("form").to_pylist(), [], []
        for i in range(batch.num_rows):
            own = frames[i].as_py()
            whole, back = hashlib.sha256(), hashlib.sha256()
            for part in restore(own, form[i], decompress, whole.update):
                back.update(part)
            output.append(whole.hexdigest())
            restored.append(back.hexdigest())
        kept = [batch.column(c) for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(output, pa.string()), pa.array(restored, pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        )


def output_digests(transformed: DataFrame) -> DataFrame:
    """SHA-256 of each output, and of the text rebuilt from it, frame by frame."""
    return transformed.mapInArrow(_digests, DIGESTS)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decompress = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(batch.num_rows):
            text = b"".join(read_text(batch.column("frames")[i].as_py(), decompress)).decode()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("form").slice(i, 1), pa.array([text])], ["doc_id", "form", "text"])


def output_texts(transformed: DataFrame) -> DataFrame:
    """doc_id, form and the output as one text."""
    return transformed.select("doc_id", "form", "frames").mapInArrow(_texts, "doc_id bigint, form string, text string")


_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@query(
    rf"""
    WITH rows AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS units,
             sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
      FROM documents),
    hashed AS (
      SELECT doc_id, text, units, len(units) AS n,
             ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
      FROM rows),
    cut AS (
      SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
      FROM hashed),
    parts AS (
      SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle,
             array_to_string(units[high + 1:], '') AS suffix
      FROM cut)
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text
                  WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
    """
)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_frames(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", scratch_path(spark, "frames"))
    return output_digests(fill_in_middle(store))
