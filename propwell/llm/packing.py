"""Packing by minimum bin slack over a histogram of remaining lengths.

Documents become token ids, cut into full windows and one remainder each. What is packed are not
the pieces but their lengths: a histogram of at most as many entries as a window has tokens,
whatever the size of the corpus. While some are left, the longest length seeds a window, and a subset-sum over
the others (a bitset of reachable sums, one shift per power-of-two share of each count) finds the
multiset that fills it closest to capacity; the bitsets before each shift are kept, so the
counts are backtracked from the best sum. The pattern found is used as often as the counts
allow, which uses up a length, so there are no more patterns than lengths.

A window that would stay emptier than MOST_SLACK ends this; what is left is laid end to end and cut at every window, and
the last, partial window is cut into powers of two, which need no padding.

The n-th piece of a length has a known place then: its rank among all pieces of the length is the
number in tasks before its own, by a running sum over one row per task and length, and its
place in its task. Ids are written once, joined with those sums, and shuffled once to their sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propwell.llm import words as W
from propwell.llm.registry import cut_lineage, query, table

CAPACITY = 4096
END_ID = 2
#: Tokens of padding that a window may have and still count as filled.
MOST_SLACK = 4
#: Words, and their bytes, whose ids a worker process remembers; once full, new ones are encoded each time.
REMEMBERED = 600_000
REMEMBERED_BYTES = 1 << 25
#: Words that are encoded as one text.
JOINED = 512
#: Bytes of text that are worked through at a time: numpy needs some 60 times that, in each worker process.
PIECE_BYTES = 1 << 19

PIECES = "part bigint, length int, nth bigint, doc_id bigint, start bigint, doc_tokens bigint, ids binary"
PLACED = "sequence_id bigint, offset bigint, doc_id bigint, start bigint, doc_tokens bigint, ids binary"
SEQUENCES = "sequence_id bigint, n_tokens bigint, ids array<int>, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"
DIGESTS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


#: Kinds of ASCII characters: letters 1, digits 2, others 0.
_KIND = np.array([1 if chr(i).isalpha() and i < 128 else 2 if 0x30 <= i <= 0x39 else 0 for i in range(256)], np.uint8)
_LOWER = np.array([i + 32 if 0x41 <= i <= 0x5A else i for i in range(256)], np.uint8)
#: Words with such a byte stay as they are: beyond ASCII, or part of a special token.
_ODD = np.array([i >= 128 or i == 0x7C for i in range(256)])
#: Bytes of words that may be several parts for the tokenizer, or none: control characters, apostrophes, beyond ASCII.
_JOINED = np.array([not 0x20 < i < 0x7F or i == 0x27 for i in range(256)])


def atoms(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start and end of the parts that words fall into.

    The tokenizer lower-cases, and divides where letters, digits and other characters meet, but
    for an apostrophe before a letter; so do these parts in words of ASCII alone.
    """
    odd = np.r_[0, np.cumsum(_ODD[data])]
    plain = odd[end] == odd[start]
    change = np.zeros(len(data) + 1, np.int8)
    change[start[plain]] += 1
    change[end[plain]] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = inside[1:] & inside[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~((data[:-1] == 0x27) & (kind[1:] == 1))
    cut[start] = True
    begin = np.flatnonzero(cut)
    until = np.r_[begin[1:], len(data)]
    return np.where(inside, _LOWER[data], data), begin, np.minimum(until, end[np.searchsorted(start, begin, "right") - 1])


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """`held` with `more` behind its first `used` entries; its room doubles when it is full."""
    if used + len(more) > len(held):
        held = np.concatenate([held[:used], np.empty(max(used, len(more)) + len(more), held.dtype)])
    held[used : used + len(more)] = more
    return held


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and case, each distinct part of a word encoded once."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)], bool)
        bar = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else -1
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in order of the keys
        # of the first `n` words: where bytes and ids begin, with an end; rooms of these arrays are larger
        self.n = 0
        self.bytes, self.begin = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.first = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, end to end, and how many each has.

        Words of ASCII without an apostrophe are one part for the tokenizer, so many make a text whose parts
        are those words, each closed by an id with the suffix. Others are told apart by a bar between them, but for
        those that have one; these, and words whose ids cannot be told apart so, are given one by one.
        """
        marks = np.zeros((2, len(data) + 1), np.int32)
        np.cumsum(_JOINED[data], out=marks[0, 1:])
        np.cumsum(data == 0x7C, out=marks[1, 1:])
        kind = np.where(marks[1, end] > marks[1, start], 2, (marks[0, end] > marks[0, start]).astype(np.int8))
        order = np.argsort(kind, kind="stable")
        bounds = np.searchsorted(kind[order], np.arange(4)).tolist()
        parts, counts = [self.ids[:0]], [np.zeros(0, np.int64)]
        for how, between in ((0, b" "), (1, b" | "), (2, b"\n")):
            for at in range(bounds[how], bounds[how + 1], JOINED):
                some = order[at : min(at + JOINED, bounds[how + 1])]
                size = end[some] - start[some]
                text = np.resize(np.frombuffer(between, np.uint8), (len(some), len(between)))
                ends = np.cumsum(size + len(between))
                flat = np.empty(int(ends[-1]), np.uint8)
                flat[W.ragged(ends - size - len(between), size)] = data[W.ragged(start[some], size)]
                flat[W.ragged(ends - len(between), np.full(len(some), len(between)))] = text.ravel()
                for ids, count in self._encode_joined(flat[: ends[-1] - len(between)].tobytes().decode(), how, len(some), between.decode()):
                    parts.append(ids)
                    counts.append(count)
        ids, count = np.concatenate(parts), np.concatenate(counts)
        first, back = np.cumsum(count) - count, np.argsort(order)
        return ids[W.ragged(first[back], count[back])], count[back]

    def _encode_joined(self, text: str, how: int, n: int, between: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the n words that `between` parts, and how many each has."""
        if how < 2:
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            if how == 0:
                close = np.flatnonzero(self.closes[ids])
                if len(close) == n and close[-1] == len(ids) - 1:
                    yield ids, np.diff(close, prepend=-1)
                    return
            else:
                bars = ids == self.bar
                at = np.flatnonzero(bars)
                if len(at) == n - 1:
                    yield ids[~bars], np.diff(at, prepend=-1, append=len(ids)) - 1
                    return
        made = self.tokenizer.encode(text.split(between), is_pretokenized=True, add_special_tokens=False)
        yield np.array(made.ids, self.dtype), np.bincount(np.array(made.word_ids, np.int64), minlength=n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and how many each has; no end id."""
        start, end, rows = W.spans(data, offsets)
        if not len(start):
            return self.ids[:0], np.zeros(len(offsets) - 1, np.int64)
        whole = start
        data, start, end = atoms(data, start, end)
        rows = np.r_[np.searchsorted(start, whole), len(start)][rows]
        keys = W.word_hashes(data, start, end)
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if self.n > REMEMBERED or self.begin[self.n] > REMEMBERED_BYTES:
            self._forget()
        near = np.searchsorted(self.keys, distinct)
        known = near < len(self.keys)
        known[known] = self.keys[near[known]] == distinct[known]
        new = np.flatnonzero(~known)
        if len(new):
            numbers = self.n + np.arange(len(new), dtype=np.int32)
            self._remember(data, start[at[new]], end[at[new]])
            self.keys, self.place = np.insert(self.keys, near[new], distinct[new]), np.insert(self.place, near[new], numbers)
        place = self.place[np.searchsorted(self.keys, distinct)][back]
        begin = self.begin[place]
        same = (self.begin[place + 1] - begin == end - start) & W.same_bytes(data, start, end, self.bytes[: self.begin[self.n]], begin)
        odd = np.flatnonzero(~same)
        if len(odd):  # equal hashes of unequal words: remembered without a key
            place[odd] = self.n + np.arange(len(odd))
            self._remember(data, start[odd], end[odd])
        first = self.first[place]
        sizes = self.first[place + 1] - first
        return self.ids[W.ragged(first, sizes)], np.diff(np.r_[0, np.cumsum(sizes)][rows])

    def _remember(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        got, counts = self._encode_words(data, start, end)
        n, size = self.n, end - start
        self.bytes = _grown(self.bytes, self.begin[n], data[W.ragged(start, size)])
        self.ids = _grown(self.ids, self.first[n], got)
        self.begin = _grown(self.begin, n + 1, self.begin[n] + np.cumsum(size))
        self.first = _grown(self.first, n + 1, self.first[n] + np.cumsum(counts))
        self.n = n + len(size)


def worker_encoder(tokenizer_path: str) -> WordEncoder:
    """The encoder of this worker process, which tasks after each other share."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_propwell_word_encoders", {})
    if tokenizer_path not in kept:
        kept[tokenizer_path] = WordEncoder(tokenizer_path)
    return kept[tokenizer_path]


def _cutter(tokenizer_path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_encoder(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far
        for batch in batches:
            doc_id, waiting = batch.column("doc_id"), []
            for first, end, data, offsets, more in W.slices(batch.column("text"), PIECE_BYTES):
                ids, count = encoder.encode(data, offsets)
                if more or waiting:  # parts of one long row
                    waiting.append(ids)
                    if more:
                        continue
                    ids, waiting = np.concatenate(waiting), []
                    count = np.array([len(ids)])
                closed = np.full(len(ids) + len(count), end_id, encoder.dtype)
                closed[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                count = count + 1
                n = -(-count // capacity)
                row = np.repeat(np.arange(len(count)), n)
                start = W.ragged(np.zeros(len(count), np.int64), n) * capacity
                length = np.minimum(count[row] - start, capacity)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                run = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(run, np.diff(np.r_[run, len(length)])) + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                at = np.r_[0, np.cumsum(length)] * encoder.dtype.itemsize
                raw = pa.py_buffer(closed)
                for a, b in _runs(at, 1 << 22):
                    own = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at[a : b + 1] - at[a]).astype(np.int32)), raw.slice(at[a], at[b] - at[a])])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(b - a, part)),
                            pa.array(length[a:b].astype(np.int32)),
                            pa.array(nth[a:b]),
                            doc_id.slice(first, end - first).take(pa.array(row[a:b])),
                            pa.array(start[a:b]),
                            pa.array(count[row[a:b]]),
                            own,
                        ],
                        ["part", "length", "nth", "doc_id", "start", "doc_tokens", "ids"],
                    )

    return cut


def _runs(at: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of entries of at most `limit` bytes, given where each begins."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        yield a, b
        a = b


def fill_window(lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum of up to `room` that lengths can have, each at most as often as it is there, and how often each is taken.

    Bit s of `reach` says that s can be reached. A count is cut into shares of 1, 2, 4, ... so
    that each costs a shift; stops as soon as the room is filled exactly.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        left, share = min(counts[length], room // length if length <= room else 0), 1
        while left:
            share = min(share, left)
            steps.append((length, share, reach))
            reach |= (reach << (share * length)) & mask
            left, share = left - share, share * 2
        if reach >> room & 1:
            break
    best = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, share, before in reversed(steps):
        if not before >> at & 1:
            at -= length * share
            taken[length] = taken.get(length, 0) + share
    return best, taken


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY, most_slack: int = MOST_SLACK) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Patterns (times used, how often each length is in it), and the counts that are left over."""
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c}
    patterns = []
    while left:
        lengths = list(left)
        longest = lengths[0]
        left[longest] -= 1
        best, taken = fill_window(lengths, left, capacity - longest)
        left[longest] += 1
        if capacity - longest - best > most_slack:
            break
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[n] // k for n, k in taken.items())
        patterns.append((times, taken))
        for n, k in taken.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return patterns, left


class Layout:
    """Where the piece of a given length and rank goes: rows of a table by (length, rank), searched by halving."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, most_slack: int = MOST_SLACK):
        patterns, left = pack_lengths(histogram, capacity, most_slack)
        self.capacity = capacity
        rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first window, pieces a window, offset
        used = dict.fromkeys(histogram, 0)
        self.windows = 0
        for times, taken in patterns:
            offset = 0
            for length, k in taken.items():
                rows.append((length, used[length], self.windows, k, offset))
                used[length] += times * k
                offset += length * k
            self.windows += times
        # the rest end to end from the first free window on: `k` is 0, and `offset` the place
        self.tail = 0
        for length, count in left.items():
            rows.append((length, used[length], 0, 0, self.tail))
            self.tail += length * count
        self.rows = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """piece, begin within it, length, sequence, offset: a row for each part of each piece."""
        shift = np.int64(1) << 48
        at = np.searchsorted(self.rows[:, 0] * shift + self.rows[:, 1], length.astype(np.int64) * shift + rank, "right") - 1
        _, first, window, k, offset = self.rows[at].T
        j = rank - first
        whole = k > 0
        piece = np.flatnonzero(whole)
        out = [
            (
                piece,
                np.zeros(len(piece), np.int64),
                length[piece].astype(np.int64),
                window[piece] + j[piece] // k[piece],
                offset[piece] + j[piece] % k[piece] * length[piece],
            )
        ]
        for i in np.flatnonzero(~whole).tolist():
            begin = int(offset[i] + j[i] * length[i])
            out.append(self._parts(i, begin, begin + int(length[i])))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def cuts(self) -> list[int]:
        """Ends of the sequences within the last, partial window of the rest."""
        at, ends = self.tail - self.tail % self.capacity, []
        for bit in reversed(range(self.capacity.bit_length())):
            if self.tail % self.capacity >> bit & 1:
                at += 1 << bit
                ends.append(at)
        return ends

    def _parts(self, piece: int, begin: int, end: int) -> tuple[np.ndarray, ...]:
        full = self.tail // self.capacity
        ends = [self.capacity * (w + 1) for w in range(begin // self.capacity, min(full, -(-end // self.capacity)))] + self.cuts()
        parts, at = [], begin
        for stop in ends:
            if stop <= at:
                continue
            upto = min(stop, end)
            if at < full * self.capacity:
                number, origin = at // self.capacity, at // self.capacity * self.capacity
            else:
                place = self.cuts().index(stop)
                number, origin = full + place, (self.cuts()[place - 1] if place else full * self.capacity)
            parts.append((piece, at - begin, upto - at, self.windows + number, at - origin))
            at = upto
            if at == end:
                break
        return tuple(np.array(c, np.int64) for c in zip(*parts, strict=True))


def _placer(layout, item: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Layout = layout.value
        for batch in batches:
            length, rank, start = (batch.column(c).to_numpy() for c in ("length", "rank", "start"))
            piece, begin, size, sequence, offset = own.place(length, rank)
            ids = batch.column("ids")
            cut = np.flatnonzero(size < length[piece])
            parts = ids.take(pa.array(piece))
            if len(cut):
                raw = [ids[i].as_py()[a * item : b * item] for i, a, b in zip(piece[cut].tolist(), begin[cut].tolist(), (begin + size)[cut].tolist(), strict=True)]
                mask = np.zeros(len(piece), bool)
                mask[cut] = True
                parts = pc.replace_with_mask(parts, pa.array(mask), pa.array(raw, pa.binary()))
            take = pa.array(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sequence), pa.array(offset), batch.column("doc_id").take(take), pa.array(start[piece] + begin), batch.column("doc_tokens").take(take), parts],
                ["sequence_id", "offset", "doc_id", "start", "doc_tokens", "ids"],
            )

    return place


_PIECE = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "offset")])


def _builder(capacity: int, pad_id: int, dtype: np.dtype):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (sequence_id, offset) -> sequences, padded."""
        held: pa.RecordBatch | None = None

        def sequences(rows: pa.RecordBatch) -> pa.RecordBatch:
            number = rows.column("sequence_id").to_numpy()
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            bounds = np.r_[first, len(number)]
            raw = rows.column("ids")
            at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            data = np.frombuffer(raw.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype)
            size = np.diff(at) // dtype.itemsize
            used = np.add.reduceat(size, first)
            exact = (used & (used - 1)) == 0
            full = np.where(exact, used, capacity)
            ids = np.full(int(full.sum()), pad_id, np.int32)
            ids[W.ragged(np.cumsum(full) - full, used)] = data
            parts = [rows.column(c) for c in ("doc_id", "start")] + [pa.array(size)] + [rows.column(c) for c in ("doc_tokens", "offset")]
            pieces = pa.StructArray.from_arrays(parts, fields=list(_PIECE))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(number[first]),
                    pa.array(used),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full)].astype(np.int32)), pa.array(ids)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pieces),
                ],
                ["sequence_id", "n_tokens", "ids", "pieces"],
            )

        for batch in batches:
            if held is not None and held.num_rows:
                batch = pa.concat_batches([held, batch])
            number = batch.column("sequence_id").to_numpy()
            if not len(number):
                continue
            whole = int(np.searchsorted(number, number[-1]))  # the last sequence may go on
            if whole:
                for at in range(0, whole, 1024):  # batches of bounded size, cut between sequences
                    a = 0 if not at else int(np.searchsorted(number, number[at], "left"))
                    b = whole if at + 1024 >= whole else int(np.searchsorted(number, number[at + 1024], "left"))
                    if b > a:
                        yield sequences(batch.slice(a, b - a))
            held = batch.slice(whole)
        if held is not None and held.num_rows:
            yield sequences(held)

    return build


def pack(documents: DataFrame, doc_id: str, text: str, tokenizer_path: str, end_id: int = END_ID, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids (padded to capacity, except at a power of two) and pieces per sequence.

    A piece says which document it is from (doc_id, doc_tokens), which of its ids it holds (start,
    length) and where (offset). Null texts are empty and give an end id alone. Rows that share
    an id, or have none, are documents of their own. An empty table gives no sequences.
    """
    spark, dtype = documents.sparkSession, worker_encoder(tokenizer_path).dtype
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = cut_lineage(rows.mapInArrow(_cutter(tokenizer_path, end_id, capacity), PIECES))
    counts = cut_lineage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = spark.sparkContext.broadcast(Layout(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("base"))
    placed = (
        pieces.join(base, ["part", "length"])
        .select("length", (F.col("base") + F.col("nth")).alias("rank"), "doc_id", "start", "doc_tokens", "ids")
        .mapInArrow(_placer(layout, dtype.itemsize), PLACED)
    )
    return placed.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset").mapInArrow(_builder(capacity, pad_id, dtype), SEQUENCES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, pieces = batch.column("ids"), batch.column("pieces")
        flat = ids.flatten().to_numpy().astype("<u4")
        base = np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
        n = pieces.value_lengths().to_numpy()
        doc_id, start, length, doc_tokens, offset = pieces.flatten().flatten()
        row = np.repeat(np.arange(batch.num_rows), n)
        first = base[row] + offset.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(first.tolist(), (first + length.to_numpy()).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [doc_id, start, length, pa.array(sums, pa.int64()), doc_tokens, batch.column("sequence_id").take(pa.array(row)), offset],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def piece_digests(sequences: DataFrame) -> DataFrame:
    """One row per piece, with the CRC-32 of its ids as little-endian 32-bit numbers, read from the sequences."""
    return sequences.mapInArrow(_digests, DIGESTS)


@query()
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return piece_digests(pack(documents, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json")))
