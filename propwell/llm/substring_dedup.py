"""Repeated passages across documents, found by anchors at difference-cover positions.

D is a perfect difference set modulo PERIOD: for any two positions i and j there is a k below
PERIOD with both i+k and j+k in D modulo PERIOD. Hashing runs of ANCHOR words at those positions
alone, about one position in five, two equal runs of LENGTH = PERIOD + ANCHOR - 1 words always
have an equal anchor at the same place within them.

1. Every document gives its anchors, each with a hash of its surroundings: all words that any
   window of LENGTH words with this anchor can reach. Sorted by (anchor, surroundings, id), rows
   with equal surroundings are one class: beyond its smallest id, all those windows are repeats.
2. The smallest of each class, where an anchor has several classes, extend: each of their
   windows around the anchor gets a 128-bit hash, and windows are sorted by (hash, id).
3. The spans found go back to their documents, which drop the words.

Nothing is compared pairwise. Before each shuffle a map task resolves what it can: of equal
classes or windows in one batch only the smallest id travels, and an anchor with many classes
in a batch (a passage common to many documents) sends them straight to step 2 and one marker row
into its group, so no group grows with the number of documents that share an anchor. Groups
are streamed in order, with one document's rows of state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.llm import words as W
from propwell.llm.registry import query, table

#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)
PERIOD = 31
LENGTH = 50
ANCHOR = LENGTH - PERIOD + 1
#: Classes of one anchor in one batch that still travel as rows.
MOST_CLASSES = 8

#: key, ctx: hashes; doc: id; spot: position and row mark; end: 0 for a hashed row, -1 for an
#: anchor whose windows must be looked at, else the end of a span to drop.
ROWS = "key bigint, ctx bigint, doc bigint, spot bigint, end bigint"
_MARKER = np.iinfo(np.int64).min
_MARK_BITS = 24

Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _batch(rows: Rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64, copy=False)) for c in rows], ["key", "ctx", "doc", "spot", "end"])


def _columns(batch: pa.RecordBatch) -> Rows:
    return tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)


def _take(rows: Rows, chosen: np.ndarray) -> Rows:
    return tuple(c[chosen] for c in rows)


def _together(*parts: Rows) -> Rows:
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _spans(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> Rows:
    """Spans of documents, those that touch merged, as rows that any partition may get."""
    if not len(doc):
        return (np.zeros(0, np.int64),) * 5
    order = np.lexsort((start, mark, doc))
    doc, mark, start, end = doc[order], mark[order], start[order], end[order]
    own = np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])]
    # ends rise within a document once each is lifted by the document's place
    lift = np.cumsum(own) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(own | np.r_[True, (start + lift)[1:] > reach[:-1]])
    last = np.r_[new[1:], len(doc)] - 1
    doc, mark, start, end = doc[new], mark[new], start[new], (reach - lift)[last]
    key = W.mix((doc * 3 + start).astype(np.uint64)).view(np.int64)
    return key, np.zeros_like(doc), doc, (start << _MARK_BITS) | mark, end


def _first_of_runs(*sorted_columns: np.ndarray) -> np.ndarray:
    differs = np.zeros(max(0, len(sorted_columns[0]) - 1), bool)
    for c in sorted_columns:
        differs |= c[1:] != c[:-1]
    return np.r_[True, differs] if len(sorted_columns[0]) else np.zeros(0, bool)


def _class_spans(rows: Rows, before: int, after: int, limits: np.ndarray | None) -> Rows:
    at, mark = rows[3] >> _MARK_BITS, rows[3] & ((1 << _MARK_BITS) - 1)
    start, end = np.maximum(at - before, 0), at + after
    if limits is not None:
        end = np.minimum(end, limits)
    return _spans(rows[2], mark, start, end)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    for batch in batches:
        found: list[Rows] = []
        ids, marks = batch.column("doc").to_numpy(), batch.column("mark").to_numpy()
        for first, end, data, offsets in W.pieces(batch.column("text")):
            start, stop, rows = W.spans(data, offsets)
            hashes = W.word_hashes(data, start, stop)
            owner = W.row_of(rows)
            sums, other = W.prefix(hashes), W.prefix(W.word_hashes(data, start, stop, 1), 1)
            at = np.arange(len(hashes)) - rows[owner]
            n = np.diff(rows)[owner]
            chosen = np.flatnonzero(inside[at % PERIOD] & (at + ANCHOR <= n) & (n >= LENGTH))
            lo = np.maximum(chosen - (LENGTH - ANCHOR), rows[owner[chosen]])
            hi = np.minimum(chosen + LENGTH, rows[owner[chosen] + 1])
            around = W.mix(W.between(other, lo, hi, 1) + (chosen - lo).astype(np.uint64))
            # spots are whole, so where surroundings end is kept apart, in `end`, until rows leave
            found.append(
                (
                    W.between(sums, chosen, chosen + ANCHOR).view(np.int64),
                    around.view(np.int64),
                    ids[first:end][owner[chosen]],
                    (at[chosen] << _MARK_BITS) | marks[first:end][owner[chosen]],
                    at[chosen] + hi - chosen,
                )
            )
        rows = _together(*found) if found else ()
        if not rows or not len(rows[0]):
            continue
        key, ctx, doc, spot, until = rows = _take(rows, np.lexsort(rows[3::-1]))
        new_class = _first_of_runs(key, ctx)
        of_class = np.cumsum(new_class) - 1
        smallest = doc == doc[new_class][of_class]
        new_key = _first_of_runs(key)
        of_key = np.cumsum(new_key) - 1
        classes = np.bincount(of_key, weights=new_class).astype(np.int64)
        crowded = (classes > MOST_CLASSES)[of_key]
        some = doc[np.flatnonzero(new_key)][of_key]
        crowded &= (np.bincount(of_key, weights=doc != some) > 0)[of_key]
        repeats = _take(rows, ~smallest)
        yield _batch(_class_spans(repeats, LENGTH - ANCHOR, LENGTH, repeats[4]))
        travelling = _take(rows, smallest & ~crowded)
        yield _batch((*travelling[:4], np.zeros_like(travelling[0])))
        straight = _take(rows, smallest & crowded)
        if len(straight[0]):
            spread = W.mix(straight[3].view(np.uint64) + straight[2].view(np.uint64)).view(np.int64)
            yield _batch((spread, np.zeros_like(spread), *straight[2:4], np.full_like(spread, -1)))
            keys = np.unique(straight[0])
            minus = np.full_like(keys, -1)
            yield _batch((keys, np.full_like(keys, _MARKER), minus, minus, np.zeros_like(keys)))


def _by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, ctx, doc, spot) -> spans, and anchors (-1) to look at further."""
    none = (np.zeros(0, np.int64),) * 5
    held, last = none, None  # rows of the one document seen for the last key; (key, ctx, smallest id, many)
    for batch in batches:
        rows = _columns(batch)
        hashed = rows[4] == 0
        if not hashed.all():
            yield _batch(_take(rows, ~hashed))
        rows = _together(held, _take(rows, hashed))
        key, ctx, doc, spot, _ = rows
        if not len(key):
            continue
        new_class, new_key = _first_of_runs(key, ctx), _first_of_runs(key)
        of_class, of_key = np.cumsum(new_class) - 1, np.cumsum(new_key) - 1
        least = doc[new_class]
        many = np.zeros(of_key[-1] + 1, bool)
        if last is not None and key[0] == last[0]:
            many[0] = last[3]
            if ctx[0] == last[1]:
                least[0] = last[2]
        marker = ctx == _MARKER
        many |= np.bincount(of_key, weights=marker) > 0
        key_of_class = of_key[new_class]
        real = ~marker[new_class]
        low = np.full(len(many), np.iinfo(np.int64).max)
        high = np.full(len(many), np.iinfo(np.int64).min)
        np.minimum.at(low, key_of_class[real], least[real])
        np.maximum.at(high, key_of_class[real], least[real])
        many |= low < high
        smallest = doc == least[of_class]
        repeats = _take(rows, ~smallest & ~marker)
        yield _batch(_class_spans(repeats, LENGTH - ANCHOR, LENGTH, None))
        further = _take(rows, smallest & many[of_key] & ~marker)
        yield _batch((*further[:4], np.full_like(further[0], -1)))
        held = none if many[-1] else _take(rows, smallest & (of_key == of_key[-1]) & ~marker)
        last = (key[-1], ctx[-1], least[-1], many[-1])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with what was found so far -> their windows around anchors, and the spans."""
    for batch in batches:
        ids, marks, found = batch.column("doc").to_numpy(), batch.column("mark").to_numpy(), batch.column("found")
        spots, ends, bounds = _lists(found)
        out: list[Rows] = []
        for first, last, data, offsets in W.pieces(batch.column("text")):
            if bounds[first] == bounds[last]:
                continue
            start, stop, rows = W.spans(data, offsets)
            n = np.diff(rows)
            sums = [W.prefix(W.word_hashes(data, start, stop, s), s) for s in (0, 1)]
            owner = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
            spot, end = spots[bounds[first] : bounds[last]] >> _MARK_BITS, ends[bounds[first] : bounds[last]]
            own_id, own_mark = ids[first:last], marks[first:last]
            given = end > 0
            out.append(_spans(own_id[owner[given]], own_mark[owner[given]], spot[given], np.minimum(end, n[owner])[given]))
            looked = ~given
            low = np.maximum(spot[looked] - (LENGTH - ANCHOR), 0)
            high = np.minimum(spot[looked], n[owner[looked]] - LENGTH)
            at = np.unique(W.ragged(rows[owner[looked]] + low, high - low + 1))
            of = np.searchsorted(rows, at, "right") - 1
            out.append(
                (
                    W.between(sums[0], at, at + LENGTH, 0).view(np.int64),
                    W.between(sums[1], at, at + LENGTH, 1).view(np.int64),
                    own_id[of],
                    ((at - rows[of]) << _MARK_BITS) | own_mark[of],
                    np.zeros_like(at),
                )
            )
        if not out:
            continue
        rows = _together(*out)
        hashed = rows[4] == 0
        yield _batch(_take(rows, ~hashed))
        rows = _take(rows, hashed)
        rows = _take(rows, np.lexsort(rows[3::-1]))
        if not len(rows[0]):
            continue
        new = _first_of_runs(rows[0], rows[1])
        smallest = rows[2] == rows[2][new][np.cumsum(new) - 1]
        yield _batch(_class_spans(_take(rows, ~smallest), 0, LENGTH, None))
        yield _batch(_take(rows, smallest))


def _by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order of (hash, id) -> the spans of all but the smallest id."""
    last = None
    for batch in batches:
        rows = _columns(batch)
        hashed = rows[4] == 0
        if not hashed.all():
            yield _batch(_take(rows, ~hashed))
        rows = _take(rows, hashed)
        if not len(rows[0]):
            continue
        new = _first_of_runs(rows[0], rows[1])
        least = rows[2][new]
        if last is not None and rows[0][0] == last[0] and rows[1][0] == last[1]:
            least[0] = last[2]
        last = (rows[0][-1], rows[1][-1], least[-1])
        yield _batch(_class_spans(_take(rows, rows[2] != least[np.cumsum(new) - 1]), 0, LENGTH, None))


def _lists(found: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spots, ends, and bounds per row of a column of lists, null lists empty."""
    counts = np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = found.flatten()
    return (
        flat.field("spot").to_numpy(zero_copy_only=False),
        flat.field("end").to_numpy(zero_copy_only=False),
        np.r_[0, np.cumsum(counts)],
    )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the spans to drop -> what is left of them."""
    for batch in batches:
        spots, ends, bounds = _lists(batch.column("found"))
        n_words, n_removed, texts = [], [], []
        for first, last, data, offsets in W.pieces(batch.column("text")):
            start, stop, rows = W.spans(data, offsets)
            n = np.diff(rows)
            owner = np.repeat(np.arange(last - first), np.diff(bounds[first : last + 1]))
            low = rows[owner] + (spots[bounds[first] : bounds[last]] >> _MARK_BITS)
            high = rows[owner] + np.minimum(ends[bounds[first] : bounds[last]], n[owner])
            change = np.zeros(len(start) + 1, np.int64)
            np.add.at(change, low, 1)
            np.add.at(change, high, -1)
            stays = np.cumsum(change)[:-1] == 0
            left = np.diff(np.r_[0, np.cumsum(stays)][rows])
            n_words.append(n)
            n_removed.append(n - left)
            size = (stop - start + 1)[stays]
            joined = np.append(data, 32).astype(np.uint8)[W.ragged(start[stays], size)]
            close = np.cumsum(size)
            joined[close - 1] = 32
            until = np.r_[0, close][np.r_[0, np.cumsum(left)]]
            flat = joined.tobytes()
            texts += [flat[a : b - 1] if b > a else b"" for a, b in zip(until[:-1].tolist(), until[1:].tolist(), strict=True)]
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.concatenate(n_words or [none])),
                pa.array(np.concatenate(n_removed or [none])),
                pa.array([t.decode() for t in texts], pa.string()),
            ],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        kept = [hashlib.sha256(t.encode()).hexdigest() for t in batch.column("kept").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
        )


def without_repeats(documents: DataFrame, doc_id: str, text: str, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, one space between; with `digest`
    their SHA-256, kept_sha256) for every row.

    A word goes when a window of 50 words around it also starts in a row with a smaller id. Rows
    with equal ids, repeated ones too, do not remove each other's words. Null ids count as the
    largest. Null and empty texts have no words; texts of under 50 words keep them all.
    """
    rows = documents.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")
    ).select(
        "doc_id",
        F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)).alias("doc"),
        F.xxhash64("text").bitwiseAND(F.lit((1 << _MARK_BITS) - 1)).alias("mark"),
        "text",
    )
    order = ["key", "ctx", "doc", "spot"]
    anchors = rows.select("doc", "mark", "text").mapInArrow(_anchors, ROWS)
    step = anchors.repartition("key").sortWithinPartitions(*order).mapInArrow(_by_anchor, ROWS)
    around = _with_found(rows, step).mapInArrow(_windows, ROWS)
    spans = around.repartition("key").sortWithinPartitions(*order).mapInArrow(_by_window, ROWS)
    last = "kept_sha256 string" if digest else "kept string"
    return _with_found(rows, spans).mapInArrow(
        _digests if digest else _kept, f"doc_id bigint, n_words bigint, n_removed bigint, {last}"
    )


def _with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each document with the list of what was found in it; the text is shuffled once, and that
    exchange is used again."""
    mark = F.col("spot").bitwiseAND(F.lit((1 << _MARK_BITS) - 1)).alias("mark")
    lists = found.groupBy("doc", mark).agg(F.collect_list(F.struct("spot", "end")).alias("found"))
    return rows.join(lists, ["doc", "mark"], "left").select("doc_id", "doc", "mark", "text", "found")


@query(
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ),
    p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
    k AS (
        SELECT *, CASE WHEN i + 50 <= n THEN md5(string_agg(word, ' ') OVER (
            PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS key
        FROM p
    ),
    f AS (SELECT key, min(doc_id) AS first FROM k WHERE key IS NOT NULL GROUP BY key),
    m AS (
        SELECT k.doc_id, k.i, k.word, coalesce(max(CASE WHEN f.first < k.doc_id THEN 1 ELSE 0 END) OVER (
            PARTITION BY k.doc_id ORDER BY k.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) AS gone
        FROM k LEFT JOIN f USING (key)
    ),
    r AS (
        SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept
        FROM m GROUP BY doc_id
    )
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN r USING (doc_id)
    """
)
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", digest=True)
