"""Near duplicates by DartMinHash over five-word shingles, weighted by how often they occur.

Every unit of weight of a shingle is a region at which darts are thrown in order of rank, with
exponential gaps drawn from a hash of (shingle, unit, dart). A dart also falls on one of K
coordinates; a coordinate keeps the earliest dart of a document. Two documents agree in a
coordinate with a probability equal to their weighted Jaccard similarity. Darts up to a rank of
K (ln K + 3) / total weight nearly always reach all coordinates, so a document costs its length
plus a fixed number of darts; the few it leaves open get twice the rank.

Equal word sequences, by their 128-bit digest, are one vertex from the start. Signatures are cut into bands. In every
bucket of a band the smallest vertex is paired with all others (as many pairs as rows); pairs are
verified exactly on their shingles and joined to classes. Links within a class change
nothing any more, so only buckets with rows of different classes go on. In those of up to
MOST_PAIRED rows, rows of different classes are paired and verified. Larger ones are gathered to
groups: all rows outside a group's largest class are queries against all its rows, which are
kept in blocks of bounded size with an index of their shingles; of the similar rows a
query finds, only those that join classes not yet joined leave the task. Both ways find every link
between classes; the second gives no more rows than there are queries and classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.llm import words as W
from propwell.llm.registry import cut_lineage, files, query, table
from propwell.operators.joins import join_per_key

SHINGLE = 5
SIMILARITY = 0.8
#: Pairs at the similarity of 0.8 share no band with a probability of (1 - 0.8**5)**30 < 1e-5.
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
#: Rows of a bucket that may be paired one by one; larger buckets go by blocks.
MOST_PAIRED = 64
#: Shingles of the texts in one block.
BLOCK_WEIGHT = 1_500_000
#: Rows with a text that one file of a checkpoint has.
TEXTS_PER_FILE = 10_000
#: Vertices of rows without an id are above all ids.
NO_ID = 1 << 62


def vertex_of(doc_id: Column, text: Column) -> Column:
    """The id; for rows without one, a number from the text, so that equal texts share it."""
    own = F.xxhash64(text).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(NO_ID)
    return F.coalesce(doc_id.cast("bigint"), own)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of rows of text, and the row of each.

    A row of one to four words has one shingle, all of it.
    """
    start, stop, rows = W.spans(data, offsets)
    sums = W.prefix(W.word_hashes(data, start, stop))
    n = np.diff(rows)
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    owner = np.repeat(np.arange(len(n)), count)
    first = W.ragged(rows[:-1], count)
    hashes = W.between(sums, first, np.minimum(first + SHINGLE, rows[owner + 1]))
    return hashes, owner


def word_digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit digest of each row's words, one space between, in two halves."""
    start, stop, rows = W.spans(data, offsets)
    size = stop - start + 1
    joined = np.append(data, 32).astype(np.uint8)[W.ragged(start, size)]
    joined[np.cumsum(size) - 1] = 32
    until, flat = np.r_[0, np.cumsum(size)][rows].tolist(), memoryview(joined)
    parts = [hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(until[:-1], until[1:], strict=True)]
    halves = np.frombuffer(b"".join(parts), "<i8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def unit_cells(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One number per shingle and unit of its weight: the weight is how often the row has it."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
    at = np.arange(len(h))
    unit = at - np.maximum.accumulate(np.where(new, at, 0))
    cells = np.empty_like(hashes)
    cells[order] = W.mix(h + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return cells


def dart_signatures(cells: np.ndarray, owner: np.ndarray, n_rows: int, k: int = COORDINATES) -> np.ndarray:
    """n_rows x k dart numbers; rows without cells stay 0."""
    out = np.zeros((n_rows, k), np.uint64)
    weight = np.bincount(owner, minlength=n_rows)
    most = np.where(weight > 0, k * (np.log(k) + 3) / np.maximum(weight, 1), 0.0)
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        cell, row = cells[live], owner[live]
        rank = np.zeros(len(cell))
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        dart = 0
        while len(cell):
            drawn = W.mix(cell + np.uint64((2 * dart + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))
            rank = rank - np.log1p(-(drawn >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            hit = rank <= most[row]
            cell, row, rank, drawn = cell[hit], row[hit], rank[hit], drawn[hit]
            number = W.mix(drawn ^ np.uint64(0xA0761D6478BD642F))
            seen.append((rank, row * k + (number % np.uint64(k)).astype(np.int64), number))
            dart += 1
        ranks, slots, numbers = (np.concatenate(c) for c in zip(*seen, strict=True))
        latest_first = np.argsort(-ranks, kind="stable")
        flat = np.zeros(n_rows * k, np.uint64)
        flat[slots[latest_first]] = numbers[latest_first] | np.uint64(1)
        got = flat.reshape(n_rows, k)
        full = todo & (got != 0).all(axis=1)
        out[full] = got[full]
        todo &= ~full
        most *= 2
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vertex = batch.column("vertex")
        for first, end, data, offsets in W.pieces(batch.column("text"), W.PIECE_BYTES // 2):
            (hashes, owner), (one, two) = shingles(data, offsets), word_digests(data, offsets)
            n = np.bincount(owner, minlength=end - first)
            signature = dart_signatures(unit_cells(hashes, owner), owner, end - first)
            bands = np.zeros((end - first, BANDS), np.uint64)
            for b in range(BANDS):
                key = np.full(end - first, b, np.uint64)
                for r in range(ROWS):
                    key = W.mix(key + signature[:, b * ROWS + r])
                bands[:, b] = key
            ends = np.cumsum(np.where(n > 0, BANDS, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(bands[n > 0].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [vertex.slice(first, end - first), pa.array(one), pa.array(two), pa.array(n), lists],
                ["vertex", "one", "two", "n", "bands"],
            )


def _pair_with_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, vertex) -> those of buckets of two and more, with the first's vertex."""
    held = None  # the first row of the last key, and whether it was given out
    for batch in batches:
        key, vertex, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        joined = held is not None and held[0] == key[0]
        if joined:
            key, vertex, n = np.r_[held[0], key], np.r_[held[1], vertex], np.r_[held[2], n]
        new = np.r_[True, key[1:] != key[:-1]]
        place = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        shared = (np.diff(np.r_[place, len(key)]) > 1)[of]
        if joined and held[3]:
            shared[0] = False
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[shared]) for x in (key, vertex, n, vertex[place][of], n[place][of])],
            ["key", "vertex", "n", "first", "first_n"],
        )
        begin = place[-1]
        given = len(key) - begin > 1 or (joined and len(place) == 1 and held[3])
        held = (key[begin], vertex[begin], n[begin], given)


def _between_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, class, vertex) -> pairs of rows of one key and different classes.

    Each row meets the rows of earlier classes of its bucket, in blocks.
    """
    key_now, cls, vertex, n = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys, classes, vertices, sizes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        place = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
        for begin, end in zip(place, np.r_[place, len(keys)][1:], strict=True):
            if keys[begin] != key_now:
                key_now, cls, vertex, n = keys[begin], cls[:0], vertex[:0], n[:0]
            cls, vertex, n = (np.r_[a, b[begin:end]] for a, b in ((cls, classes), (vertex, vertices), (n, sizes)))
            earlier = np.searchsorted(cls, cls)[-(end - begin) :]
            own = np.arange(len(cls) - (end - begin), len(cls))
            at = 0
            while at < len(own):
                upto = at + max(1, int(np.searchsorted(np.cumsum(earlier[at:]), 100_000)))
                right = np.repeat(own[at:upto], earlier[at:upto])
                left = W.ragged(np.zeros(upto - at, np.int64)[: len(own[at:upto])], earlier[at:upto])
                a, b = vertex[left], vertex[right]
                near = np.minimum(n[left], n[right]) >= SIMILARITY * np.maximum(n[left], n[right])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)[near]), pa.array(np.maximum(a, b)[near])], ["a", "b"]
                )
                at = upto


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts -> those with a weighted Jaccard similarity of at least SIMILARITY."""
    last, last_cells = None, None
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        good = np.zeros(len(a), bool)
        ids = a.to_numpy()
        order = np.argsort(ids, kind="stable")
        left = batch.column("text_a")
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            cells = []
            for _, _, data, offsets in W.pieces(batch.column("text_b").take(pa.array(some))):
                hashes, owner = shingles(data, offsets)
                mine = unit_cells(hashes, owner)
                cells += np.split(mine, np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))[:-1])
            for row, other in zip(some, cells, strict=True):
                if ids[row] != last or last_cells is None:
                    _, _, data, offsets = next(W.pieces(left.slice(int(row), 1)))
                    hashes, owner = shingles(data, offsets)
                    last, last_cells = ids[row], np.sort(unit_cells(hashes, owner))
                if not len(last_cells):
                    continue
                place = np.minimum(np.searchsorted(last_cells, other), len(last_cells) - 1)
                both = int((last_cells[place] == other).sum())
                # similarity >= 4/5, in whole numbers
                good[row] = 5 * both >= 4 * (len(last_cells) + len(other) - both)
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(good)), b.filter(pa.array(good))], ["a", "b"])


def _links_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (group, block, asks): a block's own texts, then the queries against it ->
    links that join its classes."""
    now, index = None, None
    for batch in batches:
        group, block, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "block", "asks"))
        vertex, cls = batch.column("vertex").to_numpy(), batch.column("class").to_numpy()
        links: list[tuple[int, int]] = []
        for first, last, data, offsets in W.pieces(batch.column("text")):
            hashes, owner = shingles(data, offsets)
            cells = np.split(unit_cells(hashes, owner), np.cumsum(np.bincount(owner, minlength=last - first))[:-1])
            for i, own in zip(range(first, last), cells, strict=True):
                if (group[i], block[i]) != now:
                    now, index = (group[i], block[i]), _Block()
                if asks[i]:
                    links += index.ask(int(vertex[i]), int(cls[i]), own)
                else:
                    index.add(int(vertex[i]), int(cls[i]), own)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


class _Block:
    """Texts of one block by their shingles, and the classes joined so far."""

    def __init__(self):
        self.vertex: list[int] = []
        self.cls: list[int] = []
        self.cells: list[np.ndarray] = []
        self.joined: dict[int, int] = {}
        self.sorted = None

    def add(self, vertex: int, cls: int, cells: np.ndarray) -> None:
        self.vertex.append(vertex)
        self.cls.append(cls)
        self.cells.append(cells)

    def root(self, cls: int) -> int:
        while (up := self.joined.get(cls, cls)) != cls:
            cls = up
        return cls

    def ask(self, vertex: int, cls: int, cells: np.ndarray) -> list[tuple[int, int]]:
        if not self.vertex:
            return []
        if self.sorted is None:
            self.weight = np.array([len(c) for c in self.cells])
            flat = np.concatenate(self.cells)
            order = np.argsort(flat, kind="stable")
            self.sorted, self.owner = flat[order], np.repeat(np.arange(len(self.cells)), self.weight)[order]
            self.cells = []
        low, high = (np.searchsorted(self.sorted, cells, side) for side in ("left", "right"))
        both = np.bincount(self.owner[W.ragged(low, high - low)], minlength=len(self.vertex))
        links = []
        for i in np.flatnonzero(5 * both >= 4 * (self.weight + len(cells) - both)).tolist():
            one, other = self.root(cls), self.root(self.cls[i])
            if one != other:
                self.joined[max(one, other)] = min(one, other)
                links.append((min(vertex, self.vertex[i]), max(vertex, self.vertex[i])))
        return links


def _large_bucket_links(large: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between classes of rows (key, first, class, vertex, n) of large buckets."""
    width = files(large.count())
    to_first = large.where("vertex != first").select(F.col("first").alias("a"), F.col("vertex").alias("b")).distinct()
    groups = components(cut_lineage(to_first, width)).withColumnRenamed("class", "grp")
    members = cut_lineage(large.select("vertex", "class", "n").distinct().join(groups, "vertex"), width)
    per_class = members.groupBy("grp", "class").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight"))
    per_group = per_class.groupBy("grp").agg(
        F.max(F.struct("rows", "class")).alias("main"),
        F.ceil(F.sum("weight") / F.lit(BLOCK_WEIGHT)).cast("int").alias("blocks"),
    )
    placed = members.join(per_group, "grp")
    own = placed.select(
        "grp", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "vertex", "class"
    )
    queries = placed.where(F.col("class") != F.col("main.class")).select(
        "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "vertex", "class"
    )
    return (
        own.union(queries)
        .join(texts, "vertex")
        .select("grp", "block", "asks", "vertex", "class", "text")
        .repartition("grp", "block")
        .sortWithinPartitions("grp", "block", "asks")
        .mapInArrow(_links_in_blocks, "a bigint, b bigint")
    )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of vertices whose texts (vertex, text) are similar."""
    left = texts.select(F.col("vertex").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("vertex").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(
        _similar, "a bigint, b bigint"
    )


#: Links that one task contracts.
GRAPH_ROWS = 100_000
#: Rounds whose labels are followed in one plan.
ROUNDS_AT_ONCE = 4


def _priority(vertex: np.ndarray, turn: int) -> np.ndarray:
    return W.mix(vertex.astype(np.int64).view(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64)))


def _local_roots(turn: int):
    """Links (a, b) of a partition -> every vertex of theirs and the root of its tree in this partition's forest."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if not parts:
            return
        a, b = (np.concatenate(c) for c in zip(*parts, strict=True))
        names, ends = np.unique(np.r_[a, b], return_inverse=True)
        if not len(names):
            return
        order = np.argsort(_priority(names, turn), kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        up = list(range(len(names)))  # by place, so that roots have the smallest priority

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for x, y in zip(place[ends[: len(a)]].tolist(), place[ends[len(a) :]].tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        roots = np.array([root(i) for i in range(len(up))])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[order[roots[place]]])], ["vertex", "root"])

    return contract


def _first_root(turn: int) -> Column:
    """Of the roots a vertex has in several partitions, the one that is numbered first this round."""
    return F.array_min(F.transform("roots", lambda r: F.named_struct(F.lit("order"), F.xxhash64(r, F.lit(turn)), F.lit("root"), r)))["root"]


def components(links: DataFrame) -> DataFrame:
    """vertex, class (its smallest vertex) for every vertex of the links (a, b), which are read twice.

    Each round every task contracts its links by union-find. A vertex that has several roots, in several
    tasks, makes links of those roots, which are the next round's; roots are of random priority, so long
    chains shrink by a third each round as well. Links come to tasks by their smaller end, so what a
    bucket has linked to its first row is contracted at once. No task holds more than its own links.
    """
    edges = links.where("a != b").select("a", "b")
    labels: list[DataFrame] = []
    width = None  # files for as many vertices as the links can have
    while n := edges.count():
        width = width or files(2 * n, GRAPH_ROWS)
        parts, turn = max(8, -(-n // GRAPH_ROWS)), len(labels)
        stars = edges.repartition(parts, "a").mapInArrow(_local_roots(turn), "vertex bigint, root bigint")
        hooked = cut_lineage(stars.groupBy("vertex").agg(F.collect_set("root").alias("roots")).coalesce(parts))
        labels.append(hooked.select("vertex", _first_root(turn).alias("class")))
        edges = cut_lineage(
            hooked.where("size(roots) > 1")
            .select(_first_root(turn).alias("x"), F.explode("roots").alias("y"))
            .where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
            .coalesce(parts)
        )
    if not labels:
        return links.sparkSession.createDataFrame([], "vertex bigint, class bigint")
    found = labels.pop()
    while labels:
        above = found.select(F.col("vertex").alias("class"), F.col("class").alias("next"))
        found = join_per_key(labels.pop(), above, ["class"], spread_by="vertex").select(
            "vertex", F.coalesce("next", "class").alias("class")
        )
        if len(labels) % ROUNDS_AT_ONCE == 1:
            found = cut_lineage(found, width)
    smallest = found.groupBy("class").agg(F.min("vertex").alias("low"))
    named = join_per_key(found, smallest, ["class"], spread_by="vertex").select("vertex", F.col("low").alias("class"))
    return cut_lineage(named, width)


def _with_these_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, one, two, vertex) whose words have the digest (one, two)."""
    for batch in batches:
        for first, end, data, offsets in W.pieces(batch.column("text")):
            part = batch.slice(first, end - first)
            one, two = word_digests(data, offsets)
            same = (one == part.column("one").to_numpy()) & (two == part.column("two").to_numpy())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(same)) for c in ("vertex", "text")], ["vertex", "text"])


def _digested(place: str):
    """Rows (_row) with the digest of the words of their text, the field `place` of the row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_row").field("row").field(place)
            parts = [word_digests(data, offsets) for _, _, data, offsets in W.pieces(texts, W.PIECE_BYTES // 2)]
            one, two = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(one), pa.array(two)], ["_row", "one", "two"])

    return digest


def first_of_classes(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows that stay, with all their columns: of each group one row of its smallest vertex.

    Of rows equal in id and words the first by text stays; rows without words stay, one per id.
    """
    classes = near_duplicate_classes(documents, doc_id, text)
    kept = classes.where("vertex = class").select(F.col("row_vertex").alias("vertex"), "one", "two").distinct()
    own = documents.select(
        F.struct(
            vertex_of(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("vertex"),
            F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)]).alias("row"),
        ).alias("_row")
    )
    schema = f"_row {own.schema['_row'].dataType.simpleString()}, one bigint, two bigint"
    place = f"c{documents.columns.index(text)}"
    rows = own.mapInArrow(_digested(place), schema).select("_row.vertex", "one", "two", "_row.row")
    first = rows.join(kept, ["vertex", "one", "two"], "left_semi").groupBy("vertex", "one", "two").agg(F.min_by("row", F.struct(f"row.{place}")).alias("row"))
    return first.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(documents.columns)])


def near_duplicate_classes(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """vertex, doc_id, row_vertex, one, two, class, copies: one row per row, `class` is the smallest vertex of its group.

    Groups are what links of a similarity of 0.8 and more connect. Rows with equal words are
    equal: `one` and `two` are the halves of the words' digest. A text's vertex is the smallest id
    that has it; of unlike texts under one smallest id, the others get numbers above all ids. A row has
    its text's vertex if it has that id, else its id; `row_vertex` is always by id. Rows without
    words (null, empty, white space) are each a group of their own id. An empty table gives an empty result.
    """
    rows = documents.select(
        vertex_of(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("vertex"), F.col(f"`{text}`").alias("text")
    )
    signed = cut_lineage(
        rows.mapInArrow(_signatures, "vertex bigint, one bigint, two bigint, n bigint, bands array<bigint>")
    )
    n_rows = signed.count()
    width, wide = files(n_rows), files(BANDS * n_rows)
    own = cut_lineage(
        signed.where("n > 0")
        .groupBy("one", "two", "n")
        .agg(F.min("vertex").alias("own_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")),
        width,
    )
    crowded = cut_lineage(
        own.groupBy("own_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("one", "two")).alias("first")).where("n > 1").select("own_id", "first"),
        width,
    )
    several = not crowded.isEmpty()
    if several:  # unlike texts under one id
        number = F.xxhash64("own_id", "one", "two").bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(NO_ID)
        later = F.col("first").isNotNull() & (F.struct("one", "two") != F.col("first"))
        own = cut_lineage(own.join(crowded, "own_id", "left").withColumn("rep", F.when(later, number).otherwise(F.col("own_id"))).drop("first"), width)
    else:
        own = own.withColumn("rep", F.col("own_id"))
    buckets = cut_lineage(
        own.select(F.explode("bands").alias("key"), F.col("rep").alias("vertex"), "n")
        .repartition("key")
        .sortWithinPartitions("key", "vertex", "n")
        .mapInArrow(_pair_with_first, "key bigint, vertex bigint, n bigint, first bigint, first_n bigint"),
        wide,
    )
    # Of every bucket's pairs only those that can be similar: the lighter has 4/5 of the heavier
    pairs = cut_lineage(
        buckets.where("vertex != first AND 5 * least(n, first_n) >= 4 * greatest(n, first_n)")
        .select(F.least("vertex", "first").alias("a"), F.greatest("vertex", "first").alias("b"))
        .distinct(),
        wide,
    )
    in_buckets = buckets.select("vertex").distinct()
    # one text per vertex, so that repeated rows cannot multiply
    if several:
        wanted = in_buckets.join(own.select("own_id", "one", "two", F.col("rep").alias("vertex")), "vertex")
        own_text = rows.withColumnRenamed("vertex", "own_id").join(wanted, "own_id").mapInArrow(_with_these_words, "vertex bigint, text string")
    else:
        own_text = rows.join(in_buckets, "vertex", "left_semi")
    texts = cut_lineage(own_text.groupBy("vertex").agg(F.min("text").alias("text")), files(n_rows, TEXTS_PER_FILE))
    links = cut_lineage(verified(pairs, texts).repartition(wide))  # verified in as many tasks as there are, then written by few
    first = components(links)
    placed = cut_lineage(
        buckets.join(first, "vertex", "left").select(
            "key", "first", F.coalesce("class", "vertex").alias("class"), "vertex", "n"
        ),
        wide,
    )
    mixed = (
        placed.groupBy("key")
        .agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("rows"))
        .where("low < high")
    )
    more = (
        placed.join(mixed.where(F.col("rows") <= MOST_PAIRED).select("key"), "key", "left_semi")
        .select("key", "class", "vertex", "n")
        .repartition("key")
        .sortWithinPartitions("key", "class", "vertex")
        .mapInArrow(_between_classes, "a bigint, b bigint")
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    large = cut_lineage(placed.join(mixed.where(F.col("rows") > MOST_PAIRED).select("key"), "key", "left_semi"), wide)
    late = verified(more, texts)
    if not large.isEmpty():
        late = late.union(_large_bucket_links(large, texts))
    of_a, of_b = (first.select(F.col("vertex").alias(x), F.col("class").alias(f"to_{x}")) for x in ("a", "b"))
    late = cut_lineage(  # between the classes found first, so that only those are joined on
        late.join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        .distinct(),
        wide,
    )
    placed_reps = own.join(first, own["rep"] == first["vertex"], "left").select(
        "one", "two", "own_id", "rep", F.coalesce("class", "rep").alias("class"), "copies"
    )
    if not late.isEmpty():
        joined_classes = components(late).select(F.col("vertex").alias("class"), F.col("class").alias("next"))
        placed_reps = placed_reps.join(joined_classes, "class", "left").withColumn("class", F.coalesce("next", "class"))
    by_rep = cut_lineage(
        placed_reps.select("one", "two", "own_id", "rep", "class", "copies")
        .where("copies > 1 OR class != own_id"),
        width,
    )
    joined = join_per_key(signed.select("vertex", "one", "two", "n"), by_rep, ["one", "two"], spread_by="vertex")
    return joined.select(
        F.when(F.col("vertex") == F.col("own_id"), F.col("rep")).otherwise(F.col("vertex")).alias("vertex"),
        F.when(F.col("vertex") < NO_ID, F.col("vertex")).alias("doc_id"),
        F.col("vertex").alias("row_vertex"),
        "one",
        "two",
        F.when(F.col("n") == 0, F.col("vertex")).otherwise(F.coalesce("class", "vertex")).alias("class"),
        F.when(F.col("n") == 0, 1).otherwise(F.coalesce("copies", F.lit(1))).cast("bigint").alias("copies"),
    )


@query()
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return classes.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull() | (F.col("class") < NO_ID), F.col("class")).alias("class_id"),
        (F.col("vertex") == F.col("class")).alias("kept"),
        "copies",
    )
