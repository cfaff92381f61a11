"""The prefix trie of conversations, by union-find over the LCP edges of sorted neighbours.

Conversations are sequences of turn digests. Equal ones are one path with a count. Paths are
sorted over all partitions by range; in each partition

1. neighbouring paths are joined by edges of the length of their common prefix, deepest first.
   Union-find merges the components an edge joins: each is lifted, one depth after the other, up to the
   edge's depth, where the two become one branching node. What a component is lifted past is a node with all its
   values known, as nothing deeper is left to come.
2. Nodes on the path of the partition's first or last row may go on in the neighbour partition. They
   stay open: the partition's forest is contracted to these two paths, with, per depth, the sums
   of all that was closed below.
3. The contracted forests of FAN_IN neighbouring partitions are merged in the same way, and again, until one is left. So
   the number of rounds is logarithmic in the number of partitions, and a task holds the paths of
   its own rows.

A closed node under an open one learns its parent's conv_id by a join at the end, on the parent's key.
Texts are hashed before the first shuffle and travel no further than the ordering of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propwell.llm.registry import cut_lineage, query, table
from propwell.operators.joins import join_per_key

#: Contracted partitions that one task merges.
FAN_IN = 64
#: A conversation may take its first 0 to HEADS - 1 turns from the first one of its group of GROUP.
GROUP, HEADS = 5, 9
#: Ids of one path that travel as one text.
IDS_AT_ONCE = 8192
NOBODY = hashlib.sha256(b"").hexdigest()

VALUES = "n bigint, low bigint, kids bigint, leaves bigint, saved bigint, ends string"
#: One path of a forest: `turns` are digests, `sizes` bytes of texts, `own` values per depth.
PATHS = f"part bigint, side int, turns array<binary>, sizes array<bigint>, own array<struct<depth:bigint,{VALUES.replace(' ', ':').replace(',:', ',')}>>"
NODES = f"conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, key binary, parent_key binary"
_OWN = pa.struct([("depth", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])
_BOTH = f"{NODES}, {PATHS}"


class Values:
    """What is known of a node: members and the smallest, children, leaves and savings below, and who ends there."""

    __slots__ = ("ends", "kids", "leaves", "low", "n", "saved")

    def __init__(self, n=0, low=None, kids=0, leaves=0, saved=0, ends=None):
        self.n, self.low, self.kids, self.leaves, self.saved, self.ends = n, low, kids, leaves, saved, ends

    def add(self, other: Values) -> Values:
        self.n += other.n
        self.low = other.low if self.low is None else self.low if other.low is None else min(self.low, other.low)
        self.kids, self.leaves, self.saved = self.kids + other.kids, self.leaves + other.leaves, self.saved + other.saved
        self.ends = self.ends if other.ends is None else other.ends
        return self


class Component:
    """A joined run of paths, lifted to `depth`: the node there and what waits above it."""

    __slots__ = ("below", "depth", "edge", "node", "row", "waiting")

    def __init__(self, row: int, depth: int, own: dict[int, Values], edge: bool):
        self.row, self.depth, self.edge = row, depth, edge  # edge: has the first or the last path
        self.waiting = own
        self.node = own.pop(depth, None) or Values()
        self.below: list[int] = []  # nodes given out whose parent is `node`


def common(one: list, other: list) -> int:
    n = 0
    for a, b in zip(one, other, strict=False):
        if a != b:
            break
        n += 1
    return n


def prefix_keys(turns: list[bytes]) -> list[bytes]:
    """A key per depth, 0 included; equal prefixes have equal keys."""
    keys = [hashlib.sha256(b"").digest()]
    for turn in turns:
        keys.append(hashlib.sha256(keys[-1] + turn).digest())
    return keys


class Forest:
    """The trie of sorted, distinct paths; nodes on the first and last one stay open unless it is the last forest."""

    def __init__(self, paths: list[list[bytes]], sizes: list[list[int]], own: list[dict[int, Values]], last: bool):
        self.paths, self.sizes, self.last = paths, sizes, last
        self.nodes: list[list] = []  # conv_id, depth, parent, n, kids, leaves, saved, ends, row, parent open
        self.open: dict[tuple[int, int], Values] = {}  # by row and depth
        end = len(paths) - 1
        self.up = list(range(len(paths)))
        self.components = [Component(i, len(p), own[i], not last and i in (0, end)) for i, p in enumerate(paths)]
        edges = sorted(((common(paths[i - 1], paths[i]), i) for i in range(1, len(paths))), key=lambda e: (-e[0], e[1]))
        for depth, i in edges:
            self._join(self._root(i - 1), self._root(i), depth)
        root = self.components[self._root(0)]
        self._lift(root, -1)

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def _close(self, c: Component) -> Values:
        """Give out the node of `c`; what its parent gets of it."""
        v = c.node
        if c.edge:
            self.open[c.row, c.depth] = v
            for node in c.below:
                self.nodes[node][9] = True
            return Values()
        leaves = v.leaves if v.kids else 1
        size = self.sizes[c.row][c.depth - 1] if c.depth else 0
        saved = v.saved + (v.n - 1) * size
        for node in c.below:
            self.nodes[node][2] = v.low
        self.nodes.append([v.low, c.depth, None, v.n, v.kids, leaves, saved, v.ends or NOBODY, c.row, False])
        return Values(v.n, v.low, 1, leaves, saved)

    def _lift(self, c: Component, depth: int) -> None:
        while c.depth > depth:
            given = self._close(c)
            c.below = [] if c.edge else [len(self.nodes) - 1]
            c.depth -= 1
            c.node = given.add(c.waiting.pop(c.depth, None) or Values())

    def _join(self, one: int, other: int, depth: int) -> None:
        a, b = self.components[one], self.components[other]
        self._lift(a, depth)
        self._lift(b, depth)
        if len(a.waiting) < len(b.waiting):
            a, b, one, other = b, a, other, one
        self.up[other] = one
        a.node.add(b.node)
        if len(a.below) < len(b.below):
            a.below, b.below = b.below, a.below
        a.below += b.below
        for d, v in b.waiting.items():
            a.waiting[d] = a.waiting[d].add(v) if d in a.waiting else v
        if b.edge and not a.edge:
            a.row, a.edge = b.row, True
        self.components[other] = None

    def contracted(self) -> list[tuple[int, list[tuple[int, Values]]]]:
        """The first and last path, each with the values of the open nodes that are its own."""
        own: dict[int, list[tuple[int, Values]]] = {0: [], len(self.paths) - 1: []}
        for (row, depth), v in self.open.items():
            own[row].append((depth, v))
        return sorted(own.items())


def _nodes_of(forest: Forest, closed: bool) -> pa.RecordBatch:
    """Nodes as rows; `closed` ones of merged forests carry their key, as nodes below wait for it."""
    keys: dict[int, list[bytes]] = {}

    def key(row: int, depth: int) -> bytes:
        if row not in keys:
            keys[row] = prefix_keys(forest.paths[row])
        return keys[row][depth]

    nodes = forest.nodes
    own = [key(x[8], x[1]) if closed else None for x in nodes]
    above = [key(x[8], x[1] - 1) if x[9] else None for x in nodes]
    kinds = [pa.int64()] * 7 + [pa.string()]
    columns = [pa.array([x[k] for x in nodes], kinds[k]) for k in range(8)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.binary()), pa.array(above, pa.binary())], [c.split()[0] for c in NODES.split(", ")])


def _rows_of(forest: Forest, part: int) -> pa.RecordBatch:
    rows = [] if forest.last else forest.contracted()
    own = [[{"depth": d, "n": v.n, "low": v.low, "kids": v.kids, "leaves": v.leaves, "saved": v.saved, "ends": v.ends} for d, v in x] for _, x in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(rows), pa.int64()),
            pa.array(range(len(rows)), pa.int32()),
            pa.array([forest.paths[i] for i, _ in rows], pa.list_(pa.binary())),
            pa.array([forest.sizes[i] for i, _ in rows], pa.list_(pa.int64())),
            pa.array(own, pa.list_(_OWN)),
        ],
        ["part", "side", "turns", "sizes", "own"],
    )


def _together(forest: Forest, part: int, closed: bool) -> Iterator[pa.RecordBatch]:
    """Nodes and contracted paths as rows of one table, the other's columns null."""
    nodes, paths = _nodes_of(forest, closed), _rows_of(forest, part)
    names = [*nodes.schema.names, *paths.schema.names]
    for batch in (nodes, paths):
        if batch.num_rows:
            columns = [batch.column(f.name) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in (*nodes.schema, *paths.schema)]
            yield pa.RecordBatch.from_arrays(columns, names)


def _leaf_forest(last: bool):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, sizes, own = [], [], []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("turns", "sizes", "n", "low", "ends")), strict=True)
            for turns, size, n, low, ends in rows:
                paths.append(turns)
                sizes.append(size)
                own.append({len(turns): Values(n, low, ends=ends)})
        if paths:
            yield from _together(Forest(paths, sizes, own, last), TaskContext.get().partitionId(), False)

    return build


def _merged_forest(last: bool):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (group, part, side)."""
        now, paths, sizes, own = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if paths:
                yield from _together(Forest(paths, sizes, own, last), now, True)

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("grp", "turns", "sizes", "own")), strict=True)
            for group, turns, size, values in rows:
                if group != now:
                    yield from done()
                    now, paths, sizes, own = group, [], [], []
                paths.append(turns)
                sizes.append(size)
                own.append({v.pop("depth"): Values(**v) for v in values})
        yield from done()

    return build


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (path, id) -> runs of at most IDS_AT_ONCE ids of one path as text."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        paths = batch.column("path").to_pylist()
        out, at = [], 0
        for i in range(1, len(ids) + 1):
            if i == len(ids) or paths[i] != paths[at] or i - at == IDS_AT_ONCE:
                out.append((paths[at], ids[at], i - at, ",".join(map(str, ids[at:i]))))
                at = i
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "first", "n", "ids"])


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of (path, first id) -> per path its smallest id, number of ids and their digest."""
    now, low, n, digest = None, None, 0, None
    for batch in batches:
        out = []
        for path, first, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path == now:
                digest.update(b"," + ids.encode())
                n += count
                continue
            if now is not None:
                out.append((now, low, n, digest.hexdigest()))
            now, low, n, digest = path, first, count, hashlib.sha256(ids.encode())
        yield _digest_rows(out)
    if now is not None:
        yield _digest_rows([(now, low, n, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "low", "n", "ends"])


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes of role and text; the role's length keeps the two apart."""
    return F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256))


def conversation_paths(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, turns (digests) and sizes (bytes of the texts) of every rebuilt conversation.

    Turns are ordered by turn (null first), then role, then text; null role or text is empty.
    Conversation c gets the first h = crc32(c) % heads turns of conversation c - c % group, if that
    exists, before its own turns after the first h. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = (
        conversations.where("conv_id IS NOT NULL")
        .select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
        .withColumns({"digest": turn_digest(F.col("role"), F.col("text")), "size": F.octet_length("text").cast("bigint")})
        .withColumn("at", F.row_number().over(order))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "digest", "size"))).alias("turns"))
    )
    turns = cut_lineage(turns)
    first = turns.select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % heads).cast("int")
    nothing = F.slice("turns", 1, 0)
    rebuilt = (
        turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": h})
        .join(first, "base", "left")
        .select(
            "conv_id",
            F.concat(
                F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")),
                F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
            ).alias("turns"),
        )
    )
    return rebuilt.select("conv_id", F.col("turns.digest").alias("turns"), F.col("turns.size").alias("sizes"))


def prefix_trie(paths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node.

    `paths` has conv_id, turns and sizes, as `conversation_paths` gives them. No path, no node.
    """
    spark = paths.sparkSession
    keyed = cut_lineage(paths.withColumn("path", F.unhex(F.sha2(F.unhex(F.array_join(F.transform("turns", F.hex), "")), 256))))
    runs = (
        keyed.select("path", "conv_id")
        .repartitionByRange("path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .mapInArrow(_id_texts, "path binary, first bigint, n bigint, ids string")
    )
    ends = (
        runs.repartition("path")
        .sortWithinPartitions("path", "first")
        .mapInArrow(_id_digests, "path binary, low bigint, n bigint, ends string")
    )
    distinct = keyed.groupBy("path").agg(F.first("turns").alias("turns"), F.first("sizes").alias("sizes"))
    distinct = cut_lineage(distinct.join(ends, "path").select("turns", "sizes", "n", "low", "ends"))
    sorted_paths = distinct.repartitionByRange("turns").sortWithinPartitions("turns")
    level = cut_lineage(sorted_paths.mapInArrow(_leaf_forest(False), _BOTH))
    levels = [level]
    while True:
        forest = level.where("part IS NOT NULL")
        parts = forest.agg(F.max("part")).first()[0]
        if parts is None:
            break
        last = parts < FAN_IN
        level = cut_lineage(
            forest.select(F.floor(F.col("part") / FAN_IN).alias("grp"), "part", "side", "turns", "sizes", "own")
            .repartition("grp")
            .sortWithinPartitions("grp", "part", "side")
            .mapInArrow(_merged_forest(last), _BOTH)
        )
        levels.append(level)
        if last:
            break
    nodes = levels[0]
    for other in levels[1:]:
        nodes = nodes.union(other)
    nodes = nodes.where("depth IS NOT NULL")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    waiting = nodes.where("parent_key IS NOT NULL").select(*names, "parent_key")
    above = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    found = join_per_key(waiting, above, ["parent_key"], spread_by="conv_id").withColumn("parent_conv_id", F.col("above"))
    return nodes.where("parent_key IS NULL").select(*names).union(found.select(*names))


@query(
    # The CRC-32 table follows from its polynomial. Every prefix of every rebuilt conversation is a row here.
    """
    WITH crc AS (
      SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_concat([i::BIGINT], range(8)),
                              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))),
    turns AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
             sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
             strlen(coalesce(text, ''))::BIGINT AS size
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({'d': digest, 's': size} ORDER BY place) AS turns FROM turns GROUP BY conv_id),
    hashed AS (
      SELECT conv_id, turns,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
      FROM own, crc),
    rebuilt AS (
      SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:h], c.turns[h + 1:]) AS turns
      FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
    paths AS (
      SELECT conv_id, len(turns) AS n, list_transform(turns, lambda x: x.d) AS digests, list_transform(turns, lambda x: x.s) AS sizes
      FROM rebuilt),
    members AS (
      SELECT conv_id, d, n, sha256(array_to_string(digests[1:d], '')) AS node,
             CASE WHEN d > 0 THEN sha256(array_to_string(digests[1:d - 1], '')) END AS parent,
             CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
      FROM paths, LATERAL (SELECT unnest(range(0, n + 1)) AS d)),
    nodes AS (
      SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
      FROM members GROUP BY d, node),
    children AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent, d),
    tops AS (
      SELECT m.d, m.node, sum(x.saved) AS saved, count(*) FILTER (c.n_children IS NULL) AS n_leaves
      FROM nodes x JOIN members y ON y.node = x.node AND y.d = x.d AND y.conv_id = x.conv_id
      JOIN members m ON m.conv_id = x.conv_id AND m.d <= x.d
      LEFT JOIN children c ON c.parent = x.node AND c.d = x.d
      GROUP BY m.d, m.node)
    SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs,
           coalesce(c.n_children, 0)::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, x.ends_sha256
    FROM nodes x JOIN tops t ON t.d = x.d AND t.node = x.node
    LEFT JOIN nodes p ON p.node = x.parent AND p.d = x.d - 1
    LEFT JOIN children c ON c.parent = x.node AND c.d = x.d
    """
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(conversation_paths(table(spark, sf_dir, "conversations")))
