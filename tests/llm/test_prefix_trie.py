import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from propwell.llm import prefix_trie as t

SHAPE = "conv_id bigint, turn bigint, role string, text string, key string, part int, n string"


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda e: (e[0], e[1], e[2].encode(), e[3].encode()))] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        cost = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += p not in kids
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def found(frame):
    return sorted(tuple(r) for r in frame.collect())


def crowd(seed, n):
    """Few distinct texts, so that paths share much; hot first turns, repeats, ties, nulls and one long conversation."""
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        conv = rnd.choice([c, c, c, -c])
        for k in range(rnd.choice([0, 1, 2, 3, 9, 12])):
            rows.append((conv, rnd.choice([k, k, k, None, 1]), rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "hi", "é", "a b"])))
    rows += [(10_000 + i, k, "user", f"same {k}") for i in range(0, 200) for k in range(10)]
    rows += [(5, k, "user", "x") for k in range(300)] + [(None, 1, "user", "nobody's")] * 3
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "n") for r in rows], SHAPE)


@pytest.mark.parametrize("fan_in, parts", [(2, 13), (3, 40), (64, 8)])
def test_nodes_equal_brute_force(spark, monkeypatch, fan_in, parts):
    monkeypatch.setattr(t, "FAN_IN", fan_in)
    monkeypatch.setattr(t, "IDS_AT_ONCE", 7)
    rows = crowd(fan_in, 250)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = found(t.prefix_trie(t.conversation_paths(table(spark, rows))))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == expected(rows)


def test_whole_forest_in_one(spark):
    rnd = random.Random(9)
    paths = sorted({tuple(rnd.choices([b"a", b"b"], k=rnd.randint(0, 5))) for _ in range(40)})
    values = lambda: [{len(p): t.Values(1, i, ends=str(i))} for i, p in enumerate(paths)]
    whole = t.Forest([list(p) for p in paths], [[1] * len(p) for p in paths], values(), True)
    assert len(whole.nodes) == len({p[:d] for p in paths for d in range(len(p) + 1)})
    assert not whole.open and not any(x[9] for x in whole.nodes)


def test_small_cases(spark):
    assert found(t.prefix_trie(t.conversation_paths(table(spark, [])))) == []
    assert found(t.prefix_trie(t.conversation_paths(table(spark, [(None, 0, "user", "x")])))) == []
    for rows in ([(3, 0, "user", "x")], [(7, None, None, None)] * 2, [(0, 0, "a", "b"), (1, 0, "a", "b"), (2, 0, "ab", "")]):
        assert found(t.prefix_trie(t.conversation_paths(table(spark, rows)))) == expected(rows)
