import hashlib
from collections import Counter, defaultdict

from cases import WORDS, documents, empty, odd, odd_rows, prose

import pytest

from propwell.llm import near_dedup, substring_dedup
from propwell.llm.near_dedup import first_of_classes, near_duplicate_classes


def kept_words(rows):
    """Brute force: (id, words, kept words) of each row."""
    order = lambda i: 2**63 - 1 if i is None else i
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            least[key] = min(least.get(key, 2**63), order(i))
    out = []
    for i, w in split:
        stays = [True] * len(w)
        for j in range(len(w) - 49):
            if least[tuple(w[j : j + 50])] < order(i):
                stays[j : j + 50] = [False] * 50
        out.append((i, len(w), " ".join(x for x, s in zip(w, stays, strict=True) if s)))
    return Counter(out)


def got_words(frame):
    rows = substring_dedup.without_repeats(frame, "doc_id", "text").collect()
    return Counter((r["doc_id"], r["n_words"], r["kept"]) for r in rows)


def test_cover_is_a_difference_set():
    d = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert len(d) == substring_dedup.PERIOD


def test_substring_documents(spark):
    rows = documents(spark)
    want = {i: (n, hashlib.sha256(k.encode()).hexdigest()) for (i, n, k) in kept_words(rows)}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = substring_dedup.without_repeats(frame, "doc_id", "text", digest=True).collect()
    assert {r["doc_id"]: (r["n_words"], r["kept_sha256"]) for r in got} == want


def test_substring_odd_rows(spark):
    assert got_words(odd(spark)) == kept_words([r[:2] for r in odd_rows()])
    assert got_words(empty(spark)) == Counter()


def test_substring_common_passages(spark):
    """A passage of 50 to 90 words in most documents, at all offsets, with many classes per anchor."""
    passage = prose(9, 90).split()
    rows = []
    for i in range(60):
        own = prose(100 + i, 20 + i % 37).split()
        rows.append((i, " ".join(own + passage[: 50 + i % 41] + own[: i % 13])))
    for parts in (1, 20):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        assert got_words(frame) == kept_words(rows)


def classes(rows):
    """Brute force over all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = WORDS.findall(t or "")
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    where = defaultdict(list)
    for n, s in enumerate(sets):
        for g in s:
            where[g].append(n)
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, s in enumerate(sets):
        both = Counter()
        for g, c in s.items():
            for m in where[g]:
                if m < n:
                    both[m] += min(c, sets[m][g])
        for m, o in both.items():
            if 5 * o >= 4 * (s.total() + sets[m].total() - o):
                parent[find(n)] = find(m)
    members = defaultdict(set)
    for n in range(len(rows)):
        members[find(n)].add(rows[n][0])
    return {frozenset(m) for m in members.values()}


def got_classes(frame):
    members = defaultdict(set)
    for r in near_dedup.near_duplicate_classes(frame, "doc_id", "text").collect():
        members[r["class"]].add(r["doc_id"])
        assert r["class"] <= r["vertex"]
    return {frozenset(m) for m in members.values()}


def test_near_documents(spark):
    rows = documents(spark)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got_classes(frame) == classes(rows)


def test_near_chain(spark):
    """Each document is near the next only; all are one class."""
    words = prose(3, 400).split()
    rows = [(i, " ".join(words[12 * i : 12 * i + 200])) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got_classes(frame) == classes(rows) == {frozenset(range(12))}


def test_near_odd_rows(spark):
    got = near_dedup.near_duplicate_classes(odd(spark), "doc_id", "text").collect()
    assert len(got) == len(odd_rows())
    of = defaultdict(set)
    for r in got:
        of[r["doc_id"]].add(r["class"])
    assert of[1] == of[2] == {1} and 1 in of[3] and 1 in of[None]
    assert of[5] == {5} and of[6] == {6} and of[7] == {7}
    assert near_dedup.near_duplicate_classes(empty(spark), "doc_id", "text").count() == 0


def test_signatures_estimate_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    words = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = np.repeat(words[:200], 2), np.repeat(words[50:250], 2)
    owner = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
    cells = near_dedup.unit_cells(np.r_[a, b], owner)
    signature = near_dedup.dart_signatures(cells, owner, 2, k=2000)
    assert abs((signature[0] == signature[1]).mean() - 0.6) < 0.04


def test_near_graded_group(spark, monkeypatch):
    """Copies with more and fewer edits: many links at 0.8 that the smallest of a bucket lacks."""
    import random

    rnd = random.Random(5)
    rows = []
    for i in range(120):
        words = prose(77, 150).split()
        for _ in range(rnd.randint(1, 9)):
            words[rnd.randrange(150)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = classes(rows)
    assert got_classes(frame) == want
    monkeypatch.setattr(near_dedup, "MOST_PAIRED", 3)  # nearly all by blocks, and many of them
    monkeypatch.setattr(near_dedup, "BLOCK_WEIGHT", 2000)
    assert got_classes(frame) == want


def test_unlike_texts_under_one_id(spark):
    a, b, c = (prose(i, 100) for i in (71, 72, 73))
    rows = [(9, a), (3, a + " more"), (3, b + " more"), (1, b), (3, c), (12, None), (3, c), (None, c + " tail"), (4, " ")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_duplicate_classes(frame, "doc_id", "text").collect()
    of = {}
    for r in got:
        of.setdefault(r["class"], []).append(r["doc_id"])
    assert sorted((sorted(x, key=str) for x in of.values()), key=str) == [[1, 3], [12], [3, 3, None], [3, 9], [4]]
    kept = first_of_classes(frame, "doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == sorted([(3, a + " more"), (1, b), (3, c), (12, ""), (4, " ")])


@pytest.mark.parametrize("n", [2, 3000])
def test_components_of_chains_and_stars(spark, monkeypatch, n):
    monkeypatch.setattr(near_dedup, "GRAPH_ROWS", 50)
    links = [(i, i + 1) for i in range(n)] + [(10_000, 10_000 + i) for i in range(1, n)] + [(30_000 + n - i, 30_000 + n - i - 1) for i in range(n)] + [(50, 50)]
    got = {r["vertex"]: r["class"] for r in near_dedup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{10_000 + i: 10_000 for i in range(n)}, **{30_000 + i: 30_000 for i in range(n + 1)}}
