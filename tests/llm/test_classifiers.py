from collections import Counter

import numpy as np
import pytest
from cases import SF_DIR, empty, odd, odd_rows, prose
from pyspark.sql import functions as F

from propwell.llm import quality, toxicity

BIG = "/root/testdata/sf0.01"


def labels(spark, column, sf_dir=BIG):
    return {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


@pytest.mark.parametrize("common", [0, 20, 1024])
def test_nearest_is_exact(monkeypatch, common):
    monkeypatch.setattr(toxicity, "COMMON_TERMS", common)
    rng = np.random.default_rng(1)
    n, terms = 500, 60
    rows = [np.sort(rng.choice(terms, rng.integers(1, 8), replace=False)) for _ in range(n)]
    start = np.r_[0, np.cumsum([len(r) for r in rows])]
    term = np.concatenate(rows)
    weight = rng.random(len(term))
    weight /= np.sqrt(np.add.reduceat(weight**2, start[:-1]))[np.repeat(np.arange(n), np.diff(start))]
    dense = np.zeros((n, terms))
    dense[np.repeat(np.arange(n), np.diff(start)), term] = weight
    index = toxicity.BlockMaxIndex(start, term, weight, terms)
    some = np.arange(0, n, 7)
    row = np.repeat(np.arange(len(some)), np.diff(start)[some])
    cells = np.concatenate([np.arange(start[i], start[i + 1]) for i in some])
    found, cosines = index.nearest(row, term[cells], weight[cells], len(some), 8, without=some)
    for i, at, cosine in zip(some, found, cosines, strict=True):
        all_ = dense @ dense[i]
        all_[i] = 0
        best = np.sort(all_[all_ > 0])[::-1][:8]
        assert np.allclose(cosine[: len(best)], best) and np.allclose(all_[at[: len(best)]], best)
        assert (at[len(best) :] == -1).all() and not cosine[len(best) :].any()


def test_blocks_that_cannot_count_stay_closed(monkeypatch):
    monkeypatch.setattr(toxicity, "COMMON_TERMS", 5)
    n, opened = 640, []
    start, term = np.arange(n + 1), np.repeat(np.arange(n // toxicity.BLOCK), toxicity.BLOCK)
    index = toxicity.BlockMaxIndex(start, term, np.ones(n), n // toxicity.BLOCK)
    inner = index._open
    monkeypatch.setattr(index, "_open", lambda cosine, blocks, *rest: (opened.append(int(blocks.sum())), inner(cosine, blocks, *rest)))
    found, _ = index.nearest(np.zeros(10, int), np.arange(10), np.r_[0.9, 0.08, 0.07, 0.06, np.full(6, 0.05)], 1, 8)
    assert found.tolist() == [list(range(8))] and opened[0] < 20 and len(opened) == 1


def test_common_terms_of_unlike_examples_open_no_block(monkeypatch):
    """Examples that share no common term do not add up to a bound that opens their block."""
    monkeypatch.setattr(toxicity, "COMMON_TERMS", 32)
    size, blocks, opened = toxicity.BLOCK, 20, 0
    start = np.r_[np.arange(0, size * 32 + 1, 32), size * 32 + np.arange(1, size * (blocks - 1) + 1)]
    term = np.r_[np.tile(np.arange(32), size), np.tile(np.arange(size) % 32, blocks - 1)]
    weight = np.r_[np.full(size * 32, 32**-0.5), np.repeat(0.5 + np.arange(1, blocks) / 100, size)]
    index = toxicity.BlockMaxIndex(start, term, weight, 33)
    inner = index._open

    def counted(cosine, which, *rest):
        nonlocal opened
        opened += int(which.sum())
        inner(cosine, which, *rest)

    monkeypatch.setattr(index, "_open", counted)
    n = 3 * toxicity.ROWS_AT_ONCE // 4
    found, cosines = index.nearest(np.repeat(np.arange(n), 32), np.tile(np.arange(32), n), np.full(32 * n, 32**-0.5), n, 8)
    assert found.tolist() == [list(range(8))] * n and np.allclose(cosines, 1)
    assert opened == toxicity.FIRST * n


def test_neighbours_are_the_nearest_by_all_terms(spark):
    """Rows without a telling term have neighbours too, and the right ones."""
    rows = [(i, prose(i, 40) + (" vilewordy grumblor" if i % 5 == 0 else "")) for i in range(200)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    marked = [i for i in range(200) if i % 2]
    model = toxicity.fit(documents, spark.createDataFrame([(i, int(i % 5 == 0)) for i in marked], "doc_id bigint, label int"))
    bags = [
        Counter(x for w in t.lower().replace("!", "").split() for x in [(0, w), *((n, w[:n]) for n in toxicity.STEMS if len(w) > n)])
        for _, t in rows
    ]
    known = {x for i in marked for x in bags[i]}
    df = Counter(x for bag in bags for x in bag)
    per_label = [Counter(x for i in marked if (i % 5 == 0) == y for x in bags[i]) for y in (False, True)]
    n_toxic = sum(i % 5 == 0 for i in marked)
    relevant = {x: toxicity.relevance(np.array([per_label[1][x]]), np.array([per_label[0][x]]), n_toxic, len(marked))[0] for x in known}
    vectors = [{x: (1 + np.log(c)) * (np.log(201 / (1 + df[x])) + 1) * relevant[x] for x, c in bag.items() if x in known} for bag in bags]
    norms = [np.sqrt(sum(w * w for w in v.values())) for v in vectors]
    for r in toxicity.score_toxicity(documents, model).collect():
        i = r["doc_id"]
        cosines = sorted((sum(w * vectors[j].get(x, 0) for x, w in vectors[i].items()) / norms[i] / norms[j] for j in marked), reverse=True)
        assert len(r["neighbours"]) == 8 and np.allclose(r["cosines"], cosines[:8], atol=1e-6)


def test_repeated_ids_are_fitted_once(spark):
    rows = [(i % 40, prose(i % 40, 30) + (" vilewordy" if i % 4 == 0 else "")) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(documents, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id bigint, label int"))
    assert len(model.ids) == 40


def test_toxicity_is_learnt(spark):
    rows, marked = [], []
    for i in range(600):
        toxic = i % 5 == 0
        rows.append((i, prose(i, 60) + (" Vilewordy vilewordos, grumblor!" if toxic else "")))
        if i % 2:
            marked.append((i, int(toxic)))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(documents, spark.createDataFrame(marked, "doc_id bigint, label int"))
    for r in toxicity.score_toxicity(documents, model).collect():
        assert (r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 5 == 0)
        assert len(r["neighbours"]) == len(r["cosines"])
    got = toxicity.score_toxicity(odd(spark), model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] < toxicity.THRESHOLD for r in got)
    assert toxicity.score_toxicity(empty(spark), model).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert toxicity.fit(documents, none) == 0.0
    assert {r["score"] for r in toxicity.score_toxicity(odd(spark), 0.0).collect()} == {0.0}


def test_toxicity_of_documents(spark):
    larger = "/root/testdata/sf0.1"
    truth = labels(spark, "toxic", larger)
    got = [r for r in toxicity.op5_toxicity(spark, larger).collect() if r["held_out"] and r["doc_id"] in truth]
    clean = [r["predicted"] for r in got if truth[r["doc_id"]] == 0]
    toxic = [r["predicted"] for r in got if truth[r["doc_id"]] == 1]
    assert sum(clean) / len(clean) < 0.01
    assert sum(toxic) / len(toxic) >= 0.9


def test_quality_of_documents(spark):
    truth = labels(spark, "quality")
    got = quality.op2_quality(spark, BIG).collect()
    good = [r["accepted"] for r in got if truth.get(r["doc_id"]) == 1]
    bad = [r["accepted"] for r in got if truth.get(r["doc_id"]) == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_views_teach_each_other():
    """The text view alone has few labels; certain metadata labels widen it."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2200).astype(float)
    text = np.c_[y[:, None] + rng.normal(0, 0.8, (2200, 12)), rng.normal(0, 1, (2200, 20))]
    page = np.c_[y[:, None] * 4 + rng.normal(0, 0.7, (2200, 2)), rng.normal(0, 1, (2200, 2))]
    known = np.arange(2200) < 60
    held = np.arange(60) % 2 == 0
    accuracy = []
    for rounds in (0, 3):
        model = quality.co_train((text[known], page[known]), y[known], held, (text[~known], page[~known]), rounds)
        accuracy.append(((model.text.logit(text[~known]) > 0) == (y[~known] == 1)).mean())
    assert accuracy[1] > accuracy[0]


def test_quality_of_odd_rows(spark):
    model = quality.fit(
        spark.read.parquet(f"{SF_DIR}/documents.parquet"),
        spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", F.col("quality").alias("label")),
    )
    got = quality.score_quality(odd(spark), model, ["doc_id", "label", "row"]).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["c2"] for r in got} == {"r"}
    assert quality.score_quality(empty(spark), model, ["doc_id"]).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert quality.fit(odd(spark), none) == 1.0
    assert quality.fit(empty(spark), none) == 1.0
