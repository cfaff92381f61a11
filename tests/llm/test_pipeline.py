from collections import Counter
from pathlib import Path

import pytest
from cases import SF_DIR, WORDS, documents, empty, odd
from test_substring_near import classes

import corpus_pipeline as p

STAGES = dict(p.STAGES)


def test_stages_in_order():
    assert [name for name, _ in p.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_odd_and_empty_tables(spark, tmp_path, name):
    got = STAGES[name](spark, odd(spark), SF_DIR)
    got.write.parquet(str(tmp_path / "odd"))
    assert got.columns == odd(spark).columns
    assert all(r["key"] == "k" and r["row"] == "r" for r in spark.read.parquet(str(tmp_path / "odd")).collect())
    assert STAGES[name](spark, empty(spark), SF_DIR).count() == 0


def written(spark) -> Counter:
    """Checkpoints by their number of files."""
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return Counter({str(d): len([*d.glob("part-*")]) for d in folder.glob("rdd-*")})


def test_small_tables_make_few_files(spark):
    held = {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    p.drop_near_duplicates(spark, docs.limit(1), SF_DIR)  # sets the folder
    before, kept = written(spark), {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        p.drop_near_duplicates(spark, docs, SF_DIR)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = written(spark) - before
    assert len(files) > 10 and max(files.values()) <= 24


@pytest.mark.parametrize("name", ["quality", "near_dedup"])
def test_texts_go_to_python_once(spark, name):
    plan = STAGES[name](spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR)._jdf.queryExecution()
    found = []

    def walk(node):
        if node.nodeName() == "MapInArrow":
            found.append(node.children().apply(0).schema().treeString().count(": string"))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan.optimizedPlan())
    assert found == [3]  # text, lang and source


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = p.drop_near_duplicates(spark, docs, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(min(c) for c in classes(documents(spark)))


def test_mix_repeats_whole_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = dict(documents(spark))
    got = p.mix_sources(spark, docs, SF_DIR).collect()
    assert all(texts[r["doc_id"]] == (r["text"] or "") for r in got)
    taken = Counter(r["doc_id"] for r in got)
    assert max(taken.values()) <= 2
    size = {i: len(WORDS.findall(t)) for i, t in texts.items()}
    by_source, of_source, largest = Counter(), Counter(), Counter()
    for r in docs.select("doc_id", "source").collect():
        by_source[r["source"]] += taken[r["doc_id"]] * size[r["doc_id"]]
        of_source[r["source"]] += size[r["doc_id"]]
        largest[r["source"]] = max(largest[r["source"]], size[r["doc_id"]])
    targets = {r["source"]: r["target"] for r in p.mixing.mix_documents(docs).select("row.source", "target").distinct().collect()}
    for source, target in targets.items():
        assert abs(by_source[source] - target) <= largest[source] / 2 + 1


def test_mix_prefers_high_scores(spark):
    rows = spark.range(600).selectExpr("id AS doc_id", "repeat('a ', 20) AS text", "'s' AS source", "IF(id % 2 = 0, 1.0D, 0.1D) AS score")
    taken = {r["row"]["doc_id"]: r["epochs"] * 20 + r["part"] for r in p.mixing.mix_documents(rows, "score").collect()}
    assert sum(taken[i] for i in range(0, 600, 2)) > 1.3 * sum(taken[i] for i in range(1, 600, 2))


def test_run(spark):
    got = p.run(spark, SF_DIR).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
