import hashlib
import math
import zlib
from collections import Counter, defaultdict

from cases import SF_DIR, WORDS, empty, odd, odd_rows
from pyspark.sql import functions as F

from propwell.llm import exact_dedup, mixing, sharding


def groups(frame, **more):
    return exact_dedup.exact_groups(frame, "doc_id", F.coalesce("text", F.lit("")), **more)


def test_exact_groups_by_bytes(spark):
    for digest in (None, lambda text: F.substring(F.md5(text), 1, 1)):  # the second collides all the time
        got = groups(odd(spark), rank=F.length(F.coalesce("text", F.lit(""))), digest=digest).collect()
        assert len(got) == len(odd_rows())
        size = Counter((t or "") for _, t, *_ in odd_rows())
        for r in got:
            text = r["text"] or ""
            ids = [i for i, t, *_ in odd_rows() if (t or "") == text and i is not None]
            assert r["group_size"] == size[text]
            assert r["keep_id"] == min(ids)
            assert r["kept"] == (r["doc_id"] == r["keep_id"])
            assert r["content_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert r["hash"] == "h" and r["key"] == "k"
    assert groups(empty(spark)).count() == 0


def test_rank_comes_before_id(spark):
    rows = spark.createDataFrame([(2**62, "a b"), (-5, "ab"), (1, " a b ")], "doc_id bigint, text string")
    got = exact_dedup.exact_groups(
        rows, "doc_id", exact_dedup.without_white_space(F.col("text")), rank=F.length("text")
    ).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(1, 3)}


def test_all_ids_null(spark):
    rows = spark.createDataFrame([(None, "x"), (None, "x")], "doc_id bigint, text string")
    assert {(r["keep_id"], r["kept"]) for r in groups(rows).collect()} == {(None, True)}


def uniform(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def test_shards_of_documents(spark):
    got = sharding.op7_sharding(spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert len(got) == len(texts)
    draw = lambda i, s: -math.log(1 - uniform(f"{i}:{s}"))
    for r in got:
        i, raw = r["doc_id"], texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == min(range(8), key=lambda s: draw(i, s))
        assert r["grown_shard"] in (r["shard"], 8)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_odd_rows(spark):
    got = sharding.shard_documents(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_weighted_shards_follow_weights(spark):
    frame = spark.range(20_000).select(sharding.rendezvous_shard(F.col("id"), [1.0, 3.0]).alias("s"))
    assert abs(frame.where("s = 1").count() / 20_000 - 0.75) < 0.02


def test_mix_of_odd_rows(spark):
    got = mixing.mix_documents(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    taken, sizes, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        text = r["row"]["text"] or ""
        assert r["size"] == len(WORDS.findall(text))
        words = r["epochs"] * r["size"] + r["part"]
        assert 0 <= words <= 2 * r["size"]
        assert r["row"]["key"] == "k" and r["row"]["row"] == "r"
        source = r["row"]["source"]
        taken[source] += words
        sizes[source] += r["size"]
        targets[source] = r["target"]
    for source, target in targets.items():
        assert target <= 2 * sizes[source]
        assert abs(taken[source] - target) <= 2
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values()))
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_mix_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b c", "s")] * 5 + [(2, "d e f g", "s"), (3, None, "t")], "doc_id bigint, text string, source string")
    got = mixing.mix_documents(rows).collect()
    total = sum(r["epochs"] * r["size"] + r["part"] for r in got)
    assert abs(total - 1.5 * 19) <= 5  # rows alike give alike, so the cut may miss by less than their number
    assert len({(r["epochs"], r["part"]) for r in got if r["id"] == 1}) == 1


def test_quality_weights_come_first(spark):
    frame = spark.range(4000).select(
        F.col("id"),
        mixing.exponential_key(F.col("id"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0), "t").alias("key"),
    )
    best = frame.orderBy("key").limit(400).where("id % 2 = 0").count()
    assert 0.7 < best / 400 < 0.9
