import itertools
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import SF_DIR, documents, empty, odd, odd_rows
from tokenizers import Tokenizer

from propwell.llm import packing as p
from propwell.llm import words

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 300)
    rnd = random.Random(0)
    texts = ["a  b", "it's they'll 'VE ", "x<|endoftext|>y <|startoftext|>", "é ́n", "　 a\x85b\x1cc d", "", "ΑΣ Σ İ ß ﬁ", "12345 !!?"]
    texts += ["".join(rnd.choices(" ''sStTvVlLrRdDmMeE.|<>1Aé", k=40)) for _ in range(2000)]
    texts += ["".join(rnd.choices(["<|endoftext|>", "<|ENDOFTEXT|>", "a", "B'", " ", "1", "-", "\u0301"], k=12)) for _ in range(500)]
    texts += ["".join(rnd.choices(" \t\n\r\x0b  éa1.'sß日𝔘!É", k=40)) for _ in range(500)]
    encoder = p.WordEncoder(PATH)
    for first, end, data, offsets in words.pieces(pa.array(texts), 2000):
        ids, count = encoder.encode(data, offsets)
        for text, part in zip(texts[first:end], np.split(ids, np.cumsum(count)[:-1]), strict=True):
            assert part.tolist() == ids_of(text)[:-1], text


def test_best_fill_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        counts = {n: rnd.randint(1, 3) for n in rnd.sample(range(1, 30), rnd.randint(1, 4))}
        room = rnd.randint(0, 60)
        sums = {sum(n * k for n, k in zip(counts, ks, strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))}
        best, taken = p.fill_window(sorted(counts, reverse=True), counts, room)
        assert best == max(s for s in sums if s <= room)
        assert sum(n * k for n, k in taken.items()) == best and all(k <= counts[n] for n, k in taken.items())


@pytest.mark.parametrize("histogram", [{}, {7: 1}, {64: 5}, {40: 1000}, {33: 10**9, 31: 10**9 + 5, 3: 7}, {n: n % 5 + 1 for n in range(1, 64)}])
def test_patterns_use_every_length(histogram):
    patterns, left = p.pack_lengths(histogram, 64, 2)
    used = Counter(left)
    for times, taken in patterns:
        assert 62 <= sum(n * k for n, k in taken.items()) <= 64
        for n, k in taken.items():
            used[n] += times * k
    assert used == Counter(histogram) and len(patterns) <= len(histogram) + 1


def judge(got, rows, capacity=4096):
    """Every id in one piece, offsets without gaps, ids those of the tokenizer; the padding."""
    texts, by_doc, by_sequence = defaultdict(list), defaultdict(list), defaultdict(list)
    for i, text in rows:
        texts[i].append(ids_of(text))
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, all_ids in texts.items():
        assert {r["doc_tokens"] for r in by_doc[i]} == {len(x) for x in all_ids}
        if len(all_ids) == 1:
            parts = sorted(by_doc[i], key=lambda r: r["start"])
            assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1].tolist()]
            for r in parts:
                own = np.array(all_ids[0][r["start"] : r["start"] + r["length"]], "<u4")
                assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
        else:
            assert sum(r["length"] for r in by_doc[i]) == sum(map(len, all_ids))
    padding = 0
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        sizes = [r["length"] for r in parts]
        assert [r["offset"] for r in parts] == [0, *np.cumsum(sizes)[:-1].tolist()]
        total = sum(sizes)
        assert total <= capacity
        padding += 0 if total & (total - 1) == 0 else capacity - total
    return padding, sum(r["length"] for r in got)


def test_documents(spark):
    rows = documents(spark)
    got = p.op11_packing(spark, SF_DIR).collect()
    padding, total = judge(got, rows)
    assert padding <= 0.005 * total
    assert len({r["sequence_id"] for r in got}) <= total // 4096 + 13


@pytest.mark.parametrize("capacity", [16, 64, 4096])
def test_odd_rows(spark, capacity):
    frame = odd(spark).repartition(5)
    sequences = p.pack(frame.withColumnRenamed("lang", "ids").withColumnRenamed("key", "length"), "doc_id", "text", PATH, capacity=capacity)
    got = p.piece_digests(sequences).collect()
    padding, total = judge(got, [(i, t) for i, t, *_ in odd_rows()], capacity)
    assert padding <= 4 * (total // capacity + 1)
    for r in sequences.collect():
        assert len(r["ids"]) in (capacity, r["n_tokens"]) and set(r["ids"][r["n_tokens"] :]) <= {0}


def test_equal_lengths_and_empty_tables(spark):
    rows = [(i, "one two three " * 9) for i in range(500)]
    got = p.piece_digests(p.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", PATH, capacity=64)).collect()
    assert judge(got, rows, 64)[0] == 0
    assert p.pack(empty(spark), "doc_id", "text", PATH).count() == 0


def test_a_long_text_in_slices(spark, monkeypatch):
    rows = [(1, "word another " * 400_000), (2, "x")]
    got = p.piece_digests(p.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", PATH)).collect()
    assert judge(got, rows)[0] <= 4


def test_memory_of_new_words(monkeypatch):
    """A batch of words that are all new takes little memory: few words are with the tokenizer at a time."""
    most = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            if name.startswith("encode"):
                return lambda given, **kw: (most.append(sum(map(len, given))), getattr(self.inner, name)(given, **kw))[1]
            return getattr(self.inner, name)

    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyzéß", k=8)) for _ in range(200)) for _ in range(1500)]
    encoder = p.WordEncoder(PATH)
    encoder.tokenizer = Counted(encoder.tokenizer)
    monkeypatch.setattr(p, "worker_encoder", lambda path: encoder)
    monkeypatch.setattr(p.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in p._cutter(PATH, 2, 4096)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts) and max(most) < 50_000 and peak < 100 << 20, (n, max(most), peak >> 20)
    ids, count = encoder.encode(*next(words.pieces(pa.array(texts[:20])))[2:])
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [ids_of(t)[:-1] for t in texts[:20]]


def test_words_that_bars_and_suffixes_do_not_tell_apart():
    """A tokenizer of other parts: ids and counts per word are those of words given one by one."""
    texts = ["a|b | || <|endoftext|> é|é", "　 é　ä ̸x 's s' ' it's", "\x01 \x7f ​", "ÀB12 c3po ...é"]
    encoder = p.WordEncoder(PATH)
    for closes, bar in ((encoder.closes, encoder.bar), (np.zeros_like(encoder.closes), -1)):
        encoder._forget()
        encoder.closes, encoder.bar = closes, bar
        ids, count = encoder.encode(*next(words.pieces(pa.array(texts)))[2:])
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [ids_of(t)[:-1] for t in texts]
