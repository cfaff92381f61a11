"""Hashes where a match is final, against words that collide under any power series modulo 2^64."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from propwell.llm import near_dedup, token_files, words
from propwell.llm.near_dedup import near_duplicate_classes
from propwell.llm.substring_dedup import without_repeats

ONE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = ONE.translate(str.maketrans("ab", "ba"))


def test_words_and_texts_differ():
    _, _, data, offsets = next(words.pieces(pa.array([ONE, OTHER])))
    start, end, _ = words.spans(data, offsets)
    for seed in (0, 1):
        assert len(set(words.word_hashes(data, start, end, seed).tolist())) == 2
    texts = [" ".join(("yes" if c == "a" else "no") for c in t) for t in (ONE, OTHER)]
    _, _, data, offsets = next(words.pieces(pa.array(texts)))
    assert len(set(zip(*(h.tolist() for h in near_dedup.word_digests(data, offsets)), strict=True))) == 2


def test_hashes_follow_the_bytes_of_a_word_alone():
    rnd = random.Random(0)
    some = ["".join(rnd.choices("ab", k=rnd.choice([1, 7, 8, 9, 16, 255, 256, 257, 700]))) for _ in range(400)]
    _, _, data, offsets = next(words.pieces(pa.array([" ".join(some), " ".join(some[::-1])])))
    start, end, _ = words.spans(data, offsets)
    hashes = words.word_hashes(data, start, end).tolist()
    assert hashes[:400] == hashes[400:][::-1]
    assert len(set(hashes)) == len(set(some))
    back = np.arange(800)[::-1]
    assert words.same_bytes(data, start, end, data, start[back]).all()
    assert words.same_bytes(data, start, end, data, np.roll(start, 1)).tolist() == [
        w == v[: len(w)] for w, v in zip([*some, *some[::-1]], np.roll(np.array([*some, *some[::-1]], object), 1), strict=True)
    ] or len(set(some)) < 400


def test_token_ids_of_such_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = token_files.PieceEncoder(path), Tokenizer.from_file(path)
    for text in (ONE, OTHER, f"x {OTHER} {ONE} {OTHER}"):
        _, _, data, offsets = next(words.pieces(pa.array([text])))
        assert encoder.encode(data, offsets)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_passages_and_near_duplicates_of_such_words(spark):
    rest = " ".join(f"w{i}" for i in range(49))
    rows = spark.createDataFrame([(1, f"{ONE} {rest}"), (2, f"{OTHER} {rest}"), (3, f"{OTHER} {rest}"), (4, ONE), (5, OTHER)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in without_repeats(rows, "doc_id", "text").collect()} == {1: 0, 2: 0, 3: 50, 4: 0, 5: 0}
    classes = {r["doc_id"]: r["class"] for r in near_duplicate_classes(rows, "doc_id", "text").collect()}
    assert classes[4] == 4 and classes[5] == 5


def test_slices_are_whole_words_in_order():
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("ab  é", k=rnd.choice([0, 5, 50, 3000]))) for _ in range(60)] + ["x" * 999 + " y"]
    got = [""] * len(texts)
    for first, end, data, offsets, more in words.slices(pa.array(texts), 100):
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            got[first + i] += data[a:b].tobytes().decode()
        assert not more or end == first + 1
    assert got == texts
