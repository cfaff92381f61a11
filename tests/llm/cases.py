"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random
import re

SF_DIR = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, class int, `row` string, hash string, label int"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    long = prose(1, 30_000)
    plain = [
        (1, prose(2, 120)),
        (2, prose(2, 120) + " tail"),
        (3, prose(2, 120)),
        (3, prose(2, 120)),
        (3, prose(4, 60)),
        (None, prose(2, 120)),
        (None, None),
        (5, None),
        (6, ""),
        (7, " \t\n"),
        (8, long),
        (9, "é " * 70 + "日本語 𝔘"),
        (10, "one two"),
        (11, "a\tb\nc  d"),
        (-4, prose(5, 80)),
        (13, prose(6, 40) + " " + prose(5, 80)),
    ]
    return [
        (i, t, None if n == 0 else "en", (None, "s1", "", "s2")[n % 4], None if n == 1 else len(t or ""), "k", 1, "r", "h", 0)
        for n, (i, t) in enumerate(plain)
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SHAPE)


def empty(spark):
    return spark.createDataFrame([], SHAPE)


def documents(spark, sf_dir: str = SF_DIR) -> list[tuple[int, str]]:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"] or "") for r in rows]
