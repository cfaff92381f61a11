import hashlib
import random
import re

import numpy as np
import pytest
import zstandard
from cases import documents, empty, odd, odd_rows

from propwell.llm import fill_middle as f

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("size", [5, 64, f.FRAME_BYTES])
def test_rows_equal_brute_force(spark, tmp_path, size):
    tricky = ["a <P> b", "ends with <", "<S", "  lead and trail  ", "é x \U0001d518", "x" * 300, " " * 40 + "<P", "<M x >"]
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(100 + i + 50 * k, t) for k in range(30) for i, t in enumerate(tricky)]
    if size == f.FRAME_BYTES:
        rows += documents(spark)
    else:
        rows = [r for r in rows if len(r[1] or "") < 10_000]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = f.output_digests(f.fill_in_middle(f.write_frames(frame, "doc_id", "text", str(tmp_path / "s"), size))).collect()
    assert sorted(map(tuple, got), key=key) == sorted((expected(*r) for r in rows), key=key)


def test_only_cut_frames_are_decompressed_and_replaced():
    compress, decompress = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    rnd = random.Random(3)
    text = "".join(rnd.choices("ab \né", k=5000)).encode()
    frames = f.cut_frames(memoryview(text), 100, compress)
    units = UNITS.findall(text.decode())
    assert frames[-1]["units"] == len(units) and frames[-1]["chars"] == len(text.decode()) and frames[-1]["bytes"] == len(text)
    for low, high in [(0, 0), (0, len(units)), (7, 7), (3, 5), (len(units), len(units)), (100, 900)]:
        reader = f.FrameReader(frames, decompress)
        parts = f.split_frames(frames, [reader.place(low), reader.place(high)], compress)
        texts = [b"".join(map(decompress, p)).decode() for p in parts]
        assert texts == ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]
        assert reader.opened <= 2
        old = {x["frame"] for x in frames}
        assert sum(x not in old for p in parts for x in p) <= 4


def test_markers_across_frames():
    compress, decompress = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    text = b"<P>one <<S>two<M>three"
    for size in (1, 2, 3, 7):
        frames = [compress(text[i : i + size]) for i in range(0, len(text), size)]
        assert b"".join(f.restore(frames, "psm", decompress)) == b"one <threetwo"


def test_a_long_word_stays_within_frames():
    compress = zstandard.ZstdCompressor().compress
    frames = f.cut_frames(memoryview(b"x" * 1_000_000 + b" y"), f.FRAME_BYTES, compress)
    sizes = np.diff([0, *[x["bytes"] for x in frames]])
    assert sizes.max() <= f.FRAME_BYTES + 3 and frames[-1]["units"] == 2 and frames[0]["units"] == 0


def test_clashing_names_and_empty_tables(spark, tmp_path):
    store = f.write_frames(odd(spark).withColumnRenamed("lang", "frames"), "doc_id", "text", str(tmp_path / "a"))
    texts = [r["text"] for r in f.output_texts(f.fill_in_middle(store, rate=0)).collect()]
    assert sorted(texts) == sorted(t or "" for _, t, *_ in odd_rows())
    assert f.output_digests(f.fill_in_middle(f.write_frames(empty(spark), "doc_id", "text", str(tmp_path / "b")))).count() == 0
