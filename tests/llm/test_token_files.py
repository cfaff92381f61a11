import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from cases import documents, empty, odd, odd_rows
from tokenizers import Tokenizer

from propwell.llm import token_files as t
from propwell.llm import words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(t, "REMEMBERED", 200)
    tokenizer = Tokenizer.from_file(PATH)
    rnd = random.Random(0)
    texts = ["a  b", "it's they'll 've  ", "x <|endoftext|> y", "é  n", "　 a", ""]
    texts += ["".join(rnd.choices(" \t\n  éa1.'sß日𝔘!", k=40)) for _ in range(500)]
    encoder = t.PieceEncoder(PATH)
    for first, end, data, offsets in words.pieces(pa.array(texts), 2000):
        ids, count = encoder.encode(data, offsets)
        parts = np.split(ids, np.cumsum(count)[:-1])
        for text, part in zip(texts[first:end], parts, strict=True):
            assert part.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_documents_and_odd_rows(spark, tmp_path):
    for name, rows, frame in (
        ("a", documents(spark), None),
        ("b", [r[:2] for r in odd_rows()], odd(spark)),
    ):
        frame = frame or spark.createDataFrame(rows, "doc_id bigint, text string")
        manifest = t.write_token_files(frame.repartition(3), "doc_id", "text", str(tmp_path / name), PATH, length=64, per_batch=8)
        got = sorted((tuple(r) for r in t.token_digests(manifest).collect()), key=lambda r: r[1])
        assert got == expected(rows)
    assert t.write_token_files(empty(spark), "doc_id", "text", str(tmp_path / "c"), PATH).count() == 0


def test_random_access(spark, tmp_path):
    frame = spark.createDataFrame(documents(spark), "doc_id bigint, text string")
    manifest = t.write_token_files(frame, "doc_id", "text", str(tmp_path / "x"), PATH, length=32, per_batch=4)
    for file in manifest.collect():
        stream = np.concatenate([ids for _, some in t.read_documents(file["path"], file["places_path"]) for ids in some])
        for i in {0, 5, (len(stream) - 1) // 32}:
            ids, mask = t.sequence_at(file["path"], file["first_batch"], file["batch_bytes"], i, per_batch=4)
            assert len(ids) == len(mask) == 32
            assert ids[mask].tolist() == stream[32 * i : 32 * i + 32].tolist()
