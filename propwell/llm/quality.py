"""Quality by co-training: a classifier of texts and one of page metadata teach each other.

Both views start from a bounded sample of labelled documents. In every round each view is
fitted and calibrated, and labels the documents of an unlabelled pool of which it is most
certain; these pseudo-labels join the other view's rows for the next round. At the end the
calibrated views are combined on labelled rows that neither was fitted on. All documents are then
scored in one pass without a shuffle.

Text view: shares of kinds of characters, lengths and repetition of words and lines, and a
hashed bag of words. Metadata view: language, source and recorded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propwell.llm import words as W
from propwell.llm.registry import query, table
from propwell.llm.toxicity import logistic_fit

#: Bounds of what is gathered to fit: labelled and unlabelled documents, those of smallest hash.
MOST_LABELLED = 12_000
MOST_UNLABELLED = 6_000
ROUNDS = 3
#: Pseudo-labels a view may give per class and round, and how certain it must be.
MOST_GIVEN = 500
CERTAIN = 0.95
BAG = 128
SOURCES = 32
LANGUAGES = 8
ACCEPTED = 0.5

_KINDS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "abcdefghijklmnopqrstuvwxyz",
    "0123456789",
    ".",
    ",;:'\"()-",
    "!",
    "?",
    "#$%&*+/<=>@\\^_`{|}~[]",
    "|",
    "\n",
)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text; null texts are empty."""
    kind = np.zeros((len(_KINDS) + 1, 256), bool)
    for i, characters in enumerate(_KINDS):
        kind[i, [ord(c) for c in characters]] = True
    kind[-1, 128:] = True
    parts = []
    for first, last, data, offsets in W.pieces(texts, W.PIECE_BYTES // 4):
        n = last - first
        size = np.diff(offsets)
        per_byte = 1.0 / np.maximum(size, 1)
        shares = []
        for table_ in kind:
            counted = np.zeros(len(data) + 1, np.int64)
            np.cumsum(table_[data], out=counted[1:])
            shares.append(np.diff(counted[offsets]) * per_byte)
        start, end, rows = W.spans(data, offsets)
        owner, count = W.row_of(rows), np.diff(rows)
        per_word = 1.0 / np.maximum(count, 1)
        length = end - start
        hashes = W.word_hashes(data, start, end)
        again = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])] if len(hashes) else np.zeros(0, bool)
        distinct = _distinct(hashes, owner, n)
        mean = np.bincount(owner, length, n) * per_word
        lines = np.zeros(256, bool)
        lines[10] = True
        line_start, line_end, line_rows = W.spans(data, offsets, lines)
        line_count = np.diff(line_rows)
        line_distinct = _distinct(W.word_hashes(data, line_start, line_end), W.row_of(line_rows), n)
        sums = W.prefix(hashes)
        five = np.flatnonzero(np.arange(len(hashes)) + 5 <= rows[owner + 1]) if len(hashes) else np.zeros(0, np.int64)
        fives = _distinct(W.between(sums, five, five + 5), owner[five], n)
        dense = np.column_stack(
            [
                *shares,
                np.log1p(size),
                np.log1p(count),
                mean,
                np.sqrt(np.maximum(np.bincount(owner, length.astype(float) ** 2, n) * per_word - mean**2, 0)),
                np.bincount(owner, length <= 2, n) * per_word,
                np.bincount(owner, length >= 14, n) * per_word,
                np.bincount(owner, again, n) * per_word,
                distinct * per_word,
                fives / np.maximum(np.bincount(owner[five], minlength=n), 1),
                np.log1p(line_count),
                line_distinct / np.maximum(line_count, 1),
                count / np.maximum(line_count, 1) / (1 + count / np.maximum(line_count, 1)),
            ]
        )
        bag = np.bincount(owner * BAG + (hashes % np.uint64(BAG)).astype(np.int64), minlength=n * BAG).reshape(n, BAG)
        parts.append(np.hstack([dense, dense**2, np.sqrt(bag * per_word[:, None])]))
    return np.vstack(parts) if parts else np.zeros((0, 2 * (len(_KINDS) + 13) + BAG))


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(o[new], minlength=n)


def metadata_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Language and source as hashed indicators (null is a value), and the recorded length."""
    n = len(lang)
    out = np.zeros((n, LANGUAGES + SOURCES + 3))
    for column, begin, width in ((lang, 0, LANGUAGES), (source, LANGUAGES, SOURCES)):
        marked = pa.array([f"={v}" if v is not None else "null" for v in column.to_pylist()], pa.string())
        at = 0
        for first, last, data, offsets in W.pieces(marked):
            place = W.between(W.prefix(W._BYTE[0][data]), offsets[:-1], offsets[1:]) % np.uint64(width)
            out[np.arange(first, last), begin + place.astype(np.int64)] = 1
            at = last
    size = np.array([float(v) if v is not None else 0.0 for v in n_chars.to_pylist()])
    out[:, -3] = np.log1p(np.maximum(size, 0))
    out[:, -2] = out[:, -3] ** 2
    out[:, -1] = n_chars.is_null().to_numpy(zero_copy_only=False)
    return out


@dataclass
class View:
    """A linear classifier with a calibration of its own."""

    coefficients: np.ndarray
    scale: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.coefficients[0] + x @ self.coefficients[1:], -20, 20)
        return self.scale[0] + self.scale[1] * raw


@dataclass
class QualityModel:
    text: View
    metadata: View
    together: np.ndarray

    def scores(self, text: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
        """Probabilities by text, by metadata, and by both."""
        a, b = self.text.logit(text), self.metadata.logit(metadata)
        both = self.together[0] + self.together[1] * a + self.together[2] * b
        return [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (a, b, both)]


def _view(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, ridge: float) -> View:
    c = logistic_fit(x, y, ridge)
    raw = np.clip(c[0] + held_x @ c[1:], -20, 20)
    scale = logistic_fit(raw[:, None], held_y, 1.0) if 0 < held_y.sum() < len(held_y) else np.array([0.0, 1.0])
    return View(c, scale if scale[1] > 0 else np.array([scale[0], 0.0]))


def co_train(
    views: tuple[np.ndarray, np.ndarray],
    label: np.ndarray,
    held: np.ndarray,
    pools: tuple[np.ndarray, np.ndarray],
    rounds: int = ROUNDS,
) -> QualityModel:
    """Fit both views; `held` rows calibrate and combine, and are fitted on by neither."""
    fit_y, held_y = label[~held], label[held]
    extra = [(np.zeros(0, np.int64), np.zeros(0)) for _ in views]
    ridges = (1.0, 1.0)
    fitted: list[View] = []
    for turn in range(rounds + 1):
        fitted = [
            _view(
                np.vstack([x[~held], pool[rows]]),
                np.r_[fit_y, given],
                x[held],
                held_y,
                ridge,
            )
            for x, pool, (rows, given), ridge in zip(views, pools, extra, ridges, strict=True)
        ]
        if turn == rounds or not len(pools[0]):
            break
        for teacher, learner in ((0, 1), (1, 0)):
            p = 1 / (1 + np.exp(-np.clip(fitted[teacher].logit(pools[teacher]), -30, 30)))
            free = np.setdiff1d(np.arange(len(p)), extra[learner][0])
            order = free[np.argsort(p[free], kind="stable")]
            low, high = order[:MOST_GIVEN], order[::-1][:MOST_GIVEN]
            low, high = low[p[low] <= 1 - CERTAIN], high[p[high] >= CERTAIN]
            # as many of each class as their shares among the labels, lest one class takes over
            share = max(fit_y.mean(), 1e-9) / max(1 - fit_y.mean(), 1e-9)
            high, low = high[: int(len(low) * share) + 1], low[: int(len(high) / share) + 1]
            rows, given = extra[learner]
            extra[learner] = (np.r_[rows, low, high], np.r_[given, np.zeros(len(low)), np.ones(len(high))])
    logits = np.column_stack([v.logit(x[held]) for v, x in zip(fitted, views, strict=True)])
    together = logistic_fit(logits, held_y, 1.0) if 0 < held_y.sum() < len(held_y) else np.array([0.0, 1.0, 0.0])
    if (together[1:] < 0).any():  # a view that only adds noise is left out
        together = np.array([0.0, 1.0, 0.0])
    return QualityModel(fitted[0], fitted[1], together)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c) for c in ("doc_id", "label")]
        for x in (
            text_features(batch.column("text")),
            metadata_features(batch.column("lang"), batch.column("source"), batch.column("n_chars")),
        ):
            columns.append(pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.float32).ravel()), x.shape[1]).cast(pa.list_(pa.float32())))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "text", "metadata"])


def fit(documents: DataFrame, labelled: DataFrame) -> QualityModel | float:
    """A model from `documents` (doc_id, text, lang, source, n_chars) and `labelled` (doc_id,
    label 0/1); repeated labels of an id count once, as the largest.

    Gathers at most MOST_LABELLED and MOST_UNLABELLED rows of features. With labels of one
    kind only, their value is returned instead (1 where nothing is labelled).
    """
    spark = documents.sparkSession
    seeded = F.xxhash64("doc_id", F.lit("quality"))
    known = labelled.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    first = known.orderBy(seeded, "doc_id").limit(MOST_LABELLED)
    rest = (
        documents.where("doc_id IS NOT NULL").select("doc_id").join(known, "doc_id", "left_anti").distinct()
        .orderBy(seeded, "doc_id").limit(MOST_UNLABELLED).withColumn("label", F.lit(-1.0))
    )
    chosen = spark.createDataFrame(first.unionByName(rest).toPandas(), "doc_id bigint, label double")
    rows = (
        documents.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "label", "text", "lang", "source", "n_chars")
        .mapInArrow(_gathered, "doc_id bigint, label double, text array<float>, metadata array<float>")
        .toArrow()
        .sort_by("doc_id")
    )
    label = rows["label"].to_numpy()
    known_rows = label >= 0
    if len(set(label[known_rows].tolist())) < 2:
        return float(label[known_rows][0]) if known_rows.any() else 1.0
    views = [
        rows[c].combine_chunks().flatten().to_numpy().reshape(len(label), -1).astype(np.float64) for c in ("text", "metadata")
    ]
    held = np.arange(int(known_rows.sum())) % 4 == 0
    y = label[known_rows]
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
        for value in (0.0, 1.0):
            held[np.flatnonzero(y == value)[::2]] = True
        if len(set(y[~held].tolist())) < 2:
            return float(y.mean())
    return co_train(
        (views[0][known_rows], views[1][known_rows]), y, held, (views[0][~known_rows], views[1][~known_rows])
    )


def _scorer(model: QualityModel, passed: int, viewed: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            view = [batch.column(c) for c in viewed]
            scores = model.scores(text_features(view[0]), metadata_features(*view[1:]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:passed], *[pa.array(s) for s in scores]],
                [f"c{i}" for i in range(passed)] + ["by_text", "by_metadata", "score"],
            )

    return score


def score_quality(documents: DataFrame, model: QualityModel | float, passed: list[str]) -> DataFrame:
    """Columns `passed` (as c0, c1, ...), by_text, by_metadata and score for every row.

    Null texts and null metadata are values like others. Rows are scored one by one, so
    repeated rows have equal scores.
    """
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(passed)]
    if isinstance(model, float):
        return documents.select(*own, *[F.lit(model).alias(c) for c in ("by_text", "by_metadata", "score")])
    # what is passed is not sent a second time to be looked at
    viewed = {c: f"c{passed.index(c)}" if c in passed else f"v{i}" for i, c in enumerate(("text", "lang", "source", "n_chars"))}
    view = [F.col(c).alias(v) for c, v in viewed.items() if c not in passed]
    shape = T.StructType(
        [T.StructField(f"c{i}", documents.schema[c].dataType) for i, c in enumerate(passed)]
        + [T.StructField(c, T.DoubleType()) for c in ("by_text", "by_metadata", "score")]
    )
    return documents.select(*own, *view).mapInArrow(_scorer(model, len(passed), list(viewed.values())), shape)


def quality_model(spark: SparkSession, documents: DataFrame, sf_dir: str) -> QualityModel | float:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "label")
    return fit(documents, labels)


@query()
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_quality(documents, quality_model(spark, documents, sf_dir), ["doc_id"])
    return scored.select(
        F.col("c0").alias("doc_id"), "by_text", "by_metadata", "score", (F.col("score") >= ACCEPTED).alias("accepted")
    )
