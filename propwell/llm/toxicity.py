"""Toxicity by the nearest labelled examples: exact cosine over a block-max inverted index.

Terms are lower-case words and their first four to seven bytes, all that a bounded sample of
labelled rows has. A term weighs its frequency in the text, its inverse document frequency over all
documents, and its relevance: a floor, and more the more it goes with the label beyond chance
(chi-square), so every term counts, and terms that tell count most.

Examples lie in blocks, like ones together; of every term and block the index has the largest weight and the
postings. The commonest terms are a matrix, whose product with the texts is exact per example; its largest in a
block plus the maxima of the other terms bound that block. A text opens the blocks of the largest bounds, and then
only blocks that can still have one of the k nearest. The neighbours are the evidence; their
votes, weighted by cosine, are calibrated by logistic regression on labelled rows, examples left out
of their own votes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propwell.llm import words as W
from propwell.llm.registry import cut_lineage, query, table

#: Bounds of what is gathered to fit: labelled rows (those of smallest hash), examples of the index, and rows to calibrate on.
MOST_LABELLED = 12_000
MOST_EXAMPLES = 2_048
MOST_CALIBRATED = 4_000
#: What a term counts that does not go with the label, and the chi-square that is put down to chance.
LEAST_RELEVANCE = 0.02
CHANCE = 10.8
STEMS = (4, 5, 6, 7)
NEIGHBOURS = 8
BLOCK = 32
#: Blocks that are opened first.
FIRST = 4
THRESHOLD = 0.7
#: Terms whose postings are a matrix, and rows that are compared at a time.
COMMON_TERMS = 2048
ROWS_AT_ONCE = 64
#: Of these, rows whose postings are gathered at a time, so that they stay in a core's cache.
POSTINGS_AT_ONCE = 16


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of lower-case texts, and the row of each."""
    start, end, rows = W.spans(data, offsets, W.NOT_ALNUM)
    sums = W.prefix(W._BYTE[0][data])
    owner = W.row_of(rows)
    hashes, owners = [W.between(sums, start, end)], [owner]
    for n in STEMS:
        longer = end - start > n
        hashes.append(W.mix(W.between(sums, start[longer], start[longer] + n) + np.uint64(n)))
        owners.append(owner[longer])
    return np.concatenate(hashes), np.concatenate(owners)


def _lower_pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return W.pieces(pc.utf8_lower(pc.fill_null(texts, "")))


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct term of each row, with the row's label."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        for first, _, data, offsets in _lower_pieces(batch.column("text")):
            hashes, owner = term_hashes(data, offsets)
            order = np.lexsort((hashes, owner))
            h, o = hashes[order], owner[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[new].view(np.int64)), pa.array(label[first + o[new]])], ["term", "label"]
            )


@dataclass
class Vocabulary:
    """Sorted term hashes; `at` is a table of them by their low bits, `shared` says where several have the same."""

    terms: np.ndarray
    at: np.ndarray | None = None
    shared: np.ndarray | None = None
    BITS = 22

    def __getstate__(self):
        return {"terms": self.terms, "at": None, "shared": None}

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, term number and count of every term of the vocabulary in every row, in order."""
        mask = np.uint64((1 << self.BITS) - 1)
        if self.at is None:
            low = self.terms & mask
            self.at = np.full(1 << self.BITS, -1, np.int32)
            self.at[low] = np.arange(len(self.terms))
            self.shared = np.bincount(low.astype(np.int64), minlength=1 << self.BITS) > 1
        hashes, owner = term_hashes(data, offsets)
        low = hashes & mask
        place = self.at[low].astype(np.int64)
        maybe = np.flatnonzero(place >= 0)
        if not len(maybe):
            return (np.zeros(0, np.int64),) * 3
        hashes, owner, low, place = hashes[maybe], owner[maybe], low[maybe], place[maybe]
        again = np.flatnonzero((self.terms[place] != hashes) & self.shared[low])
        place[again] = np.minimum(np.searchsorted(self.terms, hashes[again]), len(self.terms) - 1)
        hit = self.terms[place] == hashes
        both, count = np.unique(owner[hit] * len(self.terms) + place[hit], return_counts=True)
        return both // len(self.terms), both % len(self.terms), count


class BlockMaxIndex:
    """Unit vectors of examples as an inverted index in blocks of BLOCK examples.

    An entry is a term in a block: its largest weight there, and its postings (examples and weights).
    The terms of the most examples have their postings laid out as a matrix, a weight for every example.
    """

    def __init__(self, start: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int):
        self.n = len(start) - 1
        self.n_blocks = -(-self.n // BLOCK)
        example = np.repeat(np.arange(self.n), np.diff(start))
        common = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:COMMON_TERMS]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        inside = self.column[term] >= 0
        self.matrix = np.zeros((len(common), self.n_blocks * BLOCK))
        self.matrix[self.column[term[inside]], example[inside]] = weight[inside]
        term, example, weight = term[~inside], example[~inside], weight[~inside]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        block = self.example // BLOCK
        self.posting = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.block, own = block[self.posting], term[self.posting]
        self.largest = np.maximum.reduceat(self.weight, self.posting) if len(term) else self.weight
        self.posting = np.append(self.posting, len(term))
        self.entry = np.searchsorted(own, np.arange(n_terms + 1))

    def _open(self, cosine: np.ndarray, opened: np.ndarray, cell: np.ndarray, entry: np.ndarray, weight: np.ndarray) -> None:
        """Add to `cosine` the postings of the opened blocks (a row for each text); a cell is a text and a block."""
        some = np.flatnonzero(opened.ravel()[cell])
        cell, entry, weight = cell[some], entry[some], weight[some]
        first = self.posting[entry]
        length = self.posting[entry + 1] - first
        cells = W.ragged(first, length)
        key = np.repeat(cell // self.n_blocks * cosine.shape[1], length) + self.example[cells]
        cosine += np.bincount(key, np.repeat(weight, length) * self.weight[cells], cosine.size).reshape(cosine.shape)

    def _add_postings(self, cosine: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, without: np.ndarray | None) -> None:
        """Open the blocks of each row of `cosine`, which holds the common terms; the terms are the others."""
        first = self.entry[term]
        length = self.entry[term + 1] - first
        entry = W.ragged(first, length)
        own = np.repeat(weight, length)
        cell = np.repeat(row * self.n_blocks, length) + self.block[entry]
        hidden = np.flatnonzero(without >= 0) if without is not None else np.zeros(0, np.int64)
        own_place = (hidden, without[hidden]) if len(hidden) else (hidden, hidden)
        cosine[own_place] = 0
        bound = cosine.reshape(len(cosine), self.n_blocks, BLOCK).max(axis=2)
        bound += np.bincount(cell, own * self.largest[entry], bound.size).reshape(bound.shape)
        least = -np.partition(-bound, min(FIRST, self.n_blocks) - 1, axis=1)[:, min(FIRST, self.n_blocks) - 1]
        opened = bound >= least[:, None]
        self._open(cosine, opened, cell, entry, own)
        cosine[own_place] = 0
        worst = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
        more = ~opened & (bound > 0) & (bound >= worst[:, None] - 1e-9)
        if more.any():
            self._open(cosine, more, cell, entry, own)
            cosine[own_place] = 0

    def nearest(
        self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n_rows: int, k: int, without: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """For each row the k examples of largest cosine and their cosines, -1 and 0 where fewer are above 0; ties by place.

        Rows are n_rows lists of terms, in order. The common terms are one product with the matrix. Blocks are
        opened in falling order of their bound, the largest of that product plus the sum of the row's other weights
        times the largest of the block: FIRST of them, then all whose bound reaches the k-th cosine so
        far. What a block that stays closed has so far is below its bound, and so below the k-th.
        """
        found, cosines = np.full((n_rows, k), -1), np.zeros((n_rows, k))
        if not self.n:
            return found, cosines
        column = self.column[term]
        inside = column >= 0
        common = np.zeros((n_rows, len(self.matrix)))
        common[row[inside], column[inside]] = weight[inside]
        row, term, weight = row[~inside], term[~inside], weight[~inside]
        cosine = common @ self.matrix
        k_here = min(k, self.n)
        bounds = np.searchsorted(row, np.arange(0, n_rows + POSTINGS_AT_ONCE, POSTINGS_AT_ONCE))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            first = i * POSTINGS_AT_ONCE
            some = slice(first, first + POSTINGS_AT_ONCE)
            self._add_postings(cosine[some], row[a:b] - first, term[a:b], weight[a:b], k_here, None if without is None else without[some])
        at = np.argpartition(-cosine[:, : self.n], k_here - 1, axis=1)[:, :k_here]
        value = np.take_along_axis(cosine, at, axis=1)
        # ties at the k-th cosine go by place
        least = value.min(axis=1)
        for i in np.flatnonzero(((cosine == least[:, None]).sum(axis=1) > 1) & (least > 0)).tolist():
            at[i] = np.lexsort((np.arange(self.n), -cosine[i, : self.n]))[:k_here]
        value = np.take_along_axis(cosine, at, axis=1)
        order = np.lexsort((at, -value), axis=1)
        at, value = np.take_along_axis(at, order, axis=1), np.take_along_axis(value, order, axis=1)
        found[:, :k_here], cosines[:, :k_here] = np.where(value > 0, at, -1), np.maximum(value, 0)
        return found, cosines


def unit_weights(row: np.ndarray, term: np.ndarray, count: np.ndarray, worth: np.ndarray, n_rows: int) -> np.ndarray:
    """Weights of the terms of rows, each row of length 1; `worth` is what a term counts besides how often it occurs."""
    weight = (1 + np.log(count)) * worth[term]
    norm = np.sqrt(np.bincount(row, weight**2, n_rows))
    return weight / norm[row]


@dataclass
class ToxicityModel:
    held: object  # a broadcast: terms, worth, start, term and weight of the examples
    label: np.ndarray
    ids: np.ndarray
    coefficients: np.ndarray

    def tools(self) -> tuple[Vocabulary, np.ndarray, BlockMaxIndex]:
        """The vocabulary, the worth of its terms and the index, made once per worker of a broadcast."""
        held = self.held.value
        if "index" not in held:
            held["vocabulary"] = Vocabulary(held["terms"])
            held["index"] = BlockMaxIndex(held["start"], held["term"], held["weight"], len(held["terms"]))
        return held["vocabulary"], held["worth"], held["index"]

    def near(self, data: np.ndarray, offsets: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nearest examples of each text, and their cosines."""
        vocabulary, worth, index = self.tools()
        n = len(offsets) - 1
        row, term, count = vocabulary.counts(data, offsets)
        weight = unit_weights(row, term, count, worth, n)
        at = np.searchsorted(row, np.arange(n + 1))
        parts = []
        for first in range(0, n, ROWS_AT_ONCE):
            last = min(first + ROWS_AT_ONCE, n)
            some = slice(at[first], at[last])
            parts.append(index.nearest(row[some] - first, term[some], weight[some], last - first, NEIGHBOURS, None if without is None else without[first:last]))
        found, cosines = zip(*parts, strict=True)
        return np.concatenate(found), np.concatenate(cosines)

    def votes(self, found: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Per row: the toxic and the other votes, and the toxic share of both (that of the examples without any)."""
        toxic = (cosines * self.label[found]).sum(axis=1)  # -1 has no cosine
        total = cosines.sum(axis=1)
        share = np.where(total > 0, toxic / np.where(total > 0, total, 1), self.label.mean())
        return np.c_[toxic / NEIGHBOURS, (total - toxic) / NEIGHBOURS, share]

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.coefficients[0] + votes @ self.coefficients[1:])))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, weight: np.ndarray | None = None) -> np.ndarray:
    """Intercept and coefficients of a ridge logistic regression, by Newton's method on scaled columns."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1.0)
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    penalty = np.r_[1e-6, np.full(x.shape[1], ridge)] * len(x) / 100
    w = np.ones(len(x)) if weight is None else weight
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (w * (y - p)) - penalty * b)
        size = np.abs(step).max()
        b += step * min(1.0, 4.0 / max(size, 1e-9))
        if size < 1e-6:
            break
    slope = b[1:] / spread
    return np.r_[b[0] - slope @ mean, slope]


def _term_documents(held):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = held.value
        if "vocabulary" not in tools:
            tools["vocabulary"] = Vocabulary(tools["terms"])
        vocabulary = tools["vocabulary"]
        total = np.zeros(len(vocabulary.terms) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, data, offsets in _lower_pieces(batch.column("text")):
                total[:-1] += np.bincount(vocabulary.counts(data, offsets)[1], minlength=len(vocabulary.terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    return count


def relevance(with_term: np.ndarray, without: np.ndarray, toxic: int, n: int) -> np.ndarray:
    """How much a term counts: LEAST_RELEVANCE, and more the more it goes with the label beyond chance.

    Takes the numbers of toxic and of other rows that have the term, and of toxic and of all rows.
    """
    a, b = with_term, without
    c, d = toxic - a, (n - toxic) - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = float(n) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    return LEAST_RELEVANCE + np.sqrt(np.maximum(np.nan_to_num(chi) - CHANCE, 0) / n)


def fit(documents: DataFrame, labelled: DataFrame) -> ToxicityModel | float:
    """A model from `documents` (doc_id, text) and `labelled` (doc_id, label 0/1).

    Of at most MOST_LABELLED labelled ids (those of smallest hash; of rows that share an id one, the
    first by text) up to MOST_EXAMPLES become examples, half of them toxic if there are that many; up to MOST_CALIBRATED
    calibrate. Document frequencies are counted over all documents. Without any term, or
    rows of both labels, the share of label 1 (0 if nothing is labelled) is returned instead.
    """
    spark = documents.sparkSession
    by_hash = F.xxhash64("doc_id", F.lit("toxicity"))
    sample = (
        labelled.where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").cast("bigint").alias("label"))
        .orderBy(by_hash, "doc_id")
        .limit(MOST_LABELLED)
    )
    chosen = spark.createDataFrame(sample.toPandas(), "doc_id bigint, label bigint")
    rows = cut_lineage(
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .withColumn("place", by_hash)
    )
    known = rows.select("doc_id", "label", "place").toPandas().sort_values(["place", "doc_id"])
    n, toxic = len(known), int(known["label"].sum())
    share = toxic / n if n else 0.0
    if not 0 < toxic < n:
        return share
    seen = (
        rows.select("label", "text")
        .mapInArrow(_example_terms, "term bigint, label bigint")
        .groupBy("term")
        .agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
        .toArrow()
    )
    if not seen.num_rows:
        return share
    hashes = seen["term"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    terms = hashes[order]
    relevant = relevance(seen["a"].to_numpy()[order], seen["b"].to_numpy()[order], toxic, n)
    counting = spark.sparkContext.broadcast({"terms": terms})
    counted = (
        documents.select("text").mapInArrow(_term_documents(counting), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    )
    frequency = np.zeros(len(terms) + 1)
    frequency[counted["term"].to_numpy()] = counted["n"].to_numpy()
    worth = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1) * relevant
    half = MOST_EXAMPLES // 2
    half = max(half, MOST_EXAMPLES - toxic), max(half, MOST_EXAMPLES - (n - toxic))
    picked = [known[known["label"] == value]["doc_id"].head(half[value]) for value in (0, 1)]
    ids = np.concatenate(picked).astype(np.int64)
    weighing = spark.sparkContext.broadcast({"terms": terms, "worth": worth})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = weighing.value
        vocabulary = Vocabulary(held["terms"])
        for batch in batches:
            for first, end, data, offsets in _lower_pieces(batch.column("text")):
                row, term, count = vocabulary.counts(data, offsets)
                weight = unit_weights(row, term, count, held["worth"], end - first)
                at = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                # like vectors side by side, so that blocks differ in their maxima
                main = [int(term[a + np.argmax(weight[a:b])]) if b > a else -1 for a, b in zip(at[:-1], at[1:], strict=True)]
                own = [batch.column(x).slice(first, end - first) for x in ("doc_id", "label")]
                lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (term.astype(np.int32), weight)]
                yield pa.RecordBatch.from_arrays([pa.array(main, pa.int64()), *own, *lists], ["main", "doc_id", "label", "term", "weight"])

    examples = spark.createDataFrame([(int(i),) for i in ids], "doc_id bigint")
    made = (
        rows.join(F.broadcast(examples), "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(vectors, "main bigint, doc_id bigint, label bigint, term array<int>, weight array<double>")
        .toArrow()
        .sort_by([("label", "ascending"), ("main", "ascending"), ("doc_id", "ascending")])
        .combine_chunks()
    )
    ids, labels = made["doc_id"].to_numpy(), made["label"].to_numpy()
    lists = made["term"].combine_chunks(), made["weight"].combine_chunks()
    start = np.r_[0, np.cumsum(lists[0].value_lengths().to_numpy())].astype(np.int64)
    held = spark.sparkContext.broadcast(
        {
            "terms": terms,
            "worth": worth,
            "start": start,
            "term": lists[0].flatten().to_numpy().astype(np.int64),
            "weight": lists[1].flatten().to_numpy(),
        }
    )
    model = ToxicityModel(held, labels.astype(float), ids, np.zeros(4))
    # calibrated on rows of the sample, examples each left out of their own votes
    calibrating = spark.createDataFrame([(int(i),) for i in known["doc_id"].head(MOST_CALIBRATED)], "doc_id bigint")
    votes = (
        rows.join(F.broadcast(calibrating), "doc_id")
        .select("doc_id", "label", "text")
        .mapInArrow(_voter(model), "label bigint, votes array<double>")
        .toArrow()
    )
    x = votes["votes"].combine_chunks().flatten().to_numpy().reshape(-1, 3)
    model.coefficients = logistic_fit(x, votes["label"].to_numpy().astype(float))
    return model


def _voter(m: ToxicityModel):
    """Votes of labelled rows, examples without themselves."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {i: at for at, i in enumerate(m.ids.tolist())}
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, end, data, offsets in _lower_pieces(batch.column("text")):
                without = np.array([place.get(i, -1) for i in ids[first:end]])
                votes = m.votes(*m.near(data, offsets, without))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(first, end - first), pa.array(list(votes), pa.list_(pa.float64()))], ["label", "votes"]
                )

    return vote


RESULT = "doc_id bigint, score double, neighbours array<bigint>, cosines array<double>"


def _scorer(m: ToxicityModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in _lower_pieces(batch.column("text")):
                found, cosines = m.near(data, offsets)
                there = found >= 0
                bounds = pa.array(np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, end - first),
                        pa.array(m.scores(m.votes(found, cosines))),
                        pa.ListArray.from_arrays(bounds, pa.array(m.ids[found[there]])),
                        pa.ListArray.from_arrays(bounds, pa.array(cosines[there])),
                    ],
                    ["doc_id", "score", "neighbours", "cosines"],
                )

    return score


def score_toxicity(documents: DataFrame, model: ToxicityModel | float) -> DataFrame:
    """doc_id, score in [0, 1], neighbours (ids of labelled examples) and their cosines, for every row.

    Texts without a term of the vocabulary (null and empty ones too) have no neighbours and
    get the score of no votes. Only the text enters the score.
    """
    rows = documents.select("doc_id", "text")
    if isinstance(model, float):
        return rows.select(
            "doc_id",
            F.lit(model).alias("score"),
            F.array().cast("array<bigint>").alias("neighbours"),
            F.array().cast("array<double>").alias("cosines"),
        )
    return rows.mapInArrow(_scorer(model), RESULT)


def is_held_out(doc_id) -> F.Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~is_held_out(F.col("doc_id")))
    model = fit(documents, labels.withColumnRenamed("toxic", "label"))
    scored = score_toxicity(documents, model)
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "neighbours",
        "cosines",
    )
