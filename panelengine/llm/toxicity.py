"""Toxicity by nearest labelled examples.

A bounded sample of labelled training rows becomes an inverted index of TF-IDF vectors; every
whole text of the corpus is scored by its nearest examples under exact cosine similarity. The
neighbours vote with weights that fall with their distance; an isotonic fit on the votes that
the examples get from each other turns votes into probabilities, and the nearest examples are
the evidence.

The index is block-max: examples stand in blocks, and a term that many of them have keeps its
greatest weight in each block. A text first adds up the postings of its rarer terms; with the
maxima of the others this bounds the similarity in each block. Blocks are opened in falling
order of their bound, until no bound reaches the k-th similarity found.

Terms are words, and word beginnings whose share of toxic examples cannot be chance: the
Chernoff bound on it is held against the number of terms tried. The same evidence raises the
weight of a word, and removes none. A text's norm is over all its words, whether an example has
them or not. Terms are 64-bit hashes; document frequencies are counted over all documents in
2^20 cells of them, so what the driver holds grows with the sample alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_WORDS, as_table, joined, per_text, prepare, range_hashes, utf8
from .decontaminate import words_of

#: labelled rows the index is fitted on, at most: those with the smallest hash of their id; and
#: bytes of their texts, the first of which is taken whatever its length
SAMPLE = 4000
SAMPLE_BYTES = 64 << 20
#: words, and word beginnings, that weigh more by evidence at most, the most telling first
TERMS = 4096
NEIGHBOURS = 15
THRESHOLD = 0.3
#: examples of a block
BLOCK = 32
#: share of the examples from which on a term has block maxima and rows instead of postings
COMMON = 0.15
EVIDENCE = 3
#: bytes of the word beginnings
BEGINNINGS = (4, 5, 6, 7, 8)
#: chance of a single wrong term, over all terms
ALPHA = 0.05
#: cells that document frequencies are counted in
CELLS = 1 << 20
#: marks the hash of a beginning
_BEGINS = np.uint64(0x5851F42D4C957F2D)


def is_training(id_column):
    """Labels are learned only from rows whose crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4 != 2


def text_terms(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words, their counts, hashes of all beginnings, the word of each); words
    are distinct, beginnings are not."""
    counted = Counter(words_of(text))
    words = list(counted)
    s, start, end = joined(words)
    which, stop = [np.arange(len(words))], [end]
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        which.append(long)
        stop.append(start[long] + n)
    if sum(map(len, which)) <= BLOCK_WORDS:  # all in one pass over the bytes
        both = np.concatenate(which)
        found = np.split(range_hashes(s, start[both], np.concatenate(stop)), np.cumsum([len(w) for w in which])[:-1])
    else:
        found = [range_hashes(s, start[w], e) for w, e in zip(which, stop, strict=True)]
    begins = np.concatenate([h * _BEGINS + np.uint64(n) for h, n in zip(found[1:], BEGINNINGS, strict=True)])
    return found[0], np.fromiter(counted.values(), np.int64, len(words)), begins, np.concatenate(which[1:])


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


class Weights:
    """TF-IDF of a text's terms: ``have`` counts the documents by cell, ``words`` and ``begins``
    are rising hashes with the factors that evidence gives."""

    def __init__(self, total: int, have: np.ndarray, words: tuple[np.ndarray, np.ndarray], begins: tuple[np.ndarray, np.ndarray]):
        self.idf = np.log((1 + total) / (1 + have)) + 1
        self.words, self.begins = words, begins

    @staticmethod
    def factors(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The factor of each hash; 0 where it has none."""
        keys, factors = table
        if not len(keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, factors[at], 0.0)

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Rising hashes of the terms and their weights, a unit vector over all of them."""
        hashes, counts, begins, owner = text_terms(text)
        factor = self.factors(self.words, hashes)
        weight = (1 + np.log(counts)) * self.idf[cells(hashes)] * np.where(factor > 0, factor, 1.0)
        factor = self.factors(self.begins, begins)
        told = np.flatnonzero(factor)
        if len(told):
            keys, first, which = np.unique(begins[told], return_index=True, return_inverse=True)
            often = np.bincount(which, counts[owner[told]])
            hashes = np.concatenate([hashes, keys])
            weight = np.concatenate([weight, (1 + np.log(often)) * self.idf[cells(keys)] * factor[told][first]])
        norm = math.sqrt(float(weight @ weight))
        order = np.argsort(hashes)
        return hashes[order], (weight / norm)[order] if norm else weight


class BlockMaxIndex:
    """Exact top-k cosine over sparse vectors ``[(terms, weights), ...]`` of rising terms.

    Examples are put into blocks by their heaviest term, so that like stands with like. Terms of
    few examples have postings; the others have a row of weights over the examples and one of
    block maxima. ``opened`` and ``passed`` count the blocks that were looked into or not.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
        self.n, self.block = len(vectors), block
        sizes = [len(t) for t, _ in vectors]
        terms = np.concatenate([np.empty(0, np.uint64), *(np.asarray(t, np.uint64) for t, _ in vectors)])
        weights = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        heavy = [int(t[np.argmax(w)]) if len(t) else 0 for t, w in vectors]
        self.order = np.array(sorted(range(self.n), key=lambda i: (heavy[i], i)), np.int64)  # place -> example
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        example = np.repeat(place, sizes)
        self.terms, number = np.unique(terms, return_inverse=True)
        have = np.bincount(number, minlength=len(self.terms))
        often = have > max(1, COMMON * self.n)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.blocks = -(-self.n // block)
        full = often[number]
        rows = np.zeros((self.blocks * block, int(often.sum())))
        rows[example[full], self.row[number[full]]] = weights[full]
        self.rows = rows.reshape(self.blocks, block, rows.shape[1])
        self.maxima = self.rows.max(1)
        by_term = np.argsort(number[~full], kind="stable")
        self.example, self.weight = example[~full][by_term].astype(np.int32), weights[~full][by_term]
        self.start = np.concatenate([[0], np.cumsum(np.where(often, 0, have))])
        self.opened = self.passed = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave_out: int = -1) -> list[tuple[float, int]]:
        """The k most similar examples with a positive similarity, ties by number."""
        if not self.n or not len(terms):
            return []
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        number, weights = at[known], weights[known]
        first = self.start[number]
        size = self.start[number + 1] - first
        ends = np.cumsum(size)
        some = np.zeros(self.blocks * self.block)
        if len(ends) and ends[-1]:
            where = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
            some = np.bincount(self.example[where], self.weight[where] * np.repeat(weights, size), len(some))
        row = self.row[number]
        common = np.zeros(self.rows.shape[2])
        common[row[row >= 0]] = weights[row >= 0]
        some = some.reshape(self.blocks, self.block)
        bounds = some.max(1) + self.maxima @ common
        falling = np.argsort(-bounds, kind="stable")
        falling = falling[: np.searchsorted(-bounds[falling], 0)]  # a bound of 0 holds nothing
        best: list[tuple[float, int]] = []
        opened = 0
        least, done, step = 0.0, 0, max(1, -(-2 * k // self.block))
        # sums in another order may differ in their last bits: a bound that comes near is opened
        while done < len(falling) and (len(best) < k or bounds[falling[done]] > least - 1e-9):
            now = falling[done : done + step]
            if len(best) == k:
                now = now[bounds[now] > least - 1e-9]
            places = (now[:, None] * self.block + np.arange(self.block)).ravel()
            scores = np.round(some[now].ravel() + self.rows[now].reshape(len(places), -1) @ common, 12)
            hit = np.flatnonzero((scores > 0) & (scores >= least))
            best += [(s, int(e)) for s, e in zip(scores[hit].tolist(), self.order[places[hit]], strict=True) if e != leave_out]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
            least = best[-1][0] if len(best) == k else 0.0
            done += step
            opened += len(now)
            step = 4 * step
        self.passed += self.blocks - opened
        self.opened += opened
        return best


class Model:
    """Weights of terms, index, labels and the calibration. ``examples``: (id, label, text)."""

    def __init__(self, weights: Weights, examples: list[tuple[int, int, bytes]], neighbours: int = NEIGHBOURS):
        self.weights, self.k = weights, neighbours
        vectors = [weights.vector(t) for _, _, t in examples]
        some = [i for i, v in enumerate(vectors) if len(v[0])]
        self.ids = [examples[i][0] for i in some]
        self.labels = np.array([examples[i][1] for i in some], np.float64)
        vectors = [vectors[i] for i in some]
        self.index = BlockMaxIndex(vectors)
        self.prior = (sum(e[1] for e in examples) + 0.5) / (len(examples) + 1)
        votes = np.array([self.vote(self.index.nearest(*v, neighbours, leave_out=i)) for i, v in enumerate(vectors)])
        self.steps = isotonic(votes, self.labels)
        left = set(some)
        rest = [e[1] for i, e in enumerate(examples) if i not in left]
        self.without = (sum(rest) + self.prior) / (len(rest) + 1)

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic examples, weighted by closeness and drawn to the prior by one far vote."""
        w = np.array([1 / (0.05 + max(0.0, 1 - s)) for s, _ in near])
        y = self.labels[[i for _, i in near]] if near else np.zeros(0)
        return float((w @ y + self.prior) / (w.sum() + 1))

    def score(self, text: bytes) -> tuple[float, float, list[tuple[float, int]]]:
        """(score, vote, nearest examples) of a text."""
        near = self.index.nearest(*self.weights.vector(text), self.k)
        vote = self.vote(near)
        return (calibrated(self.steps, vote), vote, near) if near else (self.without, self.prior, near)


def isotonic(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Rising steps (largest x, share of y) by pooling neighbours that fall; a little of the
    overall share is mixed in, so no step is 0 or 1 on few rows."""
    pools: list[list[float]] = []
    for v, t in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        pools.append([v, t, 1])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            v, t, n = pools.pop()
            pools[-1] = [v, pools[-1][1] + t, pools[-1][2] + n]
    mean = float(y.mean()) if len(y) else 0.0
    return [(v, (t + mean) / (n + 1)) for v, t, n in pools]


def calibrated(steps: list[tuple[float, float]], vote: float) -> float:
    """Linear between the steps, so that scores keep the order of votes."""
    if not steps:
        return vote
    x, y = zip(*steps, strict=True)
    return float(np.clip(np.interp(vote, x, np.maximum.accumulate(y)) * 0.98 + 0.02 * vote, 0, 1))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int, most_bytes: int) -> DataFrame:
    """(id, y, text) of at most ``size`` labelled training rows with ``most_bytes`` of text.
    Rows of one id count as toxic if any does; rows without id or label are left out."""
    known = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .where(is_training(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(size)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(known), "id").distinct()  # at most ``size`` pairs of numbers; repeated rows are one example
    rows = as_table(rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(size), "toxicity-sample")
    before = Window.orderBy(F.xxhash64("id"), "id", "h").rowsBetween(Window.unboundedPreceding, -1)
    lengths = rows.select("id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))  # at most ``size`` rows
    fit = lengths.withColumn("before", F.sum("n").over(before)).where((F.coalesce("before", F.lit(0)) == 0) | (F.col("before") + F.col("n") <= most_bytes))
    return rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(fit.select("id", "h")), ["id", "h"]).select("id", "y", "text")


def _evidence(sample: DataFrame, rate: float, terms: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(hashes, factors) of the words, and of the beginnings, with more toxic documents than
    chance allows, at most ``terms`` of each by the strength of the evidence: a factor of 2
    just excludes chance, and more evidence raises it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                words, _, begins, _ = text_terms(t)
                begins = np.unique(begins)
                term = np.concatenate([words, begins]).view(np.int64)
                flag = np.arange(len(term)) >= len(words)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(flag), pa.array(np.full(len(term), y, np.int64))], names=["term", "begins", "y"])

    counts = as_table(sample.select("y", "text").mapInArrow(run, "term long, begins boolean, y long").groupBy("term", "begins").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("n")), "toxicity-terms")
    tried = max(1, counts.count())
    out = []
    for begins in (False, True):
        if not 0 < rate < 1:
            out.append((np.empty(0, np.uint64), np.empty(0)))
            continue
        p = F.col("toxic") / F.col("n")
        part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
        e = F.when(p > rate, F.col("n") * (part(p, F.lit(rate)) + part(1 - p, F.lit(1 - rate)))).otherwise(0.0) / math.log(tried / ALPHA)
        rows = counts.where(F.col("begins") == begins).select("term", e.alias("e")).where("e >= 1").orderBy(F.desc("e"), "term").limit(terms).toArrow()
        hashes, factors = rows["term"].to_numpy().view(np.uint64), 1 + rows["e"].to_numpy()
        order = np.argsort(hashes)
        out.append((hashes[order], factors[order]))
    return out[0], out[1]


def _frequencies(docs: DataFrame, text_col: str, begins: np.ndarray) -> tuple[int, np.ndarray]:
    """All documents, and those with a term by cell: all words, and the chosen beginnings.
    ``CELLS`` numbers reach the driver; a task emits no more than the cells of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(CELLS, np.int32), 0
        for b in batches:
            for t in utf8(b.column(0)):
                n += 1
                words, _, starts, _ = text_terms(t)
                told = starts[Weights.factors((begins, np.ones(len(begins))), starts) > 0]
                have[np.unique(cells(np.concatenate([words, told])))] += 1
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(have[at], n), pa.int64())], names=["i", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    i, n = rows["i"].to_numpy(), rows["n"].to_numpy()
    have = np.zeros(CELLS, np.int64)
    have[i[i >= 0]] = n[i >= 0]
    return int(n[i < 0].sum()), have


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, terms: int = TERMS, neighbours: int = NEIGHBOURS) -> Model:
    """The model; what reaches the driver is bounded by the sample's rows and bytes."""
    prepare(docs.sparkSession)
    rows = _sample(docs, labels, id_col, text_col, label_col, sample, sample_bytes).checkpoint()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).first()
    words, begins = _evidence(rows, (size.y or 0) / max(1, size.n), terms)
    weights = Weights(*_frequencies(docs, text_col, begins[0]), words, begins)
    found = rows.orderBy("id", "y", "text").toArrow()
    return Model(weights, list(zip(found["id"].to_pylist(), found["y"].to_pylist(), utf8(found["text"].combine_chunks()), strict=True)) if found.num_rows else [], neighbours)


SCORES = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("vote", T.DoubleType()),
        T.StructField(
            "evidence",
            T.ArrayType(T.StructType([T.StructField("example", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("similarity", T.DoubleType())])),
        ),
    ]
)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted, the vote and the nearest examples. A text that
    is null, empty or without any word of an example gets the share of toxic examples among
    those without words. A row without id is not held out."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def evidence(near):
            return [{"example": str(m.ids[i]), "label": int(m.labels[i]), "similarity": sim} for sim, i in near[:EVIDENCE]]

        return lambda column: [(s, vote, evidence(near)) for s, vote, near in map(m.score, utf8(column))]

    out = per_text(docs, text_col, SCORES, make, "_s_", [id_col])
    return out.select(
        F.col(f"`{id_col}`"),
        F.coalesce(~is_training(F.col(f"`{id_col}`")), F.lit(False)).alias("held_out"),
        F.col("_s_.score").alias("score"),
        (F.col("_s_.score") >= THRESHOLD).cast("int").alias("predicted"),
        F.col("_s_.vote").alias("vote"),
        F.col("_s_.evidence").alias("evidence"),
    )


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    return score(docs, fit(docs, labels, id_col, text_col, label_col, **options), id_col, text_col)
