"""A quality classifier by positive-unlabelled learning.

Trusted documents are the positives; a sample of all documents is unlabelled, good ones among them. No document is known to be
bad, so none is used as such. First the share of good documents among the unlabelled ones is estimated: a classifier of
positives against unlabelled ones is fitted on one half, and on the other half the share of unlabelled documents above a
score is held against that of the positives. Bad documents can only add to the first, so the least upper bound of
the ratio over all scores is the estimate. Then a classifier is fitted by the non-negative unbiased risk: the risk of the bad
ones is that of the unlabelled ones less the share times that of the positives, and where the estimate gets negative, the
step goes back.

The features are the forms of words (what kinds of characters follow one another, hashed), as shares of a document's words,
and how much its words repeat: they say nothing of a document's language or topic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .folds import held_out, sample_rows
from .scratch import Scratch, small_batches

#: Hashed forms of words; statistics of the document follow them.
FORMS = 1 << 12
STATISTICS = ("most common word", "words equal to the one before", "words seen before", "under 5 words", "5 to 19 words", "mean length over 12", "mean length under 2.5", "lines seen before")
DIMENSION = FORMS + len(STATISTICS)
#: Most trusted and unlabelled texts that the model is fitted on.
POSITIVES, UNLABELLED = 4000, 8000
#: Score from which a document is called good.
GOOD = 0.3
#: Chance that the bounds of the class prior's estimate do not hold.
DOUBT = 0.1
_KIND = np.arange(256, dtype=np.uint8)
_KIND[0x41:0x5B] = ord("A")
_KIND[0x61:0x7B] = ord("a")
_KIND[0x30:0x3A] = ord("0")
_KIND[0x80:] = ord("a")


def features(s: bt.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, share) of all features that are not 0, by document and then feature."""
    starts, ends, at = bt.word_spans(s, bt.NOT_SPACE)
    words = np.diff(at)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(s.count), words)
    # forms: the kind of every byte but those equal to the one before in the same word
    kind = _KIND[s.data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    form = bt.span_hashes(kind[new], upto[starts], upto[ends]) % np.uint64(FORMS)
    cell, times = np.unique(doc * DIMENSION + form.astype(np.int64), return_counts=True)
    share = times / some[cell // DIMENSION]
    # statistics
    h = bt.span_hashes(s.data, starts, ends)
    order = np.lexsort((h, doc))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    edge = np.flatnonzero(first)
    most, distinct = np.zeros(s.count, np.int64), np.bincount(doc[order][edge], minlength=s.count)
    np.maximum.at(most, doc[order][edge], np.diff(np.append(edge, len(h))))
    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    length = np.bincount(doc, ends - starts, s.count) / some
    values = np.stack([most / some * (words >= 5), np.bincount(doc[stutter], minlength=s.count) / some, 1 - distinct / some, (words > 0) & (words < 5), (words >= 5) & (words < 20), (length > 12), (words > 0) & (length < 2.5), _again(s)], axis=1).astype(float)
    values[words == 0] = 0
    d, k = np.nonzero(values)
    cell, share = np.concatenate([cell, d * DIMENSION + FORMS + k]), np.concatenate([share, values[d, k]])
    order = np.argsort(cell, kind="stable")
    return cell[order] // DIMENSION, cell[order] % DIMENSION, share[order]


def _again(s: bt.Slice) -> np.ndarray:
    """Share of a document's lines that an earlier one equals."""
    breaks = np.flatnonzero(s.data == 0x0A)
    begin = np.unique(np.concatenate([s.offsets[:-1], breaks + 1]))
    begin = begin[begin < len(s.data)]
    end = np.append(begin[1:], len(s.data))[: len(begin)]
    end = end - (s.data[end - 1] == 0x0A) if len(end) else end
    doc = np.searchsorted(s.offsets, begin, "right") - 1
    use = end > begin
    h, doc = bt.span_hashes(s.data, begin[use], end[use]), doc[use]
    distinct = np.unique(np.stack([doc.astype(np.uint64), h], axis=1), axis=0)[:, 0].astype(np.int64)
    lines = np.bincount(doc, minlength=s.count)
    return 1 - np.bincount(distinct, minlength=s.count) / np.maximum(lines, 1) * (lines > 0) - (lines == 0)


class Texts:
    """Features of some texts, row by row."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(x) for x, _ in rows])
        self.column = np.concatenate([x for x, _ in rows]) if rows else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, self.n) + b

    def slopes(self, each: np.ndarray) -> np.ndarray:
        """Slopes of the weights, bias last, from the slope of each row's score."""
        return np.append(np.bincount(self.column, self.value * each[self.row], DIMENSION), each.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _descend(slope, steps: int, rate: float, bias: float = 0.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias after steps with momentum and a scale of its own for each weight."""
    theta = np.append(np.zeros(DIMENSION), bias)
    mean, square = np.zeros(DIMENSION + 1), np.zeros(DIMENSION + 1)
    for turn in range(1, steps + 1):
        g = slope(theta[:-1], float(theta[-1]))
        g[:-1] += l2 * theta[:-1]
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g**2
        theta -= rate * np.sqrt(1 - 0.99**turn) / (1 - 0.9**turn) * mean / (np.sqrt(square) + 1e-8)
    return theta[:-1], float(theta[-1])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = DOUBT) -> float:
    """Share of positives among the unlabelled, from scores of either that rank positives high: the ratio of what is above the score where its upper bound is least."""
    p, u = np.sort(positive), np.sort(unlabelled)
    if not len(p) or not len(u):
        return 0.5
    at = np.unique(np.concatenate([p, u]))
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    slack = np.sqrt(np.log(4 / doubt) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    at = int(np.argmin((above_u + slack) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[at] / max(above_p[at], 1e-9), 0.01, 0.99))


def estimate_prior(positive: Texts, unlabelled: Texts, check_positive: Texts, check_unlabelled: Texts, steps: int = 200, rate: float = 0.3) -> float:
    """The class prior by a classifier of positives against unlabelled texts and its scores of other such texts."""

    def slope(w: np.ndarray, b: float) -> np.ndarray:
        p, u = _sigmoid(positive.scores(w, b)), _sigmoid(unlabelled.scores(w, b))
        return (positive.slopes((p - 1) / positive.n) + unlabelled.slopes(u / unlabelled.n)) / 2

    w, b = _descend(slope, steps, rate)
    return class_prior(check_positive.scores(w, b), check_unlabelled.scores(w, b))


def fit(positive: Texts, unlabelled: Texts, prior: float, steps: int = 400, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of least non-negative unbiased risk, with the sigmoid loss."""

    def slope(w: np.ndarray, b: float) -> np.ndarray:
        p, u = _sigmoid(positive.scores(w, b)), _sigmoid(unlabelled.scores(w, b))
        # calling a text good costs 1 - sigmoid if it is bad, and the other way round
        miss = positive.slopes(-p * (1 - p) / positive.n)
        wrong_p, wrong_u = positive.slopes(p * (1 - p) / positive.n), unlabelled.slopes(u * (1 - u) / unlabelled.n)
        if u.mean() - prior * p.mean() >= 0:
            return prior * miss + wrong_u - prior * wrong_p
        return prior * wrong_p - wrong_u

    return _descend(slope, steps, rate)


def _halves(got: pa.Table, positive: bool) -> list[Texts]:
    """All texts of one kind, and the two halves by the order of the sample."""
    rows = [(np.array(x, np.int64), np.array(v)) for p, x, v in zip(*(got.column(c).to_pylist() for c in ("p", "x", "v")), strict=True) if p == positive]
    rows.sort(key=lambda r: (r[0].tobytes(), r[1].tobytes()))
    return [Texts(rows), Texts(rows[::2]), Texts(rows[1::2])]


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float] | None:
    """Weights and bias from at most ``positives`` rows labelled good and ``unlabelled`` rows of any kind (lowest hashes), none held out; None without either."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    free = ~held_out(F.col("doc_id"))
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality = 1").filter(free)
    both = sample_rows(docs, trusted, positives, 11).withColumn("p", F.lit(True)).unionByName(sample_rows(docs, docs.select("doc_id").filter(free), unlabelled, 12).withColumn("p", F.lit(False)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in bt.slices(batch.column(1)):
                doc, column, value = features(s)
                cuts = pa.array(np.searchsorted(doc, np.arange(s.count + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.count), pa.ListArray.from_arrays(cuts, pa.array(column.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(value))], names=["p", "x", "v"])
        bt.release()

    # a text gives at most DIMENSION numbers, most of them some dozens
    got = scratch.keep("features", both.select("p", "text").mapInArrow(extract, "p boolean, x array<int>, v array<double>")).toArrow()
    p, u = _halves(got, True), _halves(got, False)
    scratch.drop("features")
    if not p[0].n or not u[0].n:
        return None
    prior = estimate_prior(p[1], u[1], p[2], u[2]) if p[2].n and u[2].n else 0.5
    return fit(p[0], u[0], prior)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float] | None, carry: list[str]) -> DataFrame:
    """row (struct of the ``carry`` columns), held_out, score (0 to 1): one row per document, from its text alone.

    Without a model every score is 0.5. A null, empty or wordless text has no features and gets the bias's score. Repeated rows score
    alike; an empty table gives an empty one; extra columns matter only if carried. Texts of any length are taken whole, about
    40 bytes of memory a byte beyond the first megabyte.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model or (np.zeros(DIMENSION), 0.0))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = rows.select("row", "held_out", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        for batch in batches:
            for s in bt.slices(batch.column(2)):
                doc, column, value = features(s)
                z = np.bincount(doc, w[column] * value, s.count) + b
                part = batch.slice(s.first, s.count)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_sigmoid(z))], names=schema.names)
        bt.release()

    return rows.mapInArrow(run, schema)
