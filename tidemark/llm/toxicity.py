"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts is unlabelled, toxic ones among them. With the class
prior pi the risk of calling texts clean is that of the unlabelled ones less pi times that of the positives; where
this estimate gets negative, the step goes the other way (the non-negative correction), so the model does
not fit the positives hidden in the unlabelled part. The classifier is linear in the presence of words and word
beginnings, hashed; its weights are not negative, so no amount of clean text hides a toxic passage.
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

#: Hashed features.
DIMENSION = 1 << 20
#: Bytes of word beginnings that are features beside whole words.
PREFIXES = (4, 5)
#: Most confirmed toxic and unlabelled texts that the model is fitted on.
POSITIVES, UNLABELLED = 4000, 12000


def features(s: bt.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all words and word beginnings, repeats included."""
    starts, ends, at = bt.word_spans(s, bt.ALNUM)
    data = bt.LOWER[s.data]
    doc = np.repeat(np.arange(s.count), np.diff(at))
    docs, hashes = [doc], [bt.span_hashes(data, starts, ends)]
    for n in PREFIXES:
        use = ends - starts > n
        docs.append(doc[use])
        hashes.append(bt.span_hashes(data, starts[use], starts[use] + n) ^ np.uint64(n))
    return np.concatenate(docs), (np.concatenate(hashes) % np.uint64(DIMENSION)).astype(np.int64)


def accepted(toxic: np.ndarray, mixed: np.ndarray, positives: int, unlabelled: int, prior: float) -> np.ndarray:
    """Features that may add to the score, from how many positive and unlabelled texts have each.

    Words of toxic texts only are log(1 / prior) more common among the positives than in the mixture; six tenths
    of the way there and beyond what chance explains, a feature may add to the score; none takes away from it.
    """
    expected = (mixed + 0.5) * positives / (unlabelled + 1)
    odds = np.log(toxic + 0.5) - np.log(expected)
    return np.flatnonzero((odds > 0.6 * np.log(1 / prior)) & (toxic - expected > 4 * np.sqrt(expected)) & (toxic >= 3))


def fit(texts: list[np.ndarray], positive: np.ndarray, prior: float, chosen: np.ndarray | None = None, steps: int = 300, rate: float = 0.1, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights (DIMENSION) and bias from each text's distinct features; texts that are not positive are unlabelled.

    Only ``chosen`` features count, or those that ``accepted`` finds in the texts. The loss of a text is the sigmoid
    one, which is bounded, so the corrected risk does not hang on a few texts.
    """
    weights = np.zeros(DIMENSION)
    p, u = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(p) or not len(u) or not 0 < prior < 1:
        return weights, float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (12.0 if prior >= 1 else -12.0)
    if chosen is None:
        seen = {True: np.zeros(DIMENSION), False: np.zeros(DIMENSION)}
        for i, x in enumerate(texts):
            seen[bool(positive[i])][x] += 1
        chosen = accepted(seen[True], seen[False], len(p), len(u), prior)
    column = np.full(DIMENSION, -1)
    column[chosen] = np.arange(len(chosen))

    def matrix(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        rows = [column[texts[i]] for i in of]
        rows = [x[x >= 0] for x in rows]
        return np.repeat(np.arange(len(of)), [len(x) for x in rows]), np.concatenate(rows), len(of)

    w, b = np.zeros(len(chosen)), float(np.log(prior / (1 - prior)))

    def gradient(x: tuple[np.ndarray, np.ndarray, int], sign: float) -> tuple[float, np.ndarray]:
        """Mean loss of calling all texts ``sign``, and its slopes (bias last)."""
        row, col, n = x
        miss = 1 / (1 + np.exp(np.clip(sign * (np.bincount(row, w[col], n) + b), -50, 50)))
        slope = -sign * miss * (1 - miss) / n
        return float(miss.mean()), np.append(np.bincount(col, slope[row], len(w)), slope.sum())

    positives, unlabelled = matrix(p), matrix(u)
    mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        _, toxic = gradient(positives, 1.0)
        lost, clean = gradient(positives, -1.0)
        mixed, rest = gradient(unlabelled, -1.0)
        if mixed - prior * lost >= 0:
            slope = prior * toxic + rest - prior * clean
        else:  # climb back to a non-negative risk of the clean texts
            slope = prior * clean - rest
        slope[:-1] += l2 * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * mean / (np.sqrt(square) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - float(move[-1])
    weights[chosen] = w
    return weights, b


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: list[str], positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """row (struct of the ``carry`` columns), held_out, score (0 to 1): one row per document.

    Labels are learnt only from rows that are not held out, at most ``positives`` toxic rows and ``unlabelled`` rows
    of any kind (lowest hashes; of equal rows one); the class prior is the toxic share of those rows. Only the text is scored.
    A null or empty text has no features and gets the bias alone. With no labels every score is 0; with labels of
    one kind only it is nearly 0 or 1. Repeated rows score alike; an empty table gives an empty result; extra columns
    matter only if carried. Texts of any length are taken whole, about 20 bytes of memory a byte beyond the first
    megabyte; to the driver go at most DIMENSION counts, and of the texts fitted on only the accepted features.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(~held_out(F.col("doc_id")))
    toxic, mixed = sample_rows(docs, known.filter("toxic = 1"), positives, 1), sample_rows(docs, ids, unlabelled, 2)
    scratch = Scratch(spark, "toxicity")
    texts = scratch.keep("sample", toxic.withColumn("p", F.lit(True)).unionByName(mixed.withColumn("p", F.lit(False))).select("p", "text"))

    def distinct_features(s: bt.Slice) -> np.ndarray:
        doc, feature = features(s)
        return np.unique(doc * DIMENSION + feature)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, DIMENSION), np.int32)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            for s in bt.slices(batch.column(1)):
                both = distinct_features(s)
                kind = np.asarray(batch.column(0).slice(s.first, s.count), bool).astype(np.int64)
                texts += np.bincount(kind, minlength=2)
                for k in (0, 1):
                    seen[k] += np.bincount(both[kind[both // DIMENSION] == k] % DIMENSION, minlength=DIMENSION).astype(np.int32)
        x = np.flatnonzero(seen.any(axis=0))
        x, mixed, toxic = np.append(x, -1), np.append(seen[0, x], texts[0]), np.append(seen[1, x], texts[1])
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(mixed.astype(np.int64)), pa.array(toxic.astype(np.int64))], names=["x", "mixed", "toxic"])
        bt.release()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = wanted.value
        for batch in batches:
            for s in bt.slices(batch.column(1)):
                both = distinct_features(s)
                both = both[use[both % DIMENSION]]
                cuts = np.searchsorted(both, np.arange(s.count + 1) * DIMENSION)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.count), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((both % DIMENSION).astype(np.int32)))], names=["p", "x"])
        bt.release()

    weights, bias = np.zeros(DIMENSION), -np.inf
    if share is not None:
        # how many texts have each feature: at most DIMENSION rows, of which few are accepted
        seen = texts.mapInArrow(count, "x long, mixed long, toxic long").groupBy("x").agg(F.sum("mixed").alias("mixed"), F.sum("toxic").alias("toxic")).toArrow()
        x, mixed, toxic = (seen.column(i).to_numpy() for i in range(3))
        total = {k: int(v[x == -1].sum()) for k, v in (("mixed", mixed), ("toxic", toxic))}
        chosen = np.zeros(0, np.int64)
        if total["mixed"] and total["toxic"] and 0 < share < 1:
            there = np.zeros((2, DIMENSION))
            there[:, x[x >= 0]] = mixed[x >= 0], toxic[x >= 0]
            chosen = accepted(there[1], there[0], total["toxic"], total["mixed"], float(share))
        use = np.zeros(DIMENSION, bool)
        use[chosen] = True
        wanted = spark.sparkContext.broadcast(use)
        got = texts.mapInArrow(extract, "p boolean, x array<int>").toArrow()
        order = sorted(range(len(got)), key=lambda i: (got.column(0)[i].as_py(), tuple(got.column(1)[i].as_py())))
        got = got.take(pa.array(order, pa.int64()))
        scratch.drop("sample")
        weights, bias = fit([a.values.to_numpy().astype(np.int64) for a in got.column(1)], np.array(got.column(0).to_pylist(), bool), float(share), chosen)
    sent = spark.sparkContext.broadcast((weights.astype(np.float32), bias))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = rows.select("row", "held_out", F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value
        for batch in batches:
            for s in bt.slices(batch.column(2)):
                doc, feature = features(s)
                use = weights[feature] != 0
                both = np.unique(doc[use] * DIMENSION + feature[use])
                z = np.bincount(both // DIMENSION, weights[both % DIMENSION], s.count) + bias
                part = batch.slice(s.first, s.count)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))) if bias > -np.inf else np.zeros(s.count))], names=["row", "held_out", "score"])
        bt.release()

    return rows.mapInArrow(score, schema)
