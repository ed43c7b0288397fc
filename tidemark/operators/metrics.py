"""Ranking metrics with ties handled exactly, and resampling studies around them.

Scores are first grouped: everything after that works on one row per distinct score. Running sums over scores are cut
at quantiles (``running_sums``), so no task sorts all scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators.cohort import running_sums


def score_groups(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """score, pos, neg: one row per distinct score (of each value of ``by``).

    A score that is null or not finite, or a label other than 0 and 1, is an error when the rows are read.
    """
    y, s = F.col(label).cast("int"), F.col(score).cast("double")
    s = F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.raise_error(F.lit("a score is not finite"))).otherwise(s)
    y = F.when(y.isNull() | ~y.isin(0, 1), F.raise_error(F.lit("a label is neither 0 nor 1"))).otherwise(y)
    checked = df.select(*by, s.alias("score"), y.cast("int").alias("_y"))
    return checked.groupBy(*by, "score").agg(F.sum((F.col("_y") == 1).cast("long")).alias("pos"), F.sum((F.col("_y") == 0).cast("long")).alias("neg"))


def check_inputs(df: DataFrame, score: str, label: str = "label") -> None:
    """Scores finite, labels 0 and 1 with both there: for a caller who wants to know before a metric is read."""
    s = F.col(score).cast("double")
    row = df.agg(F.count("*").alias("n"), F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).alias("scores"), F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).alias("labels"), F.count_if(F.col(label) == 1).alias("pos")).first()
    if row.scores:
        raise ValueError(f"{row.scores} scores are not finite")
    if row.labels:
        raise ValueError(f"{row.labels} labels are neither 0 nor 1")
    if row.pos in (0, row.n):
        raise ValueError("both classes are needed")


def check_features(df: DataFrame, columns: Sequence[str]) -> None:
    """Infinite values are an error; NaN and null are missing values."""
    row = df.agg(*(F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias(c) for c in columns)).first()
    for c in columns:
        if row[c]:
            raise ValueError(f"{c} has {row[c]} infinite values")


def _descending(groups: DataFrame, by: Sequence[str] = (), like: DataFrame | None = None) -> DataFrame:
    """Groups with the positives and negatives at or above each score, and of all (of the same ``by``)."""
    total = groups.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rows = running_sums(groups, "score", ["pos", "neg"], ascending=False, by=by, like=like)
    return rows.join(F.broadcast(total), [*by]) if by else rows.crossJoin(F.broadcast(total))


def ranking_metrics(df: DataFrame, score: str, label: str = "label", by: Sequence[str] = (), like: DataFrame | None = None) -> DataFrame:
    """roc_auc and average_precision from one pass over the score groups. One row, or one per ``by``; nulls without both classes.

    roc_auc: the chance that a positive scores above a negative, ties counting half. average_precision: the sum over
    scores of the recall gained times the precision there. ``like``: rows with ``score`` that tell its quantiles.
    """
    rows = _descending(score_groups(df, score, label, by), by, like)
    below = F.col("all_neg") - F.col("upto_neg")
    won = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2))
    precision = F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg"))
    gained = F.try_divide(F.col("pos").cast("double"), F.col("all_pos"))
    return rows.groupBy(*by).agg(F.try_divide(won, F.max("all_pos").cast("double") * F.max("all_neg")).alias("roc_auc"), F.sum(gained * precision).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    return ranking_metrics(df, score, label).select("roc_auc")


def average_precision(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    return ranking_metrics(df, score, label).select("average_precision")


def metric_lift(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """average_precision over prevalence."""
    base = df.agg(F.avg(F.col(label).cast("double")).alias("prevalence"))
    return average_precision(df, score, label).crossJoin(F.broadcast(base)).select("average_precision", "prevalence", F.try_divide("average_precision", "prevalence").alias("lift"))


def roc_curve(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """threshold, fpr, tpr at every distinct score."""
    return _descending(score_groups(df, score, label)).select(F.col("score").alias("threshold"), F.try_divide(F.col("upto_neg").cast("double"), F.col("all_neg")).alias("fpr"), F.try_divide(F.col("upto_pos").cast("double"), F.col("all_pos")).alias("tpr"))


def pr_curve(df: DataFrame, score: str, label: str = "label") -> DataFrame:
    """threshold, precision, recall at every distinct score."""
    return _descending(score_groups(df, score, label)).select(F.col("score").alias("threshold"), (F.col("upto_pos") / (F.col("upto_pos") + F.col("upto_neg"))).alias("precision"), F.try_divide(F.col("upto_pos").cast("double"), F.col("all_pos")).alias("recall"))


def prior_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """The share of positives in train as the score of every test row: score, its ROC-AUC and average precision."""
    prior = train.agg(F.avg(F.col(label).cast("double")).alias("score"))
    y = F.col(label).cast("int")
    seen = test.agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    return prior.crossJoin(F.broadcast(seen)).select("score", F.when((F.col("pos") > 0) & (F.col("neg") > 0), 0.5).alias("roc_auc"), F.try_divide(F.col("pos").cast("double"), F.col("pos") + F.col("neg")).alias("average_precision"))


#: A Poisson(1) draw from 32 random bits is the number of these that the bits reach.
POISSON = [round(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11)]
#: The multipliers of a 32-bit integer hash (murmur3's finalizer) and the step between replicates.
MIX, STEP = (0x85EBCA6B, 0xC2B2AE35), 0x9E3779B1
#: Share of all rows from which the rows of one score are added up before they are dealt out.
FREQUENT = 1 / 200
#: Weights that are added up at a time, and that are made at a time (few enough to stay in a processor's cache).
WEIGHTS_AT_ONCE, WEIGHTS_MADE = 1 << 17, 1 << 15
#: Rows of one range of scores.
RANGE_OF_SCORES = 1 << 19


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(MIX[0])
    x = (x ^ (x >> np.uint32(13))) * np.uint32(MIX[1])
    return x ^ (x >> np.uint32(16))


def _mix_in_place(x: np.ndarray, spare: np.ndarray) -> None:
    for shift, factor in ((16, MIX[0]), (13, MIX[1]), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor is not None:
            np.multiply(x, np.uint32(factor), out=x)


_THRESHOLDS = np.array([min(t, 2**32 - 1) for t in POISSON], np.uint64)
#: The draw by the upper 16 bits, where these decide it; else 255.
_DRAWS = np.searchsorted(_THRESHOLDS, np.arange(1 << 16, dtype=np.uint64) << np.uint64(16), "right").astype(np.uint8)
_DRAWS[np.searchsorted(_THRESHOLDS, (np.arange(1 << 16, dtype=np.uint64) << np.uint64(16)) + np.uint64(0xFFFF), "right") != _DRAWS] = 255


def poisson_weights(a: np.ndarray, b: np.ndarray, replicates: int) -> np.ndarray:
    """(rows, replicates): how often each replicate has a row, from two 32-bit hashes of the row."""
    turn = (np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(STEP)).astype(np.uint32)
    a, b = a.astype(np.uint32), b.astype(np.uint32)
    out = np.empty((len(a), replicates), np.uint8)
    step = max(1, WEIGHTS_MADE // replicates)
    x, spare = np.empty((2, step, replicates), np.uint32)
    for i in range(0, len(a), step):
        m = min(step, len(a) - i)
        y, z = x[:m], spare[:m]
        np.bitwise_xor(a[i : i + m, None], turn, out=y)
        _mix_in_place(y, z)
        np.bitwise_xor(y, b[i : i + m, None], out=y)
        _mix_in_place(y, z)
        np.right_shift(y, np.uint32(16), out=z)
        drawn = out[i : i + m].reshape(-1)
        np.take(_DRAWS, z.reshape(-1), out=drawn, mode="clip")
        open_ = np.flatnonzero(drawn == 255)
        drawn[open_] = np.searchsorted(_THRESHOLDS, y.reshape(-1)[open_].astype(np.uint64), "right")
    return out


def _sums(w: np.ndarray, pos: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positives and negatives of each run of rows (first rows: ``new``) in every replicate."""
    edges = np.append(new, len(w))
    if len(new) * 8 > len(w):
        both = []
        for y in (pos, 1 - pos):
            part = w * y.astype(np.uint8)[:, None]
            both.append(part.astype(np.int64) if len(new) == len(w) else np.add.reduceat(part, new, axis=0, dtype=np.int64))
        return both[0], both[1]
    out = np.empty((2, len(new), w.shape[1]), np.int64)
    for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        # sums of this many small numbers are exact in single precision
        out[:, k] = np.stack([pos[i:j], 1 - pos[i:j]]).astype(np.float32) @ w[i:j].astype(np.float32)
    return out[0], out[1]


class _Resampled:
    """ROC-AUC and average precision of one score in all replicates.

    Rows of a frequent score are added up where they lie. All others are dealt by range of score, and kept; per range, the first pass
    adds up positives and negatives of every replicate and the second, knowing what the ranges above come to, walks down its scores.
    The driver gets two numbers a range and replicate. There are as many ranges as rows need, and a task of its own for most of them:
    a row has few bytes, but is the work of all replicates.
    """

    def __init__(self, df: DataFrame, score: str, label: str, key: str, replicates: int, seed: int, parts: int):
        self.replicates = n = replicates
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
        bits = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        rows = df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("pos"), bits(1).alias("a"), bits(9).alias("b"))
        total = df.count()
        parts = max(parts, total // RANGE_OF_SCORES)
        common = [r.score for r in rows.groupBy("score").count().filter(F.col("count") >= max(1000.0, total * FREQUENT)).collect()]
        is_common = F.col("score").isin(common) if common else F.lit(False)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[float, np.ndarray] = {}
            for batch in batches:
                score, pos, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("score", "pos", "a", "b"))
                order = np.argsort(score, kind="stable")
                score, pos, a, b = (x[order] for x in (score, pos, a, b))
                step = max(1, WEIGHTS_AT_ONCE // n)
                for i in range(0, len(score), step):
                    new = np.flatnonzero(np.diff(score[i : i + step], prepend=np.nan) != 0)
                    both = np.stack(_sums(poisson_weights(a[i : i + step], b[i : i + step], n), pos[i : i + step], new))
                    for k, x in enumerate(score[i : i + step][new].tolist()):
                        sums[x] = sums.get(x, 0) + both[:, k]
            for s, both in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s)), pa.array(np.arange(n)), pa.array(both[0]), pa.array(both[1])], names=["score", "r", "p", "q"])

        summed = rows.filter(is_common).repartition(parts, "a").mapInArrow(added, "score double, r long, p long, q long").groupBy("score", "r").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        lists = summed.groupBy("score").agg(F.array_sort(F.collect_list(F.struct("r", "p", "q"))).alias("x")).select("score", F.col("x.p").alias("p"), F.col("x.q").alias("q"))
        rare = rows.filter(~is_common)
        both = rare.unionByName(lists, allowMissingColumns=True) if common else rows.withColumn("p", F.lit(None).cast("array<long>")).withColumn("q", F.lit(None).cast("array<long>"))
        edges = rare.approxQuantile("score", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
        edges = sorted(set(edges))
        # the ranges below a score, so that the greatest scores have 0
        cut = F.lit(len(edges)) - F.size(F.filter(F.lit(edges), lambda e: e <= F.col("score"))) if edges else F.lit(0)
        self.rows = both.withColumn("cut", cut.cast("int")).repartition(parts, "cut").sortWithinPartitions("cut", F.desc("score")).persist(StorageLevel.DISK_ONLY)

    def close(self) -> None:
        self.rows.unpersist()

    def walk(self, before: dict[int, np.ndarray] | None, all_neg: np.ndarray | None) -> dict[int, np.ndarray]:
        """Per range: positives and negatives, or, if what stands above is given, parts of AUC and average precision; each of all replicates."""
        n = self.replicates

        def groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            """cut, score, positives and negatives of runs of rows: of one score each, or, in the first pass, of one cut."""
            cuts, scores = batch.column("cut").to_numpy(), batch.column("score").to_numpy(zero_copy_only=False)
            pos, a, b = (pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in ("pos", "a", "b"))
            whole = batch.column("p").is_valid().to_numpy(zero_copy_only=False)
            step = max(1, WEIGHTS_AT_ONCE // n)
            for i in range(0, len(cuts), step):
                j = min(i + step, len(cuts))
                changes = (np.diff(cuts[i:j]) != 0) | whole[i + 1 : j] | whole[i : j - 1]
                if before is not None:
                    changes |= np.diff(scores[i:j]) != 0
                new = np.flatnonzero(np.concatenate([[True], changes]))
                p, q = _sums(poisson_weights(a[i:j], b[i:j], n), pos[i:j], new)
                for k in np.flatnonzero(whole[i + new]).tolist():
                    p[k], q[k] = (batch.column(c)[int(i + new[k])].values.to_numpy() for c in ("p", "q"))
                yield cuts[i + new], scores[i + new], p, q

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            last: tuple[np.ndarray, ...] | None = None  # a run that the next rows may go on with
            now, above = None, np.zeros((2, n), np.int64)

            def close(cuts: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
                nonlocal now, above
                first = np.flatnonzero(np.diff(cuts, prepend=-1))
                for i, j in zip(first.tolist(), [*first[1:].tolist(), len(cuts)], strict=True):
                    if cuts[i] != now:
                        now, above = int(cuts[i]), np.zeros((2, n), np.int64)
                    if before is None:
                        above = above + np.stack([p[i:j].sum(axis=0), q[i:j].sum(axis=0)])
                        out[now] = above
                        continue
                    high = above + before.get(now, 0)
                    tp, fp = np.cumsum(p[i:j], axis=0) + high[0], np.cumsum(q[i:j], axis=0) + high[1]
                    above = np.stack([tp[-1], fp[-1]]) - before.get(now, 0)
                    won = p[i:j] * (all_neg - fp + q[i:j] / 2)
                    precision = p[i:j] * (tp / np.maximum(tp + fp, 1))
                    out[now] = out.get(now, 0) + np.stack([won.sum(axis=0), precision.sum(axis=0)])

            for batch in batches:
                for cuts, scores, p, q in groups(batch):
                    if last is not None and last[0][0] == cuts[0] and last[1][0] == scores[0]:
                        p[0], q[0] = p[0] + last[2][0], q[0] + last[3][0]
                    elif last is not None:
                        close(last[0], last[2], last[3])
                    last = cuts[-1:], scores[-1:], p[-1:].copy(), q[-1:].copy()
                    if len(cuts) > 1:
                        close(cuts[:-1], p[:-1], q[:-1])
            if last is not None:
                close(last[0], last[2], last[3])
            for cut, both in out.items():
                yield pa.RecordBatch.from_arrays([pa.array([cut], pa.int32()), pa.array([both[0].astype(float)]), pa.array([both[1].astype(float)])], names=["cut", "x", "y"])

        return {r.cut: np.array([r.x, r.y]) for r in self.rows.mapInArrow(run, "cut int, x array<double>, y array<double>").collect()}

    def metrics(self) -> np.ndarray:
        """(2, replicates): ROC-AUC and average precision, NaN where a class is missing."""
        totals = self.walk(None, None)
        before, upto = {}, np.zeros((2, self.replicates))
        for cut in sorted(totals):
            before[cut], upto = upto.astype(np.int64), upto + totals[cut]
        parts = self.walk(before, upto[1].astype(np.int64))
        won = sum(parts[c] for c in sorted(parts)) if parts else np.zeros((2, self.replicates))
        with np.errstate(invalid="ignore", divide="ignore"):
            found = np.stack([won[0] / (upto[0] * upto[1]), won[1] / upto[0]])
        return np.where((upto > 0).all(axis=0), found, np.nan)


def _resampled(df: DataFrame, score: str, label: str, key: str, replicates: int, seed: int, parts: int) -> np.ndarray:
    study = _Resampled(df, score, label, key, replicates, seed, parts)
    try:
        return study.metrics()
    finally:
        study.close()


def paired_bootstrap(df: DataFrame, score_a: str, score_b: str, key: str, label: str = "label", replicates: int = 500, seed: int = 42, least_valid: float = 0.95, parts: int = 32) -> DataFrame:
    """Metric gains of score_b over score_a with percentile intervals over resamples that both scores share.

    A Poisson bootstrap: each row is in a replicate Poisson(1) times, by a hash of its ``key`` and the replicate, so resamples are
    the same at every partitioning and no row travels for them. metric, delta, low, high, n_valid. A replicate with one class only is
    dropped; too many of them are an error. Any number of rows. ``df`` is computed once and kept meanwhile.
    """
    df = df.select(*dict.fromkeys([key, score_a, score_b, label])).persist(StorageLevel.DISK_ONLY)
    try:
        check_inputs(df, score_a, label)
        check_inputs(df, score_b, label)
        gain = _resampled(df, score_b, label, key, replicates, seed, parts) - _resampled(df, score_a, label, key, replicates, seed, parts)
        valid = ~np.isnan(gain).any(axis=0)
        if valid.sum() < least_valid * replicates:
            raise ValueError(f"only {valid.sum()} of {replicates} resamples have both classes")
        point = [ranking_metrics(df, s, label).first() for s in (score_a, score_b)]
    finally:
        df.unpersist()
    rows = [(m, float(point[1][m] - point[0][m]), *(float(x) for x in np.quantile(gain[i][valid], [0.025, 0.975])), int(valid.sum())) for i, m in enumerate(("roc_auc", "average_precision"))]
    return df.sparkSession.createDataFrame(rows, "metric string, delta double, low double, high double, n_valid long")


def round_keys(seed: int) -> list[int]:
    """The keys of a permutation's four rounds."""
    return [int(_mixed(np.array([(seed * STEP + j) % 2**32], np.uint32))[0]) for j in range(1, 5)]


#: Half widths up to which the rounds are tables, and places that are permuted at a time (few enough to stay in a processor's cache).
TABLE_BITS, PERMUTED_AT_ONCE = 16, 1 << 14


@lru_cache(maxsize=64)
def _round_tables(half: int, seed: int) -> list[np.ndarray]:
    """What each round makes of every right half."""
    right = np.arange(1 << half, dtype=np.uint32)
    return [_mixed(right ^ np.uint32(k)).astype(np.int64) & ((1 << half) - 1) for k in round_keys(seed)]


def _walked(x: np.ndarray, half: int, seed: int) -> np.ndarray:
    """One step of the network."""
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    if half <= TABLE_BITS:
        made = np.empty_like(right)
        for table in _round_tables(half, seed):
            np.take(table, right, out=made, mode="clip")
            left ^= made
            left, right = right, left
    else:
        for k in round_keys(seed):
            left, right = right, left ^ (_mixed(right.astype(np.uint32) ^ np.uint32(k)).astype(np.int64) & mask)
    left <<= half
    left |= right
    return left


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 sends each x: a four-round Feistel network over a square of a power of two, walked until it is below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    out = np.array(x, np.int64)
    for i in range(0, len(out), PERMUTED_AT_ONCE):
        part = out[i : i + PERMUTED_AT_ONCE]
        part[:] = y = _walked(part, half, seed)
        far = np.flatnonzero(y >= n)
        while len(far):
            y = _walked(part[far], half, seed)
            part[far] = y
            far = far[y >= n]
    return out


def shuffled_block(df: DataFrame, columns: Sequence[str], key: str, seed: int) -> DataFrame:
    """df with the columns' values, as a block, dealt to other rows by a keyed permutation of the rows' places in order of ``key``."""
    return shuffled_blocks(df, columns, key, [seed]).drop("_seed")


def shuffled_blocks(df: DataFrame, columns: Sequence[str], key: str, seeds: Sequence[int], parts: int = 32) -> DataFrame:
    """``shuffled_block`` for each of the seeds, with _seed, in one pass.

    Rows are ranked once, by buckets of ids, so no task sorts all of them; where each takes its values from is computed, not
    sorted for, and one join by place fetches them for all seeds.
    """
    n = df.count()
    ranked = _ranked(df, F.col(key).cast("double"), [key], parts).withColumn("_rank", F.col("_rank") - 1)
    given = ranked.select(*(F.col(c).alias(f"_{c}") for c in columns), F.col("_rank").alias("_r"))
    asking = ranked
    schema = asking.withColumn("_seed", F.lit(0)).withColumn("_from", F.lit(0).cast("long")).schema

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            for s in seeds:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(rank), s, np.int32)), pa.array(permuted(rank, n, s))], names=schema.names)

    joined = asking.mapInArrow(ask, schema).join(given, F.col("_from") == F.col("_r"))
    return joined.select(*(F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns), "_seed")


def _ranked(df: DataFrame, by, ties: list[str], parts: int = 32) -> DataFrame:
    """df with _rank, the place of each row, from 1, in order of an expression."""
    valued = df.withColumn("_by", by)
    edges = sorted(set(valued.approxQuantile("_by", [i / parts for i in range(1, parts)], 0.01)))
    cut = F.lit(0)
    for e in edges:
        cut = cut + F.when(F.col("_by") > F.lit(e), 1).otherwise(0)
    # a task for each cut: hashed, some tasks would have several
    valued = valued.withColumn("_cut", cut).repartitionById(len(edges) + 1, F.col("_cut"))
    sizes = valued.groupBy("_cut").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_cut", (F.sum("_n").over(Window.orderBy("_cut")) - F.col("_n")).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_cut").orderBy("_by", *ties))
    return valued.join(F.broadcast(sizes), "_cut").withColumn("_rank", within + F.col("_first")).drop("_by", "_cut", "_first")


#: Places whose values one task hands out to the rows of all repeats that ask for them; rows of all repeats in one range of scores.
BLOCK, RANGE_ROWS = 1 << 16, 1 << 21
#: Rows of several repeats that a task holds at a time.
ROWS_AT_ONCE = 1 << 20
#: A batch that Python gets, in bytes.
BATCH_BYTES = "32m"


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of small whole keys, and where each run of equal keys begins and ends in that order."""
    order = np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")
    begin = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return order, begin, np.append(begin[1:], len(keys))


def _packed(keys: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each key, given its run of rows: these as an Arrow stream."""
    data = []
    for i, j in zip(begin.tolist(), end.tolist(), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_batch(rows.slice(i, j - i))
        data.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(np.full(len(begin), kind, np.int32)), pa.array(data, pa.binary())], names=["at", "kind", "data"])


def _unpacked(data: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(data.as_buffer()) as stream:
        return stream.read_next_batch()


def _gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many or somewhat more, the last one less; none is empty."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


#: Cells of even width in which edges are looked up.
CELLS = 1 << 16


def _below(edges: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function that counts the edges (in order) below each value. Cells of even width settle it for all values that share theirs with no edge."""
    with np.errstate(all="ignore"):
        scale = (CELLS - 2) / (edges[-1] - edges[0]) if len(edges) > 1 else np.inf
    if not 0 < scale < np.inf:
        return lambda x: np.searchsorted(edges, x, "left")

    def cell(x: np.ndarray) -> np.ndarray:
        # never falls as x grows, whatever the rounding
        with np.errstate(over="ignore"):
            return np.clip((x - edges[0]) * scale + 1, 0, CELLS).astype(np.int64)

    of, cells = cell(edges), np.arange(CELLS + 1)
    first = np.searchsorted(of, cells, "left")
    first[np.searchsorted(of, cells, "right") > first] = -1

    def count(x: np.ndarray) -> np.ndarray:
        out = first[cell(x)]
        unsettled = np.flatnonzero(out < 0)
        out[unsettled] = np.searchsorted(edges, x[unsettled], "left")
        return out

    return count


def _by_score(repeat: np.ndarray, score: np.ndarray, pos: np.ndarray, neg: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeat, positives and negatives of each distinct score of each repeat, the greatest score of a repeat first."""
    score = score + 0.0  # one zero
    some = score[:: len(score) // 4096 + 1]
    if len(np.unique(some)) * 2 < len(some):
        # few scores: they are numbered, not sorted
        coded = pc.dictionary_encode(pa.array(score))
        values = coded.dictionary.to_numpy()
        if len(values) * m <= 4 * len(score):
            number = np.empty(len(values), np.int64)
            number[np.argsort(-values)] = np.arange(len(values))
            code = number[coded.indices.to_numpy()] + repeat.astype(np.int64) * len(values)
            p, q = (np.bincount(code, x, len(values) * m) for x in (pos, neg))
            there = np.flatnonzero(p + q)
            return there // len(values), p[there].astype(np.int64), q[there].astype(np.int64)
    order = np.argsort(-score)
    order = order[_runs(repeat[order])[0]]
    repeat, score = repeat[order], score[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(repeat) != 0) | (np.diff(score) != 0)]))
    p, q = (np.add.reduceat(x[order].astype(np.int64), new) for x in (pos, neg))
    return repeat[new], p, q


def _range_sums(m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each range of scores as one row: positives and negatives of each repeat, and, packed, of each of its scores."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for at, data in zip(batch.column("at").to_pylist(), batch.column("data"), strict=True):
                held.setdefault(at, []).append(_unpacked(data))
        while held:
            at, rows = held.popitem()
            whole = _joined(rows)
            of, p, q = _by_score(*(whole.column(c).to_numpy() for c in ("repeat", "score", "pos", "neg")), m)
            kind = np.int32 if max(p.max(), q.max()) < 1 << 31 else np.int64
            packed = _packed(np.array([at], np.int32), np.array([0]), np.array([len(of)]), 0, pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(p.astype(kind)), pa.array(q.astype(kind))], names=["repeat", "pos", "neg"]))
            both = [pa.array([np.bincount(of, x, m).astype(np.int64)]) for x in (p, q)]
            yield pa.RecordBatch.from_arrays([packed.column("at"), *both, packed.column("data")], names=["at", "pos", "neg", "data"])

    return sums


#: A score of a fitted model: a Column over the features, or a function of their arrays by name (a missing value is NaN). The function
#: is called where the values come together, so rows need not go through the JVM once more; with a Column they do.
Score = Column | Callable[[dict[str, np.ndarray]], np.ndarray]


class _Shuffles:
    """ROC-AUC and average precision of a score under shuffles of columns, all repeats together.

    Rows are ranked once and kept. For each repeat a row asks for the values at one place; askers travel packed, by blocks of places, to
    the task that has the block's values. Scores then travel packed, by ranges of scores, to a task of each range, which adds up the
    positives and negatives of each score and repeat; these are kept. A pass that knows what stands above each range walks down its
    scores. The driver gets two numbers a range and repeat.
    """

    def __init__(self, df: DataFrame, score: Score, key: str, label: str):
        self.score, self.label = score, label
        self.columns = [c for c in df.columns if c != key or not isinstance(score, Column) or c in str(score)]
        conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        if name not in conf.getAll:
            conf.set(name, BATCH_BYTES)
        rows = df.select(*df.columns).persist()
        self.n = rows.count()
        ranked = _ranked(rows, F.col(key).cast("double"), [key], max(48, self.n >> 19)).select(*self.columns, (F.col("_rank") - 1).alias("_rank"))
        self.rows = ranked.persist()
        self.rows.count()
        rows.unpersist()

    def close(self) -> None:
        self.rows.unpersist()

    def _checked(self, df: DataFrame, *more: str) -> DataFrame:
        y, s = F.col(self.label).cast("int"), self.score.cast("double")
        s = F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.raise_error(F.lit("a score is not finite"))).otherwise(s)
        y = F.when(y.isNull() | ~y.isin(0, 1), F.raise_error(F.lit("a label is neither 0 nor 1"))).otherwise(y)
        return df.select(*more, s.alias("score"), y.cast("int").alias("pos"))

    def _scorer(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Batches with score and pos in place of the columns, by a function."""
        function, label = self.score, self.label

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [c for c in batch.schema.names if c == "_repeat"]
                score = np.asarray(function({c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c not in kept}), np.float64)
                if score.shape != (batch.num_rows,):
                    raise ValueError("a score function gives one number a row")
                if not np.isfinite(score).all():
                    raise ValueError("a score is not finite")
                y = batch.column(label)
                pos = pc.cast(y, pa.int32(), safe=False)
                if y.null_count or not pc.all(pc.is_in(pos, pa.array([0, 1], pa.int32())), min_count=0).as_py():
                    raise ValueError("a label is neither 0 nor 1")
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score), pos], names=[*kept, "score", "pos"])

        return scored

    def scored(self, rows: DataFrame) -> DataFrame:
        """score and pos of rows."""
        if isinstance(self.score, Column):
            return self._checked(rows)
        return rows.select(*self.columns).mapInArrow(self._scorer(), "score double, pos int")

    def _asked(self, columns: Sequence[str], seeds: Sequence[int]) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], object]:
        """Askers by block of places, what a task makes of them (_repeat and the columns, the given ones shuffled), and its schema."""
        moved = [c for c in self.columns if c in columns]
        stay = [c for c in self.columns if c not in columns]
        n, m, at_once = self.n, len(seeds), ROWS_AT_ONCE
        # a power of two
        size = min(BLOCK, 1 << max(10, ((n - 1) // 64).bit_length()))
        bits = size.bit_length() - 1
        repeat_type = np.int16 if m < 1 << 15 else np.int32

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(batches, max(1, at_once // m)):
                rank = batch.column("_rank").to_numpy()
                order, begin, end = _runs(rank >> bits)
                own = pa.array(order)
                place = pa.array((rank[order] & (size - 1)).astype(np.int32))
                yield _packed(rank[order[begin]] >> bits, begin, end, 0, pa.RecordBatch.from_arrays([place, *(batch.column(c).take(own) for c in moved)], names=["_place", *moved]))
                step = max(1, at_once // len(rank))
                for i in range(0, m, step):
                    some = np.arange(i, min(i + step, m), dtype=repeat_type)
                    source = np.concatenate([permuted(rank, n, seeds[j]) for j in some.tolist()])
                    order, begin, end = _runs(source >> bits)
                    own = pa.array(np.tile(np.arange(len(rank), dtype=np.int32), len(some))[order])
                    place = source[order]
                    made = [pa.array(np.repeat(some, len(rank))[order]), pa.array((place & (size - 1)).astype(np.int32 if size > 1 << 16 else np.uint16)), *(batch.column(c).take(own) for c in stay)]
                    yield _packed(place[begin] >> bits, begin, end, 1, pa.RecordBatch.from_arrays(made, names=["_repeat", "_place", *stay]))

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, parts, values = -1, [], None
            askers: list[pa.RecordBatch] = []

            def answered() -> pa.RecordBatch:
                got = _joined(askers)
                askers.clear()
                place = got.column("_place")
                return pa.RecordBatch.from_arrays([got.column("_repeat").cast(pa.int32()), *(got.column(c) for c in stay), *(values.column(c).take(place) for c in moved)], names=["_repeat", *stay, *moved])

            for batch in batches:
                for at, kind, data in zip(batch.column("at").to_pylist(), batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                    if at != block:
                        if askers:
                            yield answered()
                        block, parts, values = at, [], None
                    if kind == 0:
                        parts.append(_unpacked(data))
                        continue
                    if values is None:
                        whole = _joined(parts)
                        values, parts = whole.take(pa.array(np.argsort(whole.column("_place").to_numpy()))), []
                    askers.append(_unpacked(data))
                    if sum(b.num_rows for b in askers) >= at_once >> 2:
                        yield answered()
            if askers:
                yield answered()

        asked = self.rows.mapInArrow(ask, "at int, kind int, data binary").repartitionById(max(1, -(-n // size)), F.col("at")).sortWithinPartitions("at", "kind")
        return asked, answer, self.rows.select(F.lit(0).alias("_repeat"), *stay, *moved).schema

    def _edges(self, columns: Sequence[str], parts: int) -> list[float]:
        """Where scores are cut: quantiles with the columns shuffled within batches, which is near enough for ranges of even size."""
        moved = [c for c in self.columns if c in columns]

        def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                turn = pa.array(permuted(np.arange(batch.num_rows), batch.num_rows, 0)) if batch.num_rows else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(c).take(turn) if c in moved else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

        like = self.scored(self.rows.mapInArrow(mixed, self.rows.schema))
        return sorted(set(like.approxQuantile("score", [i / parts for i in range(1, parts)], 0.25 / parts)))

    def metrics(self, columns: Sequence[str], seeds: Sequence[int]) -> np.ndarray:
        """(2, seeds): ROC-AUC and average precision, NaN where a class is missing."""
        m = len(seeds)
        if not self.n or not m:
            return np.full((2, m), np.nan)
        parts = max(32, self.n * m // RANGE_ROWS)
        edges = np.array(self._edges(columns, parts))
        tied, at_once = len(edges) < parts - 1, ROWS_AT_ONCE
        below = _below(edges)
        repeat_type = np.int16 if m < 1 << 15 else np.int32

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(batches, at_once):
                repeat, score, pos = (batch.column(c).to_numpy() for c in ("_repeat", "score", "pos"))
                if tied:  # rows of a frequent score are added up where they lie
                    order = np.lexsort((score, repeat))
                    repeat, score, pos = (x[order] for x in (repeat, score, pos))
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(repeat) != 0) | (np.diff(score) != 0)]))
                    repeat, score, pos, neg = repeat[new], score[new], np.add.reduceat(pos, new), np.add.reduceat(1 - pos, new)
                else:
                    pos = pos.astype(np.int8)
                    neg = 1 - pos
                # the greatest scores come first
                cut = len(edges) - below(score)
                order, begin, end = _runs(cut)
                made = [pa.array(x[order]) for x in (repeat.astype(repeat_type), score, pos, neg)]
                yield _packed(cut[order[begin]], begin, end, 0, pa.RecordBatch.from_arrays(made, names=["repeat", "score", "pos", "neg"]))

        asked, answer, schema = self._asked(columns, seeds)
        if isinstance(self.score, Column):
            messages = self._checked(asked.mapInArrow(answer, schema), "_repeat").mapInArrow(pack, "at int, kind int, data binary")
        else:
            scored = self._scorer()
            messages = asked.mapInArrow(lambda batches: pack(scored(answer(batches))), "at int, kind int, data binary")
        summed = messages.select("at", "data").repartitionById(parts, F.col("at")).mapInArrow(_range_sums(m), "at int, pos array<long>, neg array<long>, data binary").persist(StorageLevel.DISK_ONLY)

        try:
            before, upto = {}, np.zeros((2, m))
            for r in sorted(summed.select("at", "pos", "neg").collect(), key=lambda r: r["at"]):
                before[r["at"]], upto = upto, upto + np.array([r.pos, r.neg])
            all_neg = upto[1]

            def account(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at, data in zip(batch.column("at").to_pylist(), batch.column("data"), strict=True):
                        of, p, q = (c.to_numpy().astype(np.int64) for c in _unpacked(data).columns)
                        first = np.searchsorted(of, np.arange(m))[of]  # where each repeat begins
                        tp, fp = (np.cumsum(x) - (np.cumsum(x) - x)[first] + before[at][i, of] for i, x in enumerate((p, q)))
                        won, precision = np.bincount(of, p * (all_neg[of] - fp + q / 2), m), np.bincount(of, p * (tp / (tp + fp)), m)
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([won]), pa.array([precision])], names=["at", "x", "y"])

            found = {r["at"]: np.array([r.x, r.y]) for r in summed.select("at", "data").mapInArrow(account, "at int, x array<double>, y array<double>").collect()}
        finally:
            summed.unpersist()
        won = sum(found[at] for at in sorted(found))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where((upto > 0).all(axis=0), np.stack([won[0] / (upto[0] * upto[1]), won[1] / upto[0]]), np.nan)


def _study(df: DataFrame, found: np.ndarray) -> DataFrame:
    rows = [(i, *(None if np.isnan(x) else float(x) for x in found[:, i])) for i in range(found.shape[1])]
    return df.sparkSession.createDataFrame(rows, "repeat int, roc_auc double, average_precision double")


def block_shuffle_study(df: DataFrame, score: Score, columns: Sequence[str], key: str, label: str = "label", repeats: int = 50, seed: int = 42) -> DataFrame:
    """repeat, roc_auc, average_precision of a fitted ``score`` (Column, or function of arrays, over the features) with the columns shuffled as a block; no refit.

    The values go where ``shuffled_block`` of seed + repeat puts them.
    """
    shuffles = _Shuffles(df, score, key, label)
    try:
        return _study(df, shuffles.metrics(columns, range(seed, seed + repeats)))
    finally:
        shuffles.close()


def study_summary(study: DataFrame, baseline_ap: float, baseline_auc: float) -> DataFrame:
    """Means, sample deviations, quantiles, and the shares of repeats below the baselines."""
    auc, ap = F.col("roc_auc"), F.col("average_precision")
    below = lambda c, base: F.avg((c < base).cast("double"))
    return study.agg(F.avg(auc).alias("mean_roc_auc"), F.stddev_samp(auc).alias("std_roc_auc"), below(auc, baseline_auc).alias("share_below_roc_auc"), F.avg(ap).alias("mean_ap"), F.stddev_samp(ap).alias("std_ap"), F.percentile(ap, F.lit(0.025)).alias("low_ap"), F.percentile(ap, F.lit(0.975)).alias("high_ap"), below(ap, baseline_ap).alias("share_below_ap"))


def permutation_importance(df: DataFrame, score: Score, columns: Sequence[str], key: str, label: str = "label", repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, importance, deviation: how much average precision a fitted ``score`` loses with one column shuffled. Rows are ranked once for all columns."""
    shuffles, out = _Shuffles(df, score, key, label), None
    try:
        base = average_precision(shuffles.scored(shuffles.rows), "score", "pos").first()[0]
        for c in columns:
            study = _study(df, shuffles.metrics([c], range(seed, seed + repeats)))
            one = study.agg(F.avg(F.lit(base) - F.col("average_precision")).alias("importance"), F.stddev_samp("average_precision").alias("deviation")).withColumn("feature", F.lit(c))
            out = one if out is None else out.unionByName(one)
    finally:
        shuffles.close()
    return out.select("feature", "importance", "deviation")


def boosted_trees(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 100, depth: int = 5) -> tuple[DataFrame, dict[str, float]]:
    """test with score, and each feature's share of the gain. Missing values are that, in training and in scoring (``boosting``)."""
    for part in (train, test):
        check_features(part, columns)
    model = boosting.fit(train, columns, label, trees, depth)
    return test.withColumn("score", model.score()), model.importance
