"""What a leakage study found, as a table, a verdict in words, and a report in Markdown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.metrics import study_summary
from tidemark.sources.sinks import markdown_table

#: Deviations by which a mean importance must clear 0, and the share of shuffles that must score lower.
CLEAR, MOST = 2.0, 0.95


@dataclass(frozen=True)
class Interval:
    """A gain of the model that sees the future over the one that does not, and where its resamples lie."""

    metric: str
    delta: float
    low: float
    high: float

    @property
    def sign(self) -> int:
        """1 or -1 where the whole interval is on one side of 0, else 0."""
        return 1 if self.low > 0 else -1 if self.high < 0 else 0


@dataclass(frozen=True)
class Findings:
    """The numbers of a study, a few of each kind."""

    events_after: int  # events of the sample's entity behind its cutoff
    events_at: int
    intervals: Sequence[Interval]
    importance: Mapping[str, tuple[float, float]]  # of each future feature: mean loss, deviation
    shuffled: Mapping[str, tuple[float, float]]  # of each metric: mean loss with the future shuffled, share of shuffles that score lower

    @property
    def top_feature(self) -> tuple[str, float, float]:
        name = max(self.importance, key=lambda n: (self.importance[n][0], n))
        return (name, *self.importance[name])

    @property
    def relies_on_one(self) -> bool:
        _, mean, deviation = self.top_feature
        return mean - CLEAR * deviation > 0

    @property
    def relies_on_block(self) -> bool:
        return bool(self.shuffled) and all(loss > 0 and share >= MOST for loss, share in self.shuffled.values())


def findings(events_after: int, events_at: int, bootstrap: DataFrame, importance: DataFrame, study: DataFrame, baseline: Mapping[str, float]) -> Findings:
    """From ``paired_bootstrap``, ``permutation_importance`` and ``block_shuffle_study``; ``baseline`` has the unshuffled roc_auc and average_precision."""
    intervals = [Interval(r.metric, r.delta, r.low, r.high) for r in bootstrap.orderBy("metric").collect()]
    weights = {r.feature: (r.importance, r.deviation or 0.0) for r in importance.collect()}
    s = study_summary(study, baseline["average_precision"], baseline["roc_auc"]).first()
    shuffled = {"roc_auc": (baseline["roc_auc"] - s.mean_roc_auc, s.share_below_roc_auc), "average_precision": (baseline["average_precision"] - s.mean_ap, s.share_below_ap)}
    return Findings(events_after, events_at, intervals, weights, shuffled)


def evidence_table(spark: SparkSession, f: Findings) -> DataFrame:
    """question, finding, supports: one row per kind of evidence. ``supports`` is null where the kind cannot speak for or against."""
    name, mean, deviation = f.top_feature
    gains = "; ".join(f"{i.metric} {i.delta:+.6f}" for i in f.intervals)
    spans = "; ".join(f"{i.metric} [{i.low:+.6f}, {i.high:+.6f}]" for i in f.intervals)
    losses = "; ".join(f"{m} {loss:+.6f} (lower in {share:.1%})" for m, (loss, share) in f.shuffled.items())
    rows = [
        ("Is what the feature shows known at the cutoff?", f"No: it looks at (cutoff, cutoff + window]; the sample has {f.events_after} events behind its cutoff and {f.events_at} at it, none of which a prediction may see.", True),
        ("Does seeing the future change the scores?", gains, None),
        ("Does the model lean on a single future feature?", f"{name} {mean:+.6f}, deviation {deviation:.6f}", f.relies_on_one),
        ("Does the right row's future matter?", losses, f.relies_on_block),
        ("Does the gain hold when rows are drawn anew?", spans, all(i.sign > 0 for i in f.intervals)),
    ]
    return spark.createDataFrame(rows, "question string, finding string, supports boolean")


def verdict(f: Findings) -> str:
    """In words. That the future is used is a leak by itself; the numbers only say how much it shows."""
    name, mean, deviation = f.top_feature
    parts = ["Features over (cutoff, cutoff + window] are a leak whatever the scores say: they are not known when the prediction is made."]
    if f.relies_on_one:
        parts.append(f"The model leans on {name}: shuffled alone it costs {mean:.6f} (deviation {deviation:.6f}) of average precision.")
    else:
        parts.append(f"No single future feature clears {CLEAR:g} deviations (most: {name}, {mean:.6f}); features that say the same can stand in for one another, so this does not clear the model.")
    parts.append("Shuffling the future as a block lowers every metric nearly always: the model relies on it." if f.relies_on_block else "Shuffling the future as a block lowers the metrics too seldom to say that the model relies on it.")
    words = {1: "lies above 0", -1: "lies below 0", 0: "holds 0, so size and sign of the gain are open"}
    parts += [f"The interval of {i.metric}, [{i.low:+.6f}, {i.high:+.6f}], {words[i.sign]}." for i in f.intervals]
    return " ".join(parts)


def report(title: str, facts: Mapping[str, object], models: Sequence[tuple[str, int, float, float]], f: Findings) -> str:
    """Markdown: facts of the cohort, models (name, features, roc_auc, average_precision), evidence, verdict."""
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in facts.items()), "", "## Models", ""]
    lines.append(markdown_table(["model", "features", "roc_auc", "average_precision"], [(n, k, f"{a:.6f}", f"{p:.6f}") for n, k, a, p in models]))
    lines += ["## Gains", "", markdown_table(["metric", "gain", "low", "high"], [(i.metric, f"{i.delta:+.6f}", f"{i.low:+.6f}", f"{i.high:+.6f}") for i in f.intervals])]
    lines += ["## Future features", "", markdown_table(["feature", "importance", "deviation"], [(n, f"{m:+.6f}", f"{d:.6f}") for n, (m, d) in sorted(f.importance.items(), key=lambda x: (-x[1][0], x[0]))])]
    lines += ["## Future shuffled", "", markdown_table(["metric", "loss", "share lower"], [(m, f"{loss:+.6f}", f"{share:.3f}") for m, (loss, share) in f.shuffled.items()])]
    return "\n".join([*lines, "## Verdict", "", verdict(f), ""])
