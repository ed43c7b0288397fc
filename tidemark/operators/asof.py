"""As-of joins as one union, one shuffle and one window: linear in both sides, whatever the number of rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.carry import BUCKET_ROWS, HOT_ROWS, bucketed, carried_in, dealt, heat_of


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, values: Sequence[str], direction: str = "backward", strict: bool = True, shift: int = 0, hot_rows: int | None = HOT_ROWS, bucket_rows: int = BUCKET_ROWS, about: int | None = None) -> DataFrame:
    """Each left row with ``values`` of the nearest right row of its ``by`` key; nulls where there is none.

    backward: the latest right row with right_on < left_on + shift (<= if not strict). forward: the earliest with
    right_on > left_on + shift (>= if not strict). Null keys and null instants match nothing. Of right rows at one instant any
    may come back: make (by, right_on) unique first. left_on and right_on are integers, such as microseconds.

    Keys of ``hot_rows`` rows or more, both sides together, are spread over buckets of time, into which the last state of the
    buckets before is carried; None leaves out the counting of keys and every key is one task's. ``about``: the number of rows of both sides, if known; a great many get more tasks.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"unknown direction {direction!r}")
    kinds = dict(right.dtypes)
    own = F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("own")
    # forward is backward in reversed time
    turned = 1 if direction == "backward" else -1
    # at an equal instant a probe comes before states it must not see, or after those it may
    at_probe, at_state = ((F.col(left_on) + F.lit(shift)) * turned).cast("long"), (F.col(right_on) * turned).cast("long")
    probes = left.select(F.col(by).alias("key"), at_probe.alias("at"), F.lit(0 if strict else 2).alias("side"), own, F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("state"))
    states = right.filter(F.col(by).isNotNull() & F.col(right_on).isNotNull()).select(F.col(by).alias("key"), at_state.alias("at"), F.lit(1).alias("side"), F.lit(None).cast(probes.schema["own"].dataType).alias("own"), F.struct(*values).alias("state"))
    asking = F.col("key").isNotNull() & F.col("at").isNotNull()
    rows = probes.filter(asking).unionByName(states)
    heat = heat_of(rows.select("key", "at"), hot_rows, bucket_rows) if hot_rows is not None else None
    rows = bucketed(rows, heat)
    if heat is not None:
        latest = F.max_by("state", F.when(F.col("side") == 1, F.col("at")))
        carried = carried_in(rows, {"state": (latest, lambda c: F.last(c, ignorenulls=True))})
        # side 1: a state, and not asked for; it stands before all instants
        rows = rows.unionByName(carried.withColumns({"at": F.lit(None).cast("long"), "side": F.lit(1), "own": F.lit(None).cast(probes.schema["own"].dataType), "hot": F.lit(True)}))
    if about is not None:
        rows = dealt(rows, about, "key", "bucket")
    window = Window.partitionBy("key", "bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    matched = rows.withColumn("found", F.last("state", ignorenulls=True).over(window)).filter("side != 1")
    unmatched = probes.filter(~asking).withColumn("found", F.col("state"))
    result: list[Column | str] = ["own.*", *(F.col(f"found.{v}").cast(kinds[v]).alias(v) for v in values)]
    return matched.select("own", "found").unionByName(unmatched.select("own", "found")).select(*result)
