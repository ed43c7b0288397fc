"""Rolling features of an entity over [cutoff - window, cutoff), and their future-looking twins over (cutoff, cutoff + window].

Several physical strategies give the same values:

auto     (default) range for most entities, prefix for those of MANY_ROWS events or more; one pass counts them.
range    one window with RANGE frames: one shuffle, one sort; the cost of an entity grows with rows x frame.
prefix   two levels: an entity's time is cut into buckets, whole buckets come from running sums over buckets, the ends of
         a window from running sums within its bucket. Linear in rows whatever the window, and an entity of any
         number of rows is spread over many tasks.
chunked  range within (entity, stretch of time): a stretch is as long as the longest window and gets the events of the
         stretch before as well.

Rows without an entity see no history: they get the defaults without being shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeutil import micros, whole_seconds
from tidemark.operators.carry import BUCKET_ROWS, FEW_KEYS, HOT_ROWS, bucketed, carried_in, dealt, heat_of
from tidemark.plans.catalog import FeatureCatalog, FeatureDefinition

STRATEGIES = ("auto", "range", "prefix", "chunked")
#: Events of one entity from which "auto" takes running sums.
MANY_ROWS = 5_000
SPINE = ("label_id", "uid", "cutoff_ts", "label")


def spine(transactions: DataFrame) -> DataFrame:
    """One prediction point per transaction: label_id, uid, cutoff_ts, label."""
    return transactions.select(F.col("transaction_id").alias("label_id"), "uid", F.col("event_ts").alias("cutoff_ts"), "label")


def history(transactions: DataFrame) -> DataFrame:
    """What features may look at: uid, feature_ts, amount, event_id; rows without an entity are no history."""
    return transactions.filter("uid is not null").select("uid", F.col("event_ts").alias("feature_ts"), "amount", F.col("transaction_id").alias("event_id"))


def prefix_sums(events: DataFrame, hot_rows: int | None = HOT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """uid, feature_ts, amount, event_id, cumulative_amount, cumulative_count: one row per entity and instant.

    Entities of ``hot_rows`` instants or more are spread over buckets of time, into which the sums before are carried; None
    leaves out the counting of entities, and each is one task's.
    """
    once = events.groupBy("uid", "feature_ts").agg(F.sum("amount").alias("amount"), F.max("event_id").alias("event_id"), F.count("*").alias("n"))
    once = once.select(F.col("uid").alias("key"), micros(F.col("feature_ts")).alias("at"), "feature_ts", "amount", "event_id", "n")
    heat = heat_of(once.select("key", "at"), hot_rows, bucket_rows) if hot_rows is not None else None
    rows = bucketed(once, heat).withColumn("is_row", F.lit(True))
    if heat is not None:
        carried = carried_in(rows, {"amount": (F.sum("amount"), F.sum), "n": (F.sum("n"), F.sum)})
        rows = rows.unionByName(carried.withColumn("is_row", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy("key", "bucket").orderBy("is_row", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(F.col("key").alias("uid"), "feature_ts", "amount", "event_id", F.sum("amount").over(upto).alias("cumulative_amount"), F.sum("n").over(upto).alias("cumulative_count"), "is_row")
    return sums.filter("is_row").drop("is_row")


def future_name(feature: FeatureDefinition) -> str:
    return "time_to_next_txn_sec" if feature.aggregation == "time_since_last" else f"future_{feature.name}"


def _future_names(catalog: FeatureCatalog) -> dict[str, str]:
    names = {f.name: future_name(f) for f in catalog.features}
    if len(set(names.values())) < len(names):
        raise ValueError("two features of the catalog have one future name")
    return names


def _typed(value: Column, feature: FeatureDefinition) -> Column:
    """A feature's value: its default over an empty window, in its type."""
    if feature.aggregation == "count":
        return F.coalesce(value, F.lit(feature.default_value)).cast("long")
    return (F.coalesce(value, F.lit(float(feature.default_value))) if feature.default_value is not None else value).cast("double")


def _framed(feature: FeatureDefinition, keys: list[str], future: bool) -> Column:
    """The feature over rows with us, sec, and amount and flag (1) where the row is an event."""
    w = Window.partitionBy(*keys).orderBy("us")
    w = w.rangeBetween(1, feature.window_us) if future else w.rangeBetween(-feature.window_us, -1)
    if feature.aggregation == "sum":
        return F.sum("amount").over(w)
    if feature.aggregation == "count":
        return F.sum("flag").over(w)
    seen = F.when(F.col("flag") == 1, F.col("sec"))
    return F.min(seen).over(w) - F.col("sec") if future else F.col("sec") - F.max(seen).over(w)


def _by_frames(points: DataFrame, events: DataFrame, wanted: list[tuple[str, FeatureDefinition, bool]], chunk_us: int | None) -> DataFrame:
    """points (k: struct of the spine columns, uid, us) and events (uid, us, amount) in one window."""
    rows = points.select("k", "uid", "us", F.lit(None).cast("double").alias("amount"), F.lit(0).alias("flag"))
    past = events.select(F.lit(None).cast(points.schema["k"].dataType).alias("k"), "uid", "us", F.col("amount").cast("double").alias("amount"), F.lit(1).alias("flag"))
    keys = ["uid"]
    if chunk_us:
        keys = ["uid", "chunk"]
        own = F.floor(F.col("us") / chunk_us)
        near = [own, own + 1] if not any(f for _, _, f in wanted) else [own - 1, own, own + 1]
        rows, past = rows.withColumn("chunk", own), past.withColumn("chunk", F.explode(F.array(*near)))
    both = rows.unionByName(past).withColumn("sec", whole_seconds(F.col("us")))
    values = [_framed(f, keys, future).alias(name) for name, f, future in wanted]
    return both.select("k", "flag", *values).filter("flag = 0").select("k", *(_typed(F.col(name), f).alias(name) for name, f, _ in wanted))


def _by_prefixes(points: DataFrame, events: DataFrame, wanted: list[tuple[str, FeatureDefinition, bool]], hot_rows: int | None, bucket_rows: int) -> DataFrame:
    """Differences of running sums at the two ends of each window: one union, one shuffle by entity, one by prediction point.

    What comes after a point is what comes before it in reversed time, so future windows run in a time of their own (turn -1).
    """
    turns = sorted({-1 if future else 1 for _, _, future in wanted})
    times = F.explode(F.array(*(F.lit(t) for t in turns))).alias("turn")
    once = events.groupBy("uid", "us").agg(F.sum(F.col("amount").cast("double")).alias("a"), F.count("*").alias("n"))
    once = once.select(F.col("uid").alias("key"), "us", "a", "n", times).withColumn("at", F.col("us") * F.col("turn"))
    ends = sorted({(-1 if future else 1, w) for _, f, future in wanted for w in (0, f.window_us)})
    asked = points.select("k", "uid", "us", F.explode(F.array(*(F.struct(F.lit(t).alias("turn"), F.lit(w).alias("back")) for t, w in ends))).alias("p"))
    asked = asked.select("k", F.col("uid").alias("key"), F.col("p.turn").alias("turn"), F.col("p.back").alias("back"), (F.col("us") * F.col("p.turn") - F.col("p.back")).alias("at"))
    heat = heat_of(once.select("key", "at").unionByName(asked.select("key", "at")), hot_rows, bucket_rows) if hot_rows is not None else None
    # side: a probe comes before the events of its instant
    states = once.select("key", "turn", "at", F.lit(1).alias("side"), "a", "n", F.col("at").alias("last"))
    rows = bucketed(states.unionByName(asked.withColumn("side", F.lit(0)), allowMissingColumns=True), heat)
    if heat is not None:
        carried = carried_in(rows, {"a": (F.sum("a"), F.sum), "n": (F.sum("n"), F.sum), "last": (F.max("last"), F.max)}, ("key", "turn"))
        rows = rows.unionByName(carried.withColumn("side", F.lit(1)), allowMissingColumns=True)
    n = points.count() * len(ends)
    rows = dealt(rows, n + events.count() * len(turns), "key", "turn", "bucket")
    # carried rows have no instant and stand first
    before = Window.partitionBy("key", "turn", "bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.struct(F.coalesce(F.sum("a").over(before), F.lit(0.0)).alias("a"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.max("last").over(before).alias("last"))
    looked = dealt(rows.select("k", "key", "turn", "back", "side", seen.alias("s")).filter("side = 0"), n, "k", "key")
    name = {(t, w): f"{'f' if t < 0 else 'p'}{w}" for t, w in ends}
    per = looked.groupBy("k", "key").agg(*(F.max(F.when((F.col("turn") == t) & (F.col("back") == w), F.col("s"))).alias(n) for (t, w), n in name.items()))
    sec = whole_seconds(micros(F.col("k.cutoff_ts")))
    values = []
    for feature, f, future in wanted:
        turn = -1 if future else 1
        low, high = name[turn, f.window_us], name[turn, 0]
        if f.aggregation == "time_since_last":
            v = (whole_seconds(F.col(f"{high}.last") * turn) - sec) * -turn
        elif f.aggregation == "sum":
            v = F.col(f"{high}.a") - F.col(f"{low}.a")
        else:
            v = F.col(f"{high}.n") - F.col(f"{low}.n")
        # nothing in the window: exactly the default, whatever the rounding of the sums
        values.append(_typed(F.when(F.col(f"{high}.n") > F.col(f"{low}.n"), v), f).alias(feature))
    return per.select("k", *values)


def _many(keys: DataFrame, uid: str) -> DataFrame | None:
    """Entities with MANY_ROWS rows or more, one column ``of``; None if there are none. At most one in MANY_ROWS rows is one."""
    many = keys.filter(F.col(uid).isNotNull()).groupBy(F.col(uid).alias("of")).count().filter(F.col("count") >= MANY_ROWS).select("of")
    few = many.limit(FEW_KEYS + 1).collect()
    if not few:
        return None
    return F.broadcast(keys.sparkSession.createDataFrame(few, many.schema)) if len(few) <= FEW_KEYS else many


def rolling(points: DataFrame, events: DataFrame, wanted: list[tuple[str, FeatureDefinition, bool]], strategy: str = "auto", hot_rows: int | None = HOT_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """points (label_id, uid, cutoff_ts, label) with the wanted (name, feature, future) columns, over events (uid, feature_ts, amount).

    ``hot_rows`` and ``bucket_rows`` say when and how finely ``prefix`` spreads an entity over tasks.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    events = events.filter("uid is not null").select("uid", micros(F.col("feature_ts")).alias("us"), "amount")
    k = F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("k")
    keyed = points.select(k, "uid", micros(F.col("cutoff_ts")).alias("us"))
    known, unknown = keyed.filter("uid is not null"), keyed.filter("uid is null")
    names = [name for name, _, _ in wanted]
    own = [F.col(f"k.`{c}`").alias(c) for c in points.columns]

    def by_frames(known: DataFrame, events: DataFrame) -> DataFrame:
        return _by_frames(known, events, wanted, max(f.window_us for _, f, _ in wanted) if strategy == "chunked" else None).select(*own, *names)

    def by_prefixes(known: DataFrame, events: DataFrame) -> DataFrame:
        # the same prediction point may be there twice: number the copies
        known = known.withColumn("k", F.struct("k.*", F.monotonically_increasing_id().alias("_copy")))
        return _by_prefixes(known, events, wanted, hot_rows, bucket_rows).select(*own, *names)

    if strategy == "auto":
        many = _many(events, "uid")
        if many is None:
            done = by_frames(known, events)
        else:
            hot = by_prefixes(known.join(many, F.col("uid") == F.col("of"), "left_semi"), events.join(many, F.col("uid") == F.col("of"), "left_semi"))
            done = by_frames(known.join(many, F.col("uid") == F.col("of"), "left_anti"), events.join(many, F.col("uid") == F.col("of"), "left_anti")).unionByName(hot)
    else:
        done = (by_prefixes if strategy == "prefix" else by_frames)(known, events)
    empty = unknown.select(*own, *(_typed(F.lit(None).cast("double"), f).alias(name) for name, f, _ in wanted))
    return done.unionByName(empty)


def past_features(points: DataFrame, events: DataFrame, catalog: FeatureCatalog, strategy: str = "auto", **spread: int | None) -> DataFrame:
    """The catalog's features as of each prediction point."""
    return rolling(points, events, [(f.name, f, False) for f in catalog.features], strategy, **spread)


def future_features(points: DataFrame, events: DataFrame, catalog: FeatureCatalog, strategy: str = "auto", **spread: int | None) -> DataFrame:
    """The same names over what comes after the prediction point: a deliberate leak, for study only."""
    return rolling(points, events, [(f.name, f, True) for f in catalog.features], strategy, **spread)


def combined_features(points: DataFrame, events: DataFrame, catalog: FeatureCatalog, strategy: str = "auto", **spread: int | None) -> DataFrame:
    """Past features, and future ones under their own names, in one pass."""
    names = _future_names(catalog)
    return rolling(points, events, [(f.name, f, False) for f in catalog.features] + [(names[f.name], f, True) for f in catalog.features], strategy, **spread)


def build(transactions: DataFrame, catalog: FeatureCatalog, strategy: str = "auto", **spread: int | None) -> DataFrame:
    """Features of every transaction over all others of its entity.

    Prediction points and history are the same rows here, so "range" needs no union: each row is both.
    """
    if strategy not in ("range", "auto"):
        return past_features(spine(transactions), history(transactions), catalog, strategy, **spread)
    if strategy == "auto":
        many = _many(transactions.select("uid"), "uid")
        if many is not None:
            hot = transactions.join(many, F.col("uid") == F.col("of"), "left_semi")
            hot = past_features(spine(hot), history(hot), catalog, "prefix", **spread)
            # an anti join keeps rows without an entity
            return build(transactions.join(many, F.col("uid") == F.col("of"), "left_anti"), catalog, "range").unionByName(hot)
    rows = transactions.select(F.col("transaction_id").alias("label_id"), "uid", F.col("event_ts").alias("cutoff_ts"), "label", F.col("amount").cast("double").alias("amount"), micros(F.col("event_ts")).alias("us"), F.lit(1).alias("flag"))
    known = rows.filter("uid is not null").withColumn("sec", whole_seconds(F.col("us")))
    values = [_typed(_framed(f, ["uid"], False), f).alias(f.name) for f in catalog.features]
    empty = rows.filter("uid is null").select(*SPINE, *(_typed(F.lit(None).cast("double"), f).alias(f.name) for f in catalog.features))
    return known.select(*SPINE, *values).unionByName(empty)
