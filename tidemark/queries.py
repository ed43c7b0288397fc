"""Queries over the star-schema tables, and the SQL of each.

The SQL is formulated apart from the plans: rolling features as joins and group-bys, as-of joins as correlated
aggregates, metrics by counting pairs, so that it can find fault with them.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import entity_key
from tidemark.functions.timeutil import from_micros, micros, shifted
from tidemark.operators import cohort, entity, features, metrics, monitoring, parity, profiling, warehouse
from tidemark.operators.asof import asof_join
from tidemark.plans import backfill
from tidemark.plans.catalog import FeatureCatalog, FeatureDefinition, load_catalog
from tidemark.plans.roles import EVENTS, EVENTS_SOME_NULL, LINEITEM, ORDERS, Roles, transactions
from tidemark.sources import readers, sinks
from tidemark.sources.versions import Versions
from tidemark.streaming import online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def facts(spark: SparkSession, sf_dir: str, roles: Roles = EVENTS) -> DataFrame:
    table = {id(EVENTS): "events", id(EVENTS_SOME_NULL): "events", id(ORDERS): "orders", id(LINEITEM): "lineitem"}[id(roles)]
    return transactions(spark.read.parquet(f"{sf_dir}/{table}.parquet"), roles)


def custom(*rows: tuple[str, str, int]) -> FeatureCatalog:
    source = {"sum": ("amount", 0), "count": ("transaction_id", 0), "time_since_last": ("event_ts", None)}
    return FeatureCatalog("1.0.0", tuple(FeatureDefinition(n, n, "uid", a, source[a][0], h, "event_ts", "1.0.0", source[a][1]) for n, a, h in rows))


SHIPPED = [("sum_amt_24h", "sum", 24), ("count_txn_24h", "count", 24), ("sum_amt_7d", "sum", 168), ("time_since_last_txn_sec", "time_since_last", 720)]
WEEK = [("sum_amt_24h", "sum", 24), ("count_txn_24h", "count", 24), ("time_since_last_txn_sec", "time_since_last", 168)]


def cents(df: DataFrame) -> DataFrame:
    """Sums of money at two decimals: float sums depend on their order beyond that."""
    return df.select(*(F.round(c, 2).alias(c) if "sum" in c or c in ("amount", "cumulative_amount") else F.col(c) for c in df.columns))


# ---------------------------------------------------------------- SQL building blocks

_EV = "SELECT event_id AS transaction_id, CAST({uid} AS VARCHAR) AS uid, ts AS event_ts, CAST(value AS DOUBLE) AS amount, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS SMALLINT) AS label FROM events"
T = {
    "events": _EV.format(uid="user_id"),
    "some_null": _EV.format(uid="CASE WHEN event_type = 'signup' THEN NULL ELSE user_id END"),
    "orders": "SELECT o_orderkey AS transaction_id, CAST(o_custkey AS VARCHAR) AS uid, o_orderdate AS event_ts, CAST(o_totalprice AS DOUBLE) AS amount, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS SMALLINT) AS label FROM orders",
    "crowded": _EV.format(uid="CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE 'crowd' END"),
    "by_status": "SELECT o_orderkey AS transaction_id, o_orderstatus AS uid, o_orderdate AS event_ts, CAST(o_totalprice AS DOUBLE) AS amount, CAST(0 AS SMALLINT) AS label FROM orders",
    "lineitem": "SELECT l_orderkey AS transaction_id, CAST(l_suppkey AS VARCHAR) AS uid, l_shipdate AS event_ts, CAST(l_extendedprice AS DOUBLE) AS amount, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS SMALLINT) AS label FROM lineitem",
}


def features_sql(table: str, past: list[tuple[str, str, int]] = (), future: list[tuple[str, str, int]] = (), source: str | None = None) -> str:
    """Features by a join of every point with its entity's events and one conditional aggregate each."""
    columns = []
    for name, kind, hours in past:
        inside = f"e.event_ts >= s.event_ts - INTERVAL {hours} HOUR AND e.event_ts < s.event_ts"
        columns.append({"sum": f"ROUND(COALESCE(SUM(e.amount) FILTER (WHERE {inside}), 0), 2)", "count": f"COUNT(e.amount) FILTER (WHERE {inside})", "time_since_last": f"CAST(DATE_DIFF('second', MAX(e.event_ts) FILTER (WHERE {inside}), s.event_ts) AS DOUBLE)"}[kind] + f" AS {name}")
    for name, kind, hours in future:
        inside = f"e.event_ts > s.event_ts AND e.event_ts <= s.event_ts + INTERVAL {hours} HOUR"
        columns.append({"sum": f"ROUND(COALESCE(SUM(e.amount) FILTER (WHERE {inside}), 0), 2)", "count": f"COUNT(e.amount) FILTER (WHERE {inside})", "time_since_last": f"CAST(DATE_DIFF('second', s.event_ts, MIN(e.event_ts) FILTER (WHERE {inside})) AS DOUBLE)"}[kind] + f" AS {name}")
    return f"WITH t AS ({source or T[table]}) SELECT s.transaction_id AS label_id, s.uid, s.event_ts AS cutoff_ts, s.label, {', '.join(columns)} FROM t s LEFT JOIN t e ON e.uid = s.uid GROUP BY s.transaction_id, s.uid, s.event_ts, s.label"


FUTURE = [("future_sum_amt_24h", "sum", 24), ("future_count_txn_24h", "count", 24), ("future_sum_amt_7d", "sum", 168), ("time_to_next_txn_sec", "time_since_last", 720)]
LEAKY = SHIPPED


def _prefix_sql(table: str) -> str:
    return f"WITH t AS ({T[table]}), g AS (SELECT uid, event_ts, SUM(amount) AS a, MAX(transaction_id) AS m, COUNT(*) AS n FROM t WHERE uid IS NOT NULL GROUP BY uid, event_ts) SELECT uid, event_ts AS feature_ts, ROUND(a, 2) AS amount, m AS event_id, ROUND(SUM(a) OVER w, 2) AS cumulative_amount, CAST(SUM(n) OVER w AS BIGINT) AS cumulative_count FROM g WINDOW w AS (PARTITION BY uid ORDER BY event_ts ROWS UNBOUNDED PRECEDING)"


# ---------------------------------------------------------------- relations and features


@query(f"WITH t AS ({T['events']}) SELECT transaction_id AS label_id, uid, event_ts AS cutoff_ts, label FROM t")
def label_spine(spark, sf_dir):
    return features.spine(facts(spark, sf_dir))


@query(f"WITH t AS ({T['orders']}) SELECT uid, COUNT(*) AS n_points, MAX(event_ts) AS last_ts FROM t GROUP BY uid")
def named_spine(spark, sf_dir):
    sinks.relation(features.spine(facts(spark, sf_dir, ORDERS)), "named_spine_points")
    return spark.sql("SELECT uid, COUNT(*) AS n_points, MAX(cutoff_ts) AS last_ts FROM named_spine_points GROUP BY uid")


@query(f"WITH t AS ({T['some_null']}) SELECT uid, event_ts AS feature_ts, amount, transaction_id AS event_id FROM t WHERE uid IS NOT NULL")
def feature_events(spark, sf_dir):
    return features.history(facts(spark, sf_dir, EVENTS_SOME_NULL))


@query(_prefix_sql("lineitem"))
def feature_cumsum_lineitem(spark, sf_dir):
    return cents(features.prefix_sums(features.history(facts(spark, sf_dir, LINEITEM))))


@query(_prefix_sql("orders"))
def feature_cumsum_orders(spark, sf_dir):
    return cents(features.prefix_sums(features.history(facts(spark, sf_dir, ORDERS))))


@query(features_sql("events", SHIPPED))
def pit_features_events(spark, sf_dir):
    return cents(features.build(facts(spark, sf_dir), load_catalog()))


@query(features_sql("orders", SHIPPED))
def pit_features_orders(spark, sf_dir):
    return cents(features.build(facts(spark, sf_dir, ORDERS), load_catalog()))


@query(features_sql("some_null", SHIPPED))
def pit_features_null_uid(spark, sf_dir):
    return cents(features.build(facts(spark, sf_dir, EVENTS_SOME_NULL), load_catalog()))


@query(features_sql("events", [("sum_2h", "sum", 2), ("count_2h", "count", 2), ("since_3h", "time_since_last", 3)]))
def pit_custom_catalog_2h(spark, sf_dir):
    return cents(features.build(facts(spark, sf_dir), custom(("sum_2h", "sum", 2), ("count_2h", "count", 2), ("since_3h", "time_since_last", 3))))


@query(features_sql("some_null", SHIPPED))
def pit_prefix_strategy(spark, sf_dir):
    return cents(features.build(facts(spark, sf_dir, EVENTS_SOME_NULL), load_catalog(), "prefix"))


@query(features_sql("some_null", SHIPPED))
def pit_chunked_strategy(spark, sf_dir):
    return cents(features.build(facts(spark, sf_dir, EVENTS_SOME_NULL), load_catalog(), "chunked"))


@query(features_sql("orders", SHIPPED))
def pit_separate_spine(spark, sf_dir):
    rows = facts(spark, sf_dir, ORDERS)
    return cents(features.past_features(features.spine(rows), features.history(rows), load_catalog()))


#: When an entity is hot and how many rows a bucket of it has, low enough for the smallest tables.
SPREAD = {"hot_rows": 400, "bucket_rows": 100}


def windows_sql(table: str, past: list[tuple[str, str, int]], future: list[tuple[str, str, int]] = ()) -> str:
    """The same features by window frames, for entities of so many rows that a join would not do; no entity is null."""
    columns = []
    for rows, frame, near, sign in ((past, "INTERVAL {h} HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING", "MAX", 1), (future, "INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL {h} HOUR FOLLOWING", "MIN", -1)):
        for name, kind, hours in rows:
            over = f"OVER (PARTITION BY uid ORDER BY event_ts RANGE BETWEEN {frame.format(h=hours)})"
            ends = f"{near}(event_ts) {over}, event_ts" if sign > 0 else f"event_ts, {near}(event_ts) {over}"
            columns.append({"sum": f"ROUND(COALESCE(SUM(amount) {over}, 0), 2)", "count": f"COUNT(*) {over}", "time_since_last": f"CAST(DATE_DIFF('second', {ends}) AS DOUBLE)"}[kind] + f" AS {name}")
    return f"WITH t AS ({T[table]}) SELECT transaction_id AS label_id, uid, event_ts AS cutoff_ts, label, {', '.join(columns)} FROM t"


def _crowded(spark, sf_dir) -> DataFrame:
    """Events of which one entity has two thirds."""
    return facts(spark, sf_dir).withColumn("uid", F.when(F.col("transaction_id") % 3 == 0, F.col("uid")).otherwise("crowd"))


@query(windows_sql("crowded", SHIPPED))
def pit_hot_entity(spark, sf_dir):
    return cents(features.build(_crowded(spark, sf_dir), load_catalog(), **SPREAD))


@query(windows_sql("crowded", SHIPPED))
def pit_hot_entity_buckets(spark, sf_dir):
    return cents(features.build(_crowded(spark, sf_dir), load_catalog(), "prefix", **SPREAD))


@query(windows_sql("crowded", SHIPPED, FUTURE))
def pit_plus_future_hot_entity(spark, sf_dir):
    rows = _crowded(spark, sf_dir)
    return cents(features.combined_features(features.spine(rows), features.history(rows), load_catalog(), "prefix", **SPREAD))


@query(_prefix_sql("by_status"))
def feature_cumsum_hot(spark, sf_dir):
    return cents(features.prefix_sums(features.history(_by_status(spark, sf_dir)), **SPREAD))


def _by_status(spark, sf_dir) -> DataFrame:
    """Orders with their status as the entity: three of them."""
    return transactions(spark.read.parquet(f"{sf_dir}/orders.parquet"), Roles("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "0"))


def _single(name: str, rows: list[tuple[str, str, int]], future: bool = False) -> None:
    catalog = custom(*((n.removeprefix("future_"), k, h) for n, k, h in rows)) if future else custom(*rows)

    def run(spark, sf_dir):
        table = facts(spark, sf_dir)
        if not future:
            return cents(features.build(table, catalog))
        out = features.future_features(features.spine(table), features.history(table), catalog)
        return cents(out.withColumnsRenamed({f.name: n for f, (n, _, _) in zip(catalog.features, rows, strict=True)}))

    run.__name__ = name
    query(features_sql("events", *(([], rows) if future else (rows, []))))(run)


_single("rolling_sum_24h", [("sum_amt_24h", "sum", 24)])
_single("rolling_count_24h", [("count_txn_24h", "count", 24)])
_single("rolling_sum_7d", [("sum_amt_7d", "sum", 168)])
_single("time_since_last", [("time_since_last_txn_sec", "time_since_last", 720)])
_single("future_sum_24h", [("future_sum_amt_24h", "sum", 24)], True)
_single("future_count_24h", [("future_count_txn_24h", "count", 24)], True)
_single("future_sum_7d", [("future_sum_amt_7d", "sum", 168)], True)
_single("time_to_next", [("time_to_next_txn_sec", "time_since_last", 720)], True)


@query(features_sql("orders", [], LEAKY))
def leaky_features(spark, sf_dir):
    rows = facts(spark, sf_dir, ORDERS)
    return cents(features.future_features(features.spine(rows), features.history(rows), load_catalog()))


@query(features_sql("orders", SHIPPED, FUTURE))
def pit_plus_future(spark, sf_dir):
    rows = facts(spark, sf_dir, ORDERS)
    return cents(features.combined_features(features.spine(rows), features.history(rows), load_catalog()))


@query(features_sql("some_null", SHIPPED, FUTURE))
def pit_plus_future_prefix(spark, sf_dir):
    rows = facts(spark, sf_dir, EVENTS_SOME_NULL)
    return cents(features.combined_features(features.spine(rows), features.history(rows), load_catalog(), "prefix"))


# ---------------------------------------------------------------- as-of joins


def _asof(name: str, condition: str, pick: str, **how) -> None:
    """Orders of a customer against the customer's own running totals."""

    def run(spark, sf_dir):
        rows = facts(spark, sf_dir, ORDERS)
        left = features.spine(rows).select("label_id", "uid", "cutoff_ts", micros(F.col("cutoff_ts")).alias("us"))
        right = features.prefix_sums(features.history(rows)).withColumn("at", micros(F.col("feature_ts")))
        out = asof_join(left, right, "uid", "us", "at", ["feature_ts", "cumulative_amount", "cumulative_count"], **how)
        return cents(out.drop("us"))

    run.__name__ = name
    # the nearest instant by a correlated aggregate, then its state
    query(f"WITH t AS ({T['orders']}), p AS ({_prefix_sql('orders').replace('WITH t AS (' + T['orders'] + '), g AS', 'WITH g AS')}), n AS (SELECT s.transaction_id AS label_id, s.uid, s.event_ts AS cutoff_ts, {pick}(p.feature_ts) AS feature_ts FROM t s LEFT JOIN p ON p.uid = s.uid AND {condition} GROUP BY ALL) SELECT n.label_id, n.uid, n.cutoff_ts, n.feature_ts, p.cumulative_amount, p.cumulative_count FROM n LEFT JOIN p ON p.uid = n.uid AND p.feature_ts = n.feature_ts")(run)


def _asof_hot(name: str, condition: str, shift: int = 0, **how) -> None:
    """Orders against the running totals of their status: three keys with all rows."""

    def run(spark, sf_dir):
        rows = _by_status(spark, sf_dir)
        left = features.spine(rows).select("label_id", "uid", "cutoff_ts", micros(F.col("cutoff_ts")).alias("us"))
        right = features.prefix_sums(features.history(rows), **SPREAD).withColumn("at", micros(F.col("feature_ts")))
        return cents(asof_join(left, right, "uid", "us", "at", ["feature_ts", "cumulative_amount", "cumulative_count"], shift=shift * 3_600_000_000, **how, **SPREAD).drop("us"))

    run.__name__ = name
    sums = _prefix_sql("by_status").removeprefix(f"WITH t AS ({T['by_status']}), ").replace("g AS (", "WITH g AS (", 1)
    query(f"WITH t AS ({T['by_status']}), p AS ({sums}) SELECT s.transaction_id AS label_id, s.uid, s.event_ts AS cutoff_ts, p.feature_ts, p.cumulative_amount, p.cumulative_count FROM t s ASOF LEFT JOIN p ON p.uid = s.uid AND s.event_ts + INTERVAL ({shift}) HOUR {condition} p.feature_ts")(run)


_asof_hot("asof_hot_backward_strict", ">")
_asof_hot("asof_hot_backward_inclusive", ">=", strict=False)
_asof_hot("asof_hot_backward_shifted", ">", shift=-168)
_asof_hot("asof_hot_backward_inclusive_forward_shift", ">=", shift=720, strict=False)
_asof_hot("asof_hot_forward_strict", "<", direction="forward")
_asof("asof_backward_strict", "p.feature_ts < s.event_ts", "MAX")
_asof("asof_backward_inclusive", "p.feature_ts <= s.event_ts", "MAX", strict=False)
_asof("asof_backward_shifted", "p.feature_ts < s.event_ts - INTERVAL 168 HOUR", "MAX", shift=-168 * 3_600_000_000)
_asof("asof_backward_inclusive_forward_shift", "p.feature_ts <= s.event_ts + INTERVAL 720 HOUR", "MAX", strict=False, shift=720 * 3_600_000_000)
_asof("asof_forward_strict", "p.feature_ts > s.event_ts", "MIN", direction="forward")


# ---------------------------------------------------------------- cohorts

_B = f"WITH t AS ({T['orders']}), b AS (SELECT MIN(event_ts) + INTERVAL 720 HOUR AS s, MAX(event_ts) - INTERVAL 720 HOUR AS e, COUNT(*) AS n FROM t), c AS (SELECT t.* FROM t, b WHERE event_ts >= s AND event_ts <= e)"
_SPLIT = _B + ", q AS (SELECT MIN(event_ts) AS cut_ts FROM (SELECT event_ts, SUM(COUNT(*)) OVER (ORDER BY event_ts) AS upto FROM c GROUP BY event_ts) WHERE upto >= CEIL((SELECT COUNT(*) FROM c) * 0.8))"


@query(_B + " SELECT s AS start, e AS \"end\", n AS total_rows, (SELECT COUNT(*) FROM c) AS eligible_rows FROM b")
def observation_bounds(spark, sf_dir):
    return cohort.bounds_frame(features.spine(facts(spark, sf_dir, ORDERS)), 720)


def _study(spark, sf_dir):
    points = features.spine(facts(spark, sf_dir, ORDERS))
    bounds = cohort.observation_bounds(points, 720)
    return points, bounds


@query(_SPLIT + " SELECT cut_ts AS split_ts FROM q")
def split_timestamp(spark, sf_dir):
    points, bounds = _study(spark, sf_dir)
    return cohort.split_frame(cohort.eligible(points, bounds), 0.8)


@query(_SPLIT + " SELECT CASE WHEN event_ts < cut_ts THEN 'train' ELSE 'test' END AS part, COUNT(*) AS n_rows, CAST(SUM(label) AS BIGINT) AS n_positive, ROUND(AVG(CAST(label AS DOUBLE)), 6) AS positive_rate, MIN(event_ts) AS first_ts, MAX(event_ts) AS last_ts FROM c, q GROUP BY 1")
def temporal_split_summary(spark, sf_dir):
    points, bounds = _study(spark, sf_dir)
    return cohort.split_summary(cohort.eligible(points, bounds), cohort.split_timestamp(points, bounds))


@query(_B + ", f AS (" + features_sql("orders", WEEK, source="SELECT * FROM t").replace("WITH t AS (SELECT * FROM t) ", "") + ") SELECT f.* FROM f, b WHERE cutoff_ts >= s AND cutoff_ts <= e")
def eligible_frame(spark, sf_dir):
    rows = facts(spark, sf_dir, ORDERS)
    _, bounds = _study(spark, sf_dir)
    return cents(cohort.eligible(features.build(rows, custom(*WEEK)), bounds))


@query(f"WITH t AS ({T['events']}), p AS (SELECT uid, event_ts AS p_ts FROM t WHERE transaction_id = 100), k AS (SELECT t.*, p.p_ts, CASE WHEN event_ts < p_ts THEN 'before_cutoff' WHEN event_ts = p_ts THEN 'at_cutoff' ELSE 'after_cutoff' END AS availability FROM t, p WHERE t.uid = p.uid AND event_ts BETWEEN p_ts - INTERVAL 240 HOUR AND p_ts + INTERVAL 240 HOUR), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY availability ORDER BY event_ts, transaction_id) AS f, ROW_NUMBER() OVER (PARTITION BY availability ORDER BY event_ts DESC, transaction_id DESC) AS b FROM k) SELECT transaction_id, event_ts, amount, label, availability, ROUND((EPOCH_US(event_ts) - EPOCH_US(p_ts)) / 3.6e9, 6) AS hours_from_cutoff FROM r WHERE (availability = 'before_cutoff' AND b <= 6) OR (availability = 'at_cutoff' AND f <= 3) OR (availability = 'after_cutoff' AND f <= 6) OR transaction_id = 100")
def availability_timeline(spark, sf_dir):
    return cohort.availability_timeline(facts(spark, sf_dir), 100, hours=240)


_SAMPLE = features_sql("events", [("count_txn_24h", "count", 24)], [("future_count_txn_24h", "count", 24)])


@query(f"SELECT * FROM ({_SAMPLE}) WHERE cutoff_ts >= TIMESTAMP '2024-01-15 12:00:00' AND uid IS NOT NULL AND count_txn_24h > 0 AND future_count_txn_24h > 0 ORDER BY cutoff_ts, label_id LIMIT 1")
def first_qualifying_row(spark, sf_dir):
    both = features.combined_features(features.spine(facts(spark, sf_dir)), features.history(facts(spark, sf_dir)), custom(("count_txn_24h", "count", 24)))
    return cohort.first_qualifying(both, datetime(2024, 1, 15, 12), ["count_txn_24h", "future_count_txn_24h"])


@query(f"WITH t AS ({T['events']}) SELECT transaction_id AS label_id, uid, event_ts AS cutoff_ts, label FROM t ORDER BY MD5(CONCAT_WS(':', '42', CAST(transaction_id AS VARCHAR))), transaction_id LIMIT 100")
def hash_sample(spark, sf_dir):
    return cohort.hash_sample(features.spine(facts(spark, sf_dir)), "label_id", 100)


# ---------------------------------------------------------------- warehouse, entities, profiles

#: orders as a raw source: seconds from an origin, key columns that may be missing.
_RAW = "SELECT o_orderkey AS TransactionID, DATE_DIFF('second', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS TransactionDT, o_totalprice AS TransactionAmt, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS isFraud, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_custkey END AS card1, o_custkey % 5 AS card2, o_orderstatus AS addr1 FROM orders"


def _raw(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    seconds = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1992-01-01 00:00:00'"), F.col("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("TransactionID"), seconds.alias("TransactionDT"), F.col("o_totalprice").alias("TransactionAmt"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("isFraud"), F.when(~F.col("o_orderpriority").like("5%"), F.col("o_custkey")).alias("card1"), (F.col("o_custkey") % 5).alias("card2"), F.col("o_orderstatus").alias("addr1"))


_W = f"WITH r AS ({_RAW}), t AS (SELECT CAST(TransactionID AS BIGINT) AS transaction_id, CASE WHEN card1 IS NOT NULL AND card2 IS NOT NULL AND addr1 IS NOT NULL THEN MD5(CONCAT_WS('|', CAST(card1 AS VARCHAR), CAST(card2 AS VARCHAR), CAST(addr1 AS VARCHAR))) END AS uid, TIMESTAMP '1992-01-01 00:00:00' + TransactionDT * INTERVAL 1 SECOND AS event_ts, CAST(TransactionAmt AS DOUBLE) AS amount, CAST(isFraud AS SMALLINT) AS label FROM r)"
_COUNTS = ", c AS (SELECT uid, COUNT(*) AS n FROM t WHERE uid IS NOT NULL GROUP BY uid)"


def _warehouse(spark, sf_dir):
    return warehouse.build_transactions(_raw(spark, sf_dir), origin="1992-01-01 00:00:00")


@query(_W + " SELECT * FROM t")
def warehouse_transactions(spark, sf_dir):
    return _warehouse(spark, sf_dir)


@query(_W + _COUNTS + " SELECT COUNT(*) AS total_rows, COUNT(*) - COUNT(DISTINCT transaction_id) AS duplicate_ids, COUNT(*) FILTER (WHERE transaction_id IS NULL) AS null_ids, COUNT(*) FILTER (WHERE event_ts IS NULL OR amount IS NULL) AS null_required, COUNT(*) FILTER (WHERE label IS NULL OR label NOT IN (0, 1)) AS invalid_labels, COUNT(*) FILTER (WHERE NOT ISFINITE(amount)) AS non_finite_amounts, COUNT(*) FILTER (WHERE uid = '') AS empty_uids, (SELECT COUNT(*) FROM c) AS n_entities, (SELECT COUNT(*) FROM c WHERE n >= 2) AS repeated_entities FROM t")
def warehouse_gates(spark, sf_dir):
    return warehouse.gates(_warehouse(spark, sf_dir))


@query(_W + " SELECT COUNT(*) AS total_rows, COUNT(DISTINCT transaction_id) AS distinct_ids, COUNT(uid) AS rows_with_uid, ROUND(100.0 * COUNT(uid) / COUNT(*), 2) AS uid_coverage_pct, ROUND(100.0 * AVG(label), 4) AS label_rate_pct, MIN(event_ts) AS min_event_ts, MAX(event_ts) AS max_event_ts FROM t")
def warehouse_profile(spark, sf_dir):
    return warehouse.profile(_warehouse(spark, sf_dir))


_REPEAT = "COUNT(*) AS n_entities, ROUND(CAST(100.0 AS DOUBLE) * COUNT(*) FILTER (WHERE n >= 2) / NULLIF(COUNT(*), 0), 2) AS repeat_entity_pct, ROUND(CAST(100.0 AS DOUBLE) * SUM(n) FILTER (WHERE n >= 2) / NULLIF(SUM(n), 0), 2) AS repeat_row_pct, CAST(MEDIAN(n) AS DOUBLE) AS median_per_entity, CAST(QUANTILE_CONT(n, 0.95) AS DOUBLE) AS p95_per_entity, MAX(n) AS max_per_entity"


@query(_W + _COUNTS + f" SELECT {_REPEAT} FROM c")
def entity_profile(spark, sf_dir):
    return warehouse.entity_profile(_warehouse(spark, sf_dir))


_CANDIDATES = (entity.Candidate("nation_segment", ("c_nationkey", "c_mktsegment")), entity.Candidate("nation_segment_customer", ("c_nationkey", "c_mktsegment", "c_custkey")))


def _candidate_sql(x: entity.Candidate) -> str:
    key = ", ".join(f"CAST({c} AS VARCHAR)" for c in x.columns)
    return f"SELECT '{x.name}' AS candidate, '{' + '.join(x.columns)}' AS columns, (SELECT COUNT(*) FROM j) AS total_rows, CAST(SUM(n) AS BIGINT) AS rows_with_uid, ROUND(CAST(100.0 AS DOUBLE) * SUM(n) / (SELECT COUNT(*) FROM j), 2) AS coverage_pct, {_REPEAT} FROM (SELECT MD5(CONCAT_WS('|', {key})) AS uid, COUNT(*) AS n FROM j GROUP BY 1)"


@query("WITH j AS (SELECT c.c_nationkey, c.c_mktsegment, c.c_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) " + " UNION ALL ".join(map(_candidate_sql, _CANDIDATES)))
def entity_candidates(spark, sf_dir):
    joined = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    return entity.ranked(entity.candidate_metrics(joined, _CANDIDATES))


def _stat_sql(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    q = ", ".join(f"ROUND(QUANTILE_CONT({v}, {p}), 4) AS {n}" for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))
    return f"SELECT '{c}' AS column_name, CAST(COUNT({c}) AS DOUBLE) AS n, ROUND(AVG({v}), 4) AS mean, ROUND(STDDEV_SAMP({v}), 4) AS stddev, ROUND(MIN({v}), 4) AS min_value, {q}, ROUND(MAX({v}), 4) AS max_value FROM lineitem"


@query(" UNION ALL ".join(map(_stat_sql, ("l_quantity", "l_extendedprice", "l_discount"))))
def profile_stats(spark, sf_dir):
    return profiling.numeric_profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(_W + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_missing, ROUND(CAST(100.0 AS DOUBLE) * (COUNT(*) - COUNT({c})) / COUNT(*), 4) AS missing_pct FROM t" for c in ("transaction_id", "uid", "event_ts", "amount")))
def missing_stats(spark, sf_dir):
    return profiling.missing_profile(_warehouse(spark, sf_dir), ["transaction_id", "uid", "event_ts", "amount"])


@query("SELECT COUNT(*) AS n_rows, COUNT(DISTINCT l_orderkey) AS n_distinct, COUNT(*) - COUNT(l_orderkey) AS n_null, COUNT(l_orderkey) - COUNT(DISTINCT l_orderkey) AS n_duplicate FROM lineitem")
def id_quality(spark, sf_dir):
    return profiling.id_quality(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey")


@query(f"WITH t AS ({T['events']}), q AS (SELECT QUANTILE_CONT(amount, 0.25) AS a, QUANTILE_CONT(amount, 0.75) AS b FROM t) SELECT ROUND(a, 4) AS p25, ROUND(b, 4) AS p75, ROUND(b + 1.5 * (b - a), 4) AS fence, COUNT(*) FILTER (WHERE amount > b + 1.5 * (b - a)) AS n_high, COUNT(*) FILTER (WHERE amount <= 0) AS n_not_positive, COUNT(amount) AS n_values FROM t, q GROUP BY a, b")
def amount_outliers(spark, sf_dir):
    return profiling.outliers(facts(spark, sf_dir), "amount")


@query(f"WITH t AS ({T['orders']}) SELECT CAST(label AS INTEGER) AS label, CASE label WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'other' END AS label_name, COUNT(*) AS n_rows, ROUND(CAST(100.0 AS DOUBLE) * COUNT(*) / SUM(COUNT(*)) OVER (), 4) AS share_pct FROM t GROUP BY label")
def label_distribution(spark, sf_dir):
    return profiling.label_distribution(facts(spark, sf_dir, ORDERS))


@query(f"WITH t AS ({T['orders']}) SELECT ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT CAST(label AS VARCHAR))), ',') AS domain, COUNT(*) FILTER (WHERE label NOT IN (0, 1)) AS n_other FROM t")
def label_domain(spark, sf_dir):
    return profiling.domain(facts(spark, sf_dir, ORDERS), "label")


@query(f"WITH t AS ({T['events']}) SELECT CAST(DATE_TRUNC('day', event_ts) AS TIMESTAMP) AS day, COUNT(*) AS n_rows, ROUND(AVG(CAST(label AS DOUBLE)) * 100, 4) AS label_rate_pct FROM t GROUP BY 1")
def daily_activity(spark, sf_dir):
    return profiling.daily_activity(facts(spark, sf_dir))


@query(f"WITH t AS ({T['events']}) SELECT *, ROUND(LN(1 + GREATEST(amount, 0.0)), 6) AS log_amount FROM t WHERE transaction_id % 20 = 0")
def modulo_sample(spark, sf_dir):
    return profiling.modulo_sample(facts(spark, sf_dir), "transaction_id")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL AND c_mktsegment IS NOT NULL THEN MD5(CONCAT_WS('|', CAST(c_custkey AS VARCHAR), c_mktsegment)) END AS uid, TIMESTAMP '2017-12-01 00:00:00' + CAST(o_orderkey AS BIGINT) * INTERVAL 1 SECOND AS event_ts, o_custkey IS DISTINCT FROM c_custkey AS differs FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def verify_against_source(spark, sf_dir):
    joined = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", entity_key(["c_custkey", "c_mktsegment"]).alias("uid"), shifted(F.col("o_orderkey")).alias("event_ts"), (~F.col("o_custkey").eqNullSafe(F.col("c_custkey"))).alias("differs"))


# ---------------------------------------------------------------- backfill, online, parity

_DAYS = (date(1995, 3, 1), date(1995, 5, 31))


@query(f"SELECT * FROM ({features_sql('orders', SHIPPED)}) WHERE cutoff_ts >= TIMESTAMP '{_DAYS[0]}' AND cutoff_ts < TIMESTAMP '{_DAYS[1]}' + INTERVAL 1 DAY")
def backfill_slice(spark, sf_dir):
    return cents(backfill.requested(facts(spark, sf_dir, ORDERS), *_DAYS, load_catalog()))


def _late(rows: DataFrame) -> Column:
    """Facts of one day that came after the store was built."""
    return (F.to_date("event_ts") == F.lit("2024-01-20").cast("date")) & (F.col("transaction_id") % 3 == 0)


@query(features_sql("some_null", SHIPPED))
def backfill_refreshed(spark, sf_dir):
    rows, root, catalog = facts(spark, sf_dir, EVENTS_SOME_NULL), f"{_written(spark)}/days", load_catalog()
    backfill.write_days(features.build(rows.filter(~_late(rows)), catalog), root)
    backfill.refresh(rows, rows.filter(_late(rows)), root, catalog)
    return cents(spark.read.parquet(root).drop("day"))


@query(f"WITH t AS ({T['orders']}), m AS (SELECT MD5(CONCAT_WS('|', transaction_id, uid, EPOCH_US(event_ts), CAST(ROUND(amount * 100) AS BIGINT), label)) AS h FROM t) SELECT COUNT(*) AS n_rows, CAST(SUM(CAST(CAST('0x' || SUBSTR(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS low_sum, CAST(SUM(CAST(CAST('0x' || SUBSTR(h, 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS high_sum FROM m")
def facts_fingerprint(spark, sf_dir):
    rows = facts(spark, sf_dir, ORDERS)
    return cohort.fingerprint(rows.select("transaction_id", "uid", micros(F.col("event_ts")), F.round(F.col("amount") * 100).cast("long"), "label"))


def _stream(spark, sf_dir) -> DataFrame:
    rows = facts(spark, sf_dir, EVENTS_SOME_NULL)
    return rows.select("transaction_id", "uid", micros(F.col("event_ts")).alias("us"), "amount")


_REPLAY = features_sql("some_null", SHIPPED)


@query(f"SELECT * EXCLUDE (label) FROM ({_REPLAY}) WHERE uid IS NOT NULL")
def replay_features(spark, sf_dir):
    return cents(online.replay_features(_stream(spark, sf_dir), load_catalog()))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset, a local master gets a temporary one; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="online-")
    return root


def _store(spark: SparkSession) -> online.OnlineStore:
    root = online.new_root(shared_folder(spark))
    fs, p = sinks._fs(spark, root)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return online.OnlineStore(spark, root)


def _replayed(spark, sf_dir) -> online.OnlineStore:
    store = _store(spark)
    store.replay(_stream(spark, sf_dir))
    return store


@query(f"WITH t AS ({T['some_null']}) SELECT uid, CAST(transaction_id AS VARCHAR) AS transaction_id, amount, event_ts FROM t WHERE uid IS NOT NULL")
def online_state(spark, sf_dir):
    return _replayed(spark, sf_dir).state().select("uid", "transaction_id", "amount", from_micros(F.col("us")).alias("event_ts"))


_AT = "2024-01-15 12:00:00"


def _as_of_sql() -> str:
    return f"WITH t AS ({T['some_null']}), u AS (SELECT DISTINCT uid FROM t WHERE uid IS NOT NULL) SELECT u.uid, TIMESTAMP '{_AT}' AS as_of, ROUND(COALESCE(SUM(amount) FILTER (WHERE event_ts >= TIMESTAMP '{_AT}' - INTERVAL 24 HOUR), 0), 2) AS sum_amt_24h, COUNT(amount) FILTER (WHERE event_ts >= TIMESTAMP '{_AT}' - INTERVAL 24 HOUR) AS count_txn_24h, ROUND(COALESCE(SUM(amount) FILTER (WHERE event_ts >= TIMESTAMP '{_AT}' - INTERVAL 168 HOUR), 0), 2) AS sum_amt_7d, CAST(DATE_DIFF('second', MAX(event_ts) FILTER (WHERE event_ts >= TIMESTAMP '{_AT}' - INTERVAL 720 HOUR), TIMESTAMP '{_AT}') AS DOUBLE) AS time_since_last_txn_sec FROM u LEFT JOIN t ON t.uid = u.uid AND event_ts < TIMESTAMP '{_AT}' GROUP BY u.uid"


@query(_as_of_sql())
def online_lookup_as_of(spark, sf_dir):
    store = _replayed(spark, sf_dir)
    return cents(store.features_as_of(store.state().select("uid").distinct(), _AT))


@query(f"SELECT f.feature_name, COUNT(*) AS n_compared, CAST(0 AS BIGINT) AS n_mismatch FROM ({T['some_null']}) t, (VALUES ('sum_amt_24h'), ('count_txn_24h'), ('sum_amt_7d'), ('time_since_last_txn_sec')) f(feature_name) WHERE uid IS NOT NULL GROUP BY 1")
def parity_report(spark, sf_dir):
    catalog = load_catalog()
    offline = features.build(facts(spark, sf_dir, EVENTS_SOME_NULL), catalog).filter("uid is not null")
    served = _replayed(spark, sf_dir).features_at(offline.select("label_id", "uid", "cutoff_ts"), catalog)
    rows = parity.compared(offline, served, catalog.names)
    return rows.groupBy("feature_name").agg(F.count("*").alias("n_compared"), F.count("reason").alias("n_mismatch"))


def _written(spark) -> str:
    root = online.new_root(shared_folder(spark))
    fs, p = sinks._fs(spark, root)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return root


@query(f"WITH t AS ({T['orders']}) SELECT transaction_id, uid, event_ts, amount, label FROM t")
def facts_published_and_read(spark, sf_dir):
    place = f"{_written(spark)}/facts"
    sinks.write_facts(facts(spark, sf_dir, ORDERS), place)
    return readers.read_facts(spark, place)


@query(f"WITH t AS ({T['orders']}) SELECT transaction_id, uid, event_ts, amount, label FROM t")
def facts_versioned_and_read(spark, sf_dir):
    rows, table = facts(spark, sf_dir, ORDERS), Versions(spark, f"{_written(spark)}/facts")
    table.publish(rows.filter("label = 0"))
    table.publish(rows)
    table.expire(keep=1)
    return table.read()


@query("SELECT CAST(o_orderkey AS BIGINT) AS TransactionID, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS INTEGER) AS isFraud, CAST(DATE_DIFF('second', TIMESTAMP '1992-01-01 00:00:00', o_orderdate) AS BIGINT) AS TransactionDT, CAST(o_totalprice AS DOUBLE) AS TransactionAmt, o_orderstatus AS kind FROM orders")
def csv_written_and_read(spark, sf_dir):
    place = f"{_written(spark)}/raw.csv"
    _raw(spark, sf_dir).select("TransactionID", "isFraud", "TransactionDT", "TransactionAmt", F.col("addr1").alias("kind")).write.option("header", True).csv(place)
    return readers.read_csv(spark, place, ["TransactionID", "isFraud"])


@query(f"SELECT * FROM ({features_sql('orders', SHIPPED)}) WHERE cutoff_ts >= TIMESTAMP '{_DAYS[0]}' AND cutoff_ts < TIMESTAMP '{_DAYS[1]}' + INTERVAL 1 DAY")
def backfill_published_and_read(spark, sf_dir):
    with tempfile.TemporaryDirectory() as logs:  # the driver's log only
        done = backfill.run(facts(spark, sf_dir, ORDERS), *_DAYS, output_root=_written(spark), log_path=f"{logs}/runs.jsonl")
    return cents(spark.read.parquet(done.output_path))


@query(f"WITH t AS ({T['some_null']}) SELECT COUNT(*) AS total_rows, COUNT(uid) AS ingested_events, ROUND(EPOCH_US(MAX(event_ts)) / 1e6, 6) AS last_event_epoch FROM t")
def replay_result(spark, sf_dir):
    got = _store(spark).replay(_stream(spark, sf_dir))
    return spark.createDataFrame([(got.total_rows, got.ingested_events, got.last_event_epoch)], "total_rows long, ingested_events long, last_event_epoch double").withColumn("last_event_epoch", F.round("last_event_epoch", 6))


# ---------------------------------------------------------------- metrics: the rolling count scores the label

_S = f"WITH f AS ({features_sql('events', [('count_txn_24h', 'count', 24)])}), s AS (SELECT CAST(count_txn_24h AS DOUBLE) AS score, CAST(label AS INTEGER) AS label FROM f), g AS (SELECT score, SUM(label) AS p, SUM(1 - label) AS q FROM s GROUP BY score), a AS (SELECT SUM(p) AS np, SUM(q) AS nq FROM g), c AS (SELECT x.score, x.p, (SELECT SUM(p) FROM g WHERE g.score >= x.score) AS tp, (SELECT SUM(q) FROM g WHERE g.score >= x.score) AS fp FROM g x)"


def _scored(spark, sf_dir) -> DataFrame:
    return features.build(facts(spark, sf_dir), custom(("count_txn_24h", "count", 24))).select(F.col("count_txn_24h").cast("double").alias("score"), "label")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.round(c, 8).alias(c) if c in names or not names else F.col(c) for c in df.columns))


@query(_S + " SELECT ROUND(SUM(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END * a.p * b.q)::DOUBLE / (ANY_VALUE(np)::DOUBLE * ANY_VALUE(nq)), 8) AS roc_auc FROM g a, g b, a AS t".replace("FROM g a, g b, a AS t", "FROM g a CROSS JOIN g b CROSS JOIN (SELECT * FROM a) t"))
def roc_auc(spark, sf_dir):
    return _rounded(metrics.roc_auc(_scored(spark, sf_dir), "score"))


@query(_S + " SELECT ROUND(SUM(p::DOUBLE / np * tp / (tp + fp)), 8) AS average_precision FROM c, a")
def average_precision(spark, sf_dir):
    return _rounded(metrics.average_precision(_scored(spark, sf_dir), "score"))


@query(_S + " SELECT score AS threshold, ROUND(fp::DOUBLE / nq, 8) AS fpr, ROUND(tp::DOUBLE / np, 8) AS tpr FROM c, a")
def roc_curve(spark, sf_dir):
    return _rounded(metrics.roc_curve(_scored(spark, sf_dir), "score"), "fpr", "tpr")


@query(_S + " SELECT score AS threshold, ROUND(tp::DOUBLE / (tp + fp), 8) AS precision, ROUND(tp::DOUBLE / np, 8) AS recall FROM c, a")
def pr_curve(spark, sf_dir):
    return _rounded(metrics.pr_curve(_scored(spark, sf_dir), "score"), "precision", "recall")


@query(_S + " SELECT ROUND(SUM(p::DOUBLE / np * tp / (tp + fp)), 8) AS average_precision, ROUND(ANY_VALUE(np)::DOUBLE / (ANY_VALUE(np) + ANY_VALUE(nq)), 8) AS prevalence, ROUND(SUM(p::DOUBLE / np * tp / (tp + fp)) / (ANY_VALUE(np)::DOUBLE / (ANY_VALUE(np) + ANY_VALUE(nq))), 8) AS lift FROM c, a")
def metric_lift(spark, sf_dir):
    return _rounded(metrics.metric_lift(_scored(spark, sf_dir), "score"))


@query(f"WITH t AS ({T['events']}) SELECT ROUND((SELECT AVG(CAST(label AS DOUBLE)) FROM t WHERE event_ts < TIMESTAMP '{_AT}'), 8) AS score, CAST(0.5 AS DOUBLE) AS roc_auc, ROUND(AVG(CAST(label AS DOUBLE)), 8) AS average_precision FROM t WHERE event_ts >= TIMESTAMP '{_AT}'")
def prior_baseline(spark, sf_dir):
    rows = facts(spark, sf_dir)
    at = F.lit(_AT).cast("timestamp_ntz")
    return _rounded(metrics.prior_baseline(rows.filter(F.col("event_ts") < at), rows.filter(F.col("event_ts") >= at)))


def _pair(spark, sf_dir) -> DataFrame:
    built = cents(features.build(facts(spark, sf_dir), custom(("count_txn_24h", "count", 24), ("sum_amt_7d", "sum", 168))))
    return built.select("label_id", F.col("count_txn_24h").cast("double").alias("a"), F.col("sum_amt_7d").alias("b"), "label")


def _sum_of_both(x):
    return x["a"] + x["b"]


def _shuffles_sql(repeats: int, column: str) -> str:
    """m: roc_auc and average_precision of a + b with a column dealt to other rows, for each repeat r, by the same keyed permutation of places."""
    score = {"a": "g.v + p.b", "b": "p.a + g.v"}[column]
    mask, one, two = "CAST(4294967295 AS HUGEINT)", *metrics.MIX
    # a query in a query for each step: an alias used in its own query is written out again wherever it stands
    steps, left, right = "(SELECT *, x // half AS l0, x % half AS r0 FROM {})", "l0", "r0"
    for j in range(4):
        x = f"x{j}"
        for made in (f"XOR({right}, k{j}) AS {x}0", f"(XOR({x}0, {x}0 >> 16) * {one}) & {mask} AS {x}1", f"(XOR({x}1, {x}1 >> 13) * {two}) & {mask} AS {x}2", f"XOR({left}, XOR({x}2, {x}2 >> 16) & (half - 1)) AS r{j + 1}"):
            steps = f"(SELECT *, {made} FROM {steps})"
        left, right = right, f"r{j + 1}"
    steps = f"SELECT r, i, n, half, k0, k1, k2, k3, {left} * half + {right} AS x FROM {steps}"
    keys = ", ".join(f"({r}, {', '.join(map(str, metrics.round_keys(42 + r)))})" for r in range(repeats))
    return (
        f"b{column} AS (SELECT r, p.i - 1 AS i, n, CAST(1 AS HUGEINT) << GREATEST(1, (LENGTH(BIN(n - 1)) + 1) // 2) AS half, k0, k1, k2, k3, CAST(p.i - 1 AS HUGEINT) AS x FROM p, (SELECT COUNT(*) AS n FROM p), (VALUES {keys}) k(r, k0, k1, k2, k3)), "
        f"w{column} AS ({steps.format(f'b{column}')} UNION ALL {steps.format(f'w{column} WHERE x >= n')}), "
        f"g{column} AS (SELECT r, w.i + 1 AS i, q.{column} AS v FROM w{column} w JOIN p q ON q.i = w.x + 1 WHERE w.x < w.n), "
        f"s{column} AS (SELECT g.r, {score} AS score, SUM(p.label)::DOUBLE AS pos, SUM(1 - p.label)::DOUBLE AS neg FROM p JOIN g{column} g USING (i) GROUP BY 1, 2), "
        f"c{column} AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY r) AS np, SUM(neg) OVER (PARTITION BY r) AS nq FROM s{column} WINDOW w AS (PARTITION BY r ORDER BY score DESC)), "
        f"m{column} AS (SELECT CAST(r AS INTEGER) AS r, SUM(pos * (nq - fp + neg / 2)) / (ANY_VALUE(np) * ANY_VALUE(nq)) AS auc, SUM(pos / np * tp / (tp + fp)) AS ap FROM c{column} GROUP BY r)"
    )


_P = f"WITH f AS ({features_sql('events', [('count_txn_24h', 'count', 24), ('sum_amt_7d', 'sum', 168)])}), p AS (SELECT label_id, CAST(count_txn_24h AS DOUBLE) AS a, sum_amt_7d AS b, CAST(label AS INTEGER) AS label, ROW_NUMBER() OVER (ORDER BY label_id) AS i FROM f)"


def _resampled_sql(column: str) -> str:
    """m: roc_auc and average_precision of a column in every resample r, from the weights in w."""
    return (
        f"s{column} AS (SELECT r, {column} AS score, SUM(n * label)::DOUBLE AS pos, SUM(n * (1 - label))::DOUBLE AS neg FROM w GROUP BY ALL), "
        f"c{column} AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY r) AS np, SUM(neg) OVER (PARTITION BY r) AS nq FROM s{column} WHERE pos + neg > 0 WINDOW w AS (PARTITION BY r ORDER BY score DESC)), "
        f"m{column} AS (SELECT r, SUM(pos * (nq - fp + neg / 2)) / (ANY_VALUE(np) * ANY_VALUE(nq)) AS auc, SUM(pos / np * tp / (tp + fp)) AS ap FROM c{column} GROUP BY r)"
    )


def _bootstrap_sql(replicates: int = 500, seed: int = 42) -> str:
    """Weights by the same integer hash; replicate -1 has every row once."""
    mask, one, two = "CAST(4294967295 AS HUGEINT)", *metrics.MIX
    part = lambda at: f"CAST('0x' || SUBSTR(MD5('{seed}:' || label_id), {at}, 8) AS HUGEINT)"
    mixed = lambda x, i: f"(XOR({x}, {x} >> 16) * {one}) & {mask} AS {i}1, (XOR({i}1, {i}1 >> 13) * {two}) & {mask} AS {i}2, XOR({i}2, {i}2 >> 16) AS {i}3"
    reached = " + ".join(f"(y3 >= {min(t, 2**32 - 1)})::INT" for t in metrics.POISSON)
    weights = f"x AS (SELECT r, a, b, label, XOR({part(1)}, ((r + 1) * CAST({metrics.STEP} AS HUGEINT)) & {mask}) AS x0, {mixed('x0', 'x')}, XOR(x3, {part(9)}) AS y0, {mixed('y0', 'y')} FROM p, RANGE({replicates}) s(r)), w AS (SELECT r, a, b, label, {reached} AS n FROM x UNION ALL SELECT -1, a, b, label, 1 FROM p)"
    rows = ", ".join(f"('{name}', '{column}')" for name, column in (("roc_auc", "auc"), ("average_precision", "ap")))
    gain = "CASE v.metric WHEN 'roc_auc' THEN mb.auc - ma.auc ELSE mb.ap - ma.ap END"
    return f"{_P}, {weights}, {_resampled_sql('a')}, {_resampled_sql('b')}, g AS (SELECT v.metric, r, {gain} AS gain FROM ma JOIN mb USING (r), (VALUES {rows}) v(metric, of)) SELECT metric, ROUND(MAX(gain) FILTER (WHERE r = -1), 8) AS delta, ROUND(QUANTILE_CONT(gain, 0.025) FILTER (WHERE r >= 0), 8) AS low, ROUND(QUANTILE_CONT(gain, 0.975) FILTER (WHERE r >= 0), 8) AS high, COUNT(*) FILTER (WHERE r >= 0) AS n_valid FROM g GROUP BY metric"


@query(_bootstrap_sql())
def paired_bootstrap(spark, sf_dir):
    return _rounded(metrics.paired_bootstrap(_pair(spark, sf_dir), "a", "b", "label_id"), "delta", "low", "high")


@query(f"{_P.replace('WITH', 'WITH RECURSIVE', 1)}, {_shuffles_sql(50, 'b')} SELECT r AS repeat, ROUND(auc, 8) AS roc_auc, ROUND(ap, 8) AS average_precision FROM mb")
def block_shuffle(spark, sf_dir):
    return _rounded(metrics.block_shuffle_study(_pair(spark, sf_dir), _sum_of_both, ["b"], "label_id"), "roc_auc", "average_precision")


_BASE = "z AS (SELECT a + b AS score, SUM(label)::DOUBLE AS pos, SUM(1 - label)::DOUBLE AS neg FROM p GROUP BY 1), y AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER () AS np FROM z WINDOW w AS (ORDER BY score DESC)), base AS (SELECT SUM(pos / np * tp / (tp + fp)) AS ap FROM y)"


@query(f"{_P.replace('WITH', 'WITH RECURSIVE', 1)}, {_BASE}, {_shuffles_sql(10, 'a')}, {_shuffles_sql(10, 'b')} SELECT 'a' AS feature, ROUND((SELECT ap FROM base) - AVG(ap), 8) AS importance, ROUND(STDDEV_SAMP(ap), 8) AS deviation FROM ma UNION ALL SELECT 'b', ROUND((SELECT ap FROM base) - AVG(ap), 8), ROUND(STDDEV_SAMP(ap), 8) FROM mb")
def permutation_importance(spark, sf_dir):
    return _rounded(metrics.permutation_importance(_pair(spark, sf_dir), _sum_of_both, ["a", "b"], "label_id"), "importance", "deviation")


@query()
def boosted_trees(spark, sf_dir):
    rows = features.build(facts(spark, sf_dir), custom(*WEEK))
    at = F.lit(_AT).cast("timestamp_ntz")
    scored, _ = metrics.boosted_trees(rows.filter(F.col("cutoff_ts") < at), rows.filter(F.col("cutoff_ts") >= at), [n for n, _, _ in WEEK])
    return scored


# ---------------------------------------------------------------- extensions


@query(f"WITH t AS ({T['events']}) SELECT uid, MAX(event_ts) AS last_ts, ROUND((EPOCH_US((SELECT MAX(event_ts) FROM t)) - EPOCH_US(MAX(event_ts))) / 1e6, 6) AS age_sec FROM t WHERE uid IS NOT NULL GROUP BY uid")
def freshness(spark, sf_dir):
    return monitoring.freshness(facts(spark, sf_dir))


_EDGES = [10.0, 50.0, 100.0, 1000.0]
_BIN = "CASE WHEN amount IS NULL THEN -1 ELSE " + " + ".join(f"(amount > {e})::INT" for e in _EDGES) + " END"


@query(f"WITH t AS ({T['events']}), n AS (SELECT COUNT(*) FILTER (WHERE event_ts < TIMESTAMP '{_AT}') AS te, COUNT(*) FILTER (WHERE event_ts >= TIMESTAMP '{_AT}') AS ta FROM t), b AS (SELECT CAST(r AS INTEGER) AS bin FROM RANGE(-1, {len(_EDGES) + 1}) x(r)), s AS (SELECT b.bin, GREATEST(COUNT(*) FILTER (WHERE event_ts < TIMESTAMP '{_AT}')::DOUBLE / ANY_VALUE(te), 1e-6) AS e, GREATEST(COUNT(*) FILTER (WHERE event_ts >= TIMESTAMP '{_AT}')::DOUBLE / ANY_VALUE(ta), 1e-6) AS a FROM b CROSS JOIN n LEFT JOIN t ON {_BIN} = b.bin GROUP BY b.bin) SELECT bin, ROUND(e, 8) AS expected_share, ROUND(a, 8) AS actual_share, ROUND((a - e) * LN(a / e), 8) AS psi FROM s")
def stability_index(spark, sf_dir):
    rows = facts(spark, sf_dir)
    at = F.lit(_AT).cast("timestamp_ntz")
    return _rounded(monitoring.stability(rows.filter(F.col("event_ts") < at), rows.filter(F.col("event_ts") >= at), "amount", _EDGES), "expected_share", "actual_share", "psi")
