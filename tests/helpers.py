"""Fact tables for tests and a plain-Python account of the features."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from tidemark.sources.readers import FACT_SCHEMA

START = datetime(2023, 8, 17, 6, 30)


def facts(spark, rows):
    """rows: (id, uid, event_ts, amount[, label])."""
    return spark.createDataFrame([(i, u, t, float(a), *(rest or [0])) for i, u, t, a, *rest in rows], FACT_SCHEMA)


def hours(h):
    return START + timedelta(hours=h)


def second(t):
    return math.floor((t - datetime(1970, 1, 1)) / timedelta(seconds=1))


def brute(rows, catalog, future=False):
    out = {}
    for i, u, t, *_ in rows:
        values = []
        for f in catalog.features:
            w = timedelta(hours=f.window_hours)
            seen = [(s, a) for _, v, s, a, *_ in rows if u is not None and v == u and ((t < s <= t + w) if future else (t - w <= s < t))]
            if f.aggregation == "sum":
                values.append(float(sum(a for _, a in seen)))
            elif f.aggregation == "count":
                values.append(len(seen))
            elif not seen:
                values.append(None)
            else:
                values.append(float(second(min(s for s, _ in seen)) - second(t) if future else second(t) - second(max(s for s, _ in seen))))
        out[i] = values
    return out


def values(df, names):
    return {r["label_id"]: [r[n] for n in names] for r in df.collect()}


def close(a, b):
    return a.keys() == b.keys() and all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for k in a for x, y in zip(a[k], b[k], strict=True))
