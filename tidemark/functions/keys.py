"""Entity keys, names and comparisons of values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_key(columns: Sequence[str | Column]) -> Column:
    """md5 of the columns' texts joined by |; null as soon as one of them is null."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    complete = parts[0].isNotNull()
    for p in parts[1:]:
        complete = complete & p.isNotNull()
    return F.when(complete, F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """All names must be there; more may be."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def safe_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def missing_as_null(value: Column) -> Column:
    """NaN counts as missing."""
    return F.when(F.isnan(value.cast("double")), None).otherwise(value)


def values_equal(a: Column, b: Column, rel_tol: float = 1e-9, abs_tol: float = 1e-9) -> Column:
    """True if both are missing, or both are there and |a - b| <= max(rel * max(|a|, |b|), abs)."""
    x, y = missing_as_null(a).cast("double"), missing_as_null(b).cast("double")
    near = F.abs(x - y) <= F.greatest(F.lit(rel_tol) * F.greatest(F.abs(x), F.abs(y)), F.lit(abs_tol))
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), False).otherwise((x == y) | (finite & near))
