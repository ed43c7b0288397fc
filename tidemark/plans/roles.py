"""Which columns of a table play the parts of a transaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT = ("transaction_id", "uid", "event_ts", "amount", "label")


@dataclass(frozen=True)
class Roles:
    """Expressions (SQL text) for each part."""

    transaction_id: str
    uid: str
    event_ts: str
    amount: str
    label: str

    def columns(self) -> list[Column]:
        kinds = ("bigint", "string", "timestamp_ntz", "double", "smallint")
        return [F.expr(getattr(self, name)).cast(kind).alias(name) for name, kind in zip(FACT, kinds, strict=True)]


EVENTS = Roles("event_id", "user_id", "ts", "value", "if(event_type = 'error', 1, 0)")
ORDERS = Roles("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "if(o_orderstatus = 'F', 1, 0)")
LINEITEM = Roles("l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "if(l_returnflag = 'R', 1, 0)")
#: events with entities missing, as in real data.
EVENTS_SOME_NULL = Roles("event_id", "if(event_type = 'signup', null, user_id)", "ts", "value", "if(event_type = 'error', 1, 0)")


def transactions(df: DataFrame, roles: Roles) -> DataFrame:
    """transaction_id, uid, event_ts, amount, label."""
    return df.select(*roles.columns())
