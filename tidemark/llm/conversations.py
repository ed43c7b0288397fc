"""Repair of conversations by error-correcting Earley parsing.

A role grammar says which sequences of turns are a conversation. Beside its own rules it has error productions: a turn may
be deleted or get another role, and an empty turn of some role may be inserted, each at a price. The Earley chart has a
column for each turn; an item (rule and place in it) keeps the least (cost, audit) with which it is reached, the audit being
the edits' initials so far; the completed chart yields the repair. Of two audits of one cost in one column neither
begins with the other, as both took the same turns and an insertion costs something, so what is least stays least
whatever follows.

The grammar is left-linear, so every item begins with the conversation, a column holds a handful of items, and a chart can
be carried on: turns are dealt by range, in order, to stretches of at most STRETCH, each parsed by itself from
every item that may come in, and what that costs is put together along the conversation. So a conversation of many
turns is parsed by many tasks, and only its columns at the ends of stretches meet in one.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .scratch import Scratch, small_batches

#: Turns parsed at a time.
STRETCH = 1024
NONE, BLANK, DUPLICATE, TRUNCATED = "0", "1", "2", "3"
_SPACES = " \t\n\x0b\x0c\r"

#: (cost, audit, initials of the roles that come out)
Value = tuple[int, str, str]
#: (rule, symbols of it that are done)
Item = tuple[int, int]


@dataclass(frozen=True)
class RoleGrammar:
    """Rules of each symbol, the first one's being the conversation's; other symbols are role initials.

    ``made`` has the roles that reroling and insertion may give, by initial. A rule may begin with a symbol that has rules;
    all that follows is role initials (left-linear).
    """

    rules: tuple[tuple[str, tuple[str, ...]], ...]
    made: Mapping[str, str]
    delete: int = 4
    rerole: int = 3
    insert: int = 3
    truncated: int = 3  # for a truncated turn that is not deleted
    legal: frozenset[str] = frozenset()
    waiting: dict[str, list[Item]] = field(init=False, compare=False, hash=False)

    def __post_init__(self) -> None:
        if min(self.delete, self.rerole, self.insert) <= 0 or self.truncated < 0:
            raise ValueError("edits cost something")
        heads = {head for head, _ in self.rules}
        if any(x in heads for _, body in self.rules for x in body[1:]) or any(len(x) != 1 for _, body in self.rules for x in body if x not in heads):
            raise ValueError("after a rule's first symbol there are role initials only")
        waiting: dict[str, list[Item]] = {}
        for i, (_, body) in enumerate(self.rules):
            if body and body[0] in heads:
                waiting.setdefault(body[0], []).append((i, 0))
        object.__setattr__(self, "waiting", waiting)

    @property
    def start(self) -> str:
        return self.rules[0][0]

    @property
    def initials(self) -> frozenset[str]:
        heads = {head for head, _ in self.rules}
        return frozenset(x for _, body in self.rules for x in body if x not in heads)

    def wanted(self, item: Item) -> str | None:
        """The role initial that an item waits for."""
        _, body = self.rules[item[0]]
        return body[item[1]] if item[1] < len(body) and body[item[1]] in self.initials else None

    def done(self, item: Item) -> bool:
        return item[1] == len(self.rules[item[0]][1])

    def carried(self, item: Item) -> bool:
        """Whether turns still to come can use an item itself, not only what followed from it in its column."""
        return self.wanted(item) is not None or (self.done(item) and self.rules[item[0]][0] == self.start)

    def first_column(self) -> dict[Item, Value]:
        """Predictions before any turn, closed."""
        column: dict[Item, Value] = {}
        heads, todo = {self.start}, [self.start]
        while todo:
            head = todo.pop()
            for i, (h, body) in enumerate(self.rules):
                if h == head:
                    column[(i, 0)] = (0, "", "")
                    if body and body[0] not in heads and body[0] in self.waiting:
                        heads.add(body[0])
                        todo.append(body[0])
        return self.closed(column)

    def closed(self, column: dict[Item, Value]) -> dict[Item, Value]:
        """A column with what completion and insertion add to it, cheapest first."""
        out: dict[Item, Value] = {}
        queue = [(value, item) for item, value in column.items()]
        heapq.heapify(queue)
        while queue:
            value, item = heapq.heappop(queue)
            if item in out:
                continue
            out[item] = value
            rule, dot = item
            if self.done(item):
                for r, d in self.waiting.get(self.rules[rule][0], ()):
                    heapq.heappush(queue, (value, (r, d + 1)))
            elif (t := self.wanted(item)) in self.made:
                heapq.heappush(queue, ((value[0] + self.insert, value[1] + "I", value[2] + t), (rule, dot + 1)))
        return out

    def read(self, column: dict[Item, Value], initial: str, fault: str) -> dict[Item, Value]:
        """The column after one more turn."""
        out: dict[Item, Value] = {}

        def reach(item: Item, value: Value) -> None:
            if item not in out or value < out[item]:
                out[item] = value

        extra = self.truncated if fault == TRUNCATED else 0
        for item, (cost, audit, roles) in column.items():
            if not self.carried(item):
                continue
            reach(item, (cost + self.delete, audit + "D", roles))
            t = self.wanted(item)
            if t is None or fault in (BLANK, DUPLICATE):
                continue
            after = (item[0], item[1] + 1)
            if initial == t:
                reach(after, (cost + extra, audit + "K", roles + t))
            if t in self.made:
                reach(after, (cost + self.rerole + extra, audit + "R", roles + t))
        return self.closed(out)

    def parse(self, codes: str, column: dict[Item, Value]) -> dict[Item, Value]:
        """The last column of a chart: codes are an initial and a fault for each turn."""
        for i in range(0, len(codes), 2):
            column = self.read(column, codes[i], codes[i + 1])
        return column

    def through(self, codes: str) -> list[tuple[Item, Item, int, str, str]]:
        """From each item that may come in to each that may go out: (in, out, cost, audit, initials)."""
        seeds = [(i, d) for i, (_, body) in enumerate(self.rules) for d in range(len(body) + 1) if self.carried((i, d))]
        return [(seed, item, *value) for seed in seeds for item, value in self.parse(codes, {seed: (0, "", "")}).items() if self.carried(item)]


#: Nothing, or pairs of user and assistant, of which the first may follow a system turn.
CHAT = RoleGrammar(
    (("conversation", ()), ("conversation", ("pairs",)), ("pairs", ("before", "u", "a")), ("before", ()), ("before", ("s",)), ("before", ("pairs",))),
    {"u": "user", "a": "assistant"},
    legal=frozenset(("su", "ua", "au")),
)


def _chain(last: tuple | None) -> list[tuple[str, str]]:
    out = []
    while last is not None:
        last, part = last
        out.append(part)
    return out[::-1]


def _before(a: tuple, b: tuple) -> bool:
    """Whether chain a has the lesser audit; both have as many parts."""
    x, y = [], []
    while a is not b:
        (a, p), (b, q) = a, b
        x.append(p[0])
        y.append(q[0])
    return "".join(reversed(x)) < "".join(reversed(y))


class _Carried:
    """The column of a conversation's chart at the end of its stretches so far, with the parts of the audits that lead to it."""

    def __init__(self, grammar: RoleGrammar):
        self.grammar = grammar
        self.column = {item: (value[0], (None, (value[1], value[2]))) for item, value in grammar.first_column().items() if grammar.carried(item)}
        self.places: list = []
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.last = ""

    def add(self, place: object, codes: str, table: list[dict]) -> None:
        out: dict = {}
        for row in table:
            known = self.column.get((row["a"], row["b"]))
            if known is None:
                continue
            item, value = (row["c"], row["d"]), (known[0] + row["cost"], (known[1], (row["audit"], row["roles"])))
            if item not in out or value[0] < out[item][0] or (value[0] == out[item][0] and _before(value[1], out[item][1])):
                out[item] = value
        self.column = out
        self.places.append(place)
        faults, initials = codes[1::2], self.last + codes[::2]
        for k, kind in enumerate((BLANK, DUPLICATE, TRUNCATED)):
            self.counts[k] += faults.count(kind)
        self.counts[3] += sum(initials[i : i + 2] not in self.grammar.legal for i in range(len(initials) - 1))
        self.last = initials[-1]

    def best(self) -> tuple[int, list[tuple[str, str]]]:
        best = None
        for item, value in self.column.items():
            if self.grammar.done(item) and (best is None or value[0] < best[0] or (value[0] == best[0] and _before(value[1], best[1]))):
                best = value
        return best[0], _chain(best[1])


def faults(rows: DataFrame) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last visible character ends no sentence."""
    ended = F.rtrim(F.col("text"), F.lit(_SPACES))
    return ended == "", ~F.substring(ended, -1, 1).isin(".", "!", "?")


@dataclass(frozen=True)
class Repaired:
    """turns: conv_id, place (from 0), role, text, edit (K, R or I), a conversation's turns one after another in a partition.
    report: conv_id, n_turns, gaps, blank, duplicate, truncated, illegal, cost, audit; one row per conversation."""

    turns: DataFrame
    report: DataFrame


def repair(rows: DataFrame, grammar: RoleGrammar = CHAT, stretch: int = STRETCH) -> Repaired:
    """Conversations (conv_id, turn, role, text) as the grammar has them, with the fewest costs.

    Turns go by ``turn`` (nulls first), those of one number by role, then the first 64 characters of the text, then its hash. A
    turn is blank (nothing visible), else duplicate (role and text seen earlier, by two 64-bit hashes), else truncated (no
    ``. ! ?`` at the end): the first that applies counts. Blank and duplicate turns are deleted; of repairs of one cost the one with
    the least audit is taken. gaps: turn numbers missing between the least and the greatest (nulls not counted, 0 if all are).
    A null role or text is one space. Conversations are told apart by conv_id, null being one of its own. Empty tables give
    empty ones; extra columns don't matter; texts of any length are taken one at a time. A conversation's turns are parsed
    in many tasks, but come out in one, in order.
    """
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "conversations")
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"))
    order = ("turn", "role", "head", "h1", "h2")
    keyed = rows.select("*", F.substring("text", 1, 64).alias("head"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"))
    blank, truncated = faults(keyed)
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin(*sorted(grammar.initials)), initial).otherwise(".")
    narrow = keyed.select("conv_id", *order, initial.alias("initial"), blank.alias("blank"), truncated.alias("cut"), F.monotonically_increasing_id().alias("salt"))
    # by range, so that a long conversation is several partitions' work; seq is the order of all turns
    ranged = narrow.repartitionByRange("conv_id", *order, "salt").sortWithinPartitions("conv_id", *order).drop("salt")
    turns = scratch.keep("turns", ranged.withColumn("seq", F.monotonically_increasing_id()))
    again = turns.filter(~F.col("blank")).groupBy("conv_id", "h1", "h2").agg(F.min("seq").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first")
    told = turns.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("seq") > F.col("first"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(NONE)
    coded = told.select("conv_id", "seq", F.struct(*order).alias("place"), F.concat("initial", fault).alias("code"))
    several = coded.groupBy("conv_id", F.floor(F.col("seq") / stretch).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("seq", "code"))).alias("x"), F.min(F.struct("seq", "place")).alias("low"))
    stretches = several.select("conv_id", "stretch", F.col("low.place").alias("place"), F.array_join(F.transform("x", lambda x: x["code"]), "").alias("codes"))
    entry = "array<struct<a:int,b:int,c:int,d:int,cost:bigint,audit:string,roles:string>>"
    parsed = stretches.mapInArrow(_parse(grammar), T.StructType([*stretches.schema.fields, T.StructField("found", spark.createDataFrame([], f"x {entry}").schema["x"].dataType)]))
    place = T.StructField("place", stretches.schema["place"].dataType)
    part = T.StructType([place, T.StructField("audit", T.StringType()), T.StructField("roles", T.StringType())])
    numbers = ("n_turns", "blank", "duplicate", "truncated", "illegal", "cost")
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *(T.StructField(n, T.LongType()) for n in numbers), T.StructField("audit", T.StringType()), T.StructField("parts", T.ArrayType(part))])
    edits = scratch.keep("edits", parsed.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(_put_together(grammar), kind))
    # every stretch's edits stand before its turns; equal turns may change places with no harm
    nothing = F.lit(None).cast("string")
    told_edits = edits.select("conv_id", F.posexplode("parts").alias("n", "p")).select("conv_id", "p.place", F.lit(0).alias("is_turn"), "n", F.col("p.audit").alias("audit"), F.col("p.roles").alias("roles"), nothing.alias("role"), nothing.alias("text"))
    texts = keyed.select("conv_id", F.struct(*order).alias("place"), F.lit(1).alias("is_turn"), F.lit(0).alias("n"), nothing.alias("audit"), nothing.alias("roles"), "role", "text")
    lined = told_edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "place", "is_turn", "n").drop("place", "n")
    out = T.StructType([kind["conv_id"], T.StructField("place", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("role", "text", "edit"))])
    repaired = lined.mapInArrow(_apply(grammar), out)
    per = turns.groupBy("conv_id", "turn").count().groupBy(F.col("conv_id").alias("of")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    report = edits.join(per, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "n_turns", "gaps", *numbers[1:], "audit")
    return Repaired(repaired, report)


def _parse(grammar: RoleGrammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        through = lru_cache(maxsize=4096)(grammar.through)  # short conversations are much alike
        for batch in batches:
            found = [[dict(zip("abcd", (*x[0], *x[1]), strict=True), cost=x[2], audit=x[3], roles=x[4]) for x in through(c)] for c in batch.column("codes").to_pylist()]
            kind = pa.list_(pa.struct([*((k, pa.int32()) for k in "abcd"), ("cost", pa.int64()), ("audit", pa.string()), ("roles", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "found"])

    return run


def _put_together(grammar: RoleGrammar):
    """Stretches by conversation and order to one row per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "parts"]
        now: _Carried | None = None
        of, types = None, None

        def finished() -> list:
            cost, parts = now.best()
            audit = "".join(a for a, _ in parts)
            # what is inserted before any turn stands with the first stretch
            parts = [(parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]), *parts[2:]]
            return [of, sum(c != "I" for c in audit), *now.counts, cost, audit, [{"place": p, "audit": a, "roles": r} for p, (a, r) in zip(now.places, parts, strict=True)]]

        def table(rows: list[list]) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("place", types[1]), ("audit", pa.string()), ("roles", pa.string())]))
            kinds = [types[0], *[pa.int64()] * 6, pa.string(), kind]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))], names=names)

        for batch in batches:
            types = (batch.schema.field("conv_id").type, batch.schema.field("place").type)
            rows = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != of:
                    if now is not None:
                        rows.append(finished())
                    now, of = _Carried(grammar), r["conv_id"]
                now.add(r["place"], r["codes"], r["found"])
            if rows:
                yield table(rows)
        if now is not None:
            yield table([finished()])

    return run


def _apply(grammar: RoleGrammar):
    """Edits and turns, in order, to the turns that stay, are reroled or come in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: object = None
        began, place = False, 0
        edits: list[str] = []  # edits, and initials, still to be made, last first
        roles: list[str] = []

        def inserted() -> Iterator[tuple]:
            nonlocal place
            while edits and edits[-1] == "I":
                edits.pop()
                yield of, place, grammar.made[roles.pop()], "", "I"
                place += 1

        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if not began or r["conv_id"] != of:
                    out += inserted()
                    began, of, place, edits, roles = True, r["conv_id"], 0, [], []
                if not r["is_turn"]:
                    edits = [*reversed(r["audit"]), *edits]
                    roles = [*reversed(r["roles"]), *roles]
                    continue
                out += inserted()
                edit = edits.pop()
                if edit != "D":
                    initial = roles.pop()
                    out.append((of, place, r["role"] if edit == "K" else grammar.made[initial], r["text"], edit))
                    place += 1
            yield _turns(out, batch.schema.field("conv_id").type)
            kind = batch.schema.field("conv_id").type
        if began:
            yield _turns(list(inserted()), kind)
        bt.release()

    return run


def _turns(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "place", "role", "text", "edit"])


def digest(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of ``role:text`` of its turns, joined by line ends: turns as ``repair`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now, kind = None, None, None
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            kind, out = batch.schema.field("conv_id").type, []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or conv != of:
                    if now is not None:
                        out.append((of, now.hexdigest()))
                    of, now = conv, hashlib.sha256()
                else:
                    now.update(b"\n")
                now.update(f"{role}:{text}".encode())
            if out:
                yield table(out)
        if now is not None:
            yield table([(of, now.hexdigest())])

    return turns.mapInArrow(run, T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))
