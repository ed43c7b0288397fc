import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string"
MADE = {"u": "user", "a": "assistant"}
#: Initials so far to those that may follow: nothing, s, u, a.
STEPS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def account(rows):
    """Faults, cost, audit and repaired turns of one conversation, by the cost still to come from each turn and state."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: r)
    faults, seen = [], set()
    for _, _, role, text in rows:
        kept = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    n, far = len(rows), 10**9
    togo = [{s: far for s in STEPS} for _ in range(n + 1)]
    togo[n] |= {"": 0, "a": 0}

    def edits(i, s):
        """(letter, cost, turn and state after, turn that comes out)."""
        if i < n:
            _, _, role, text = rows[i]
            yield "D", 4, i + 1, s, None
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                if role[:1] in STEPS[s]:
                    yield "K", extra, i + 1, STEPS[s][role[:1]], (role, text)
                for x in STEPS[s]:
                    if x in MADE:
                        yield "R", 3 + extra, i + 1, x, (MADE[x], text)
        for x in STEPS[s]:
            if x in MADE:
                yield "I", 3, i, x, (MADE[x], "")

    for i in range(n, -1, -1):
        for _ in range(len(STEPS) + 1):
            for s in STEPS:
                togo[i][s] = min([togo[i][s], *(c + togo[j][t] for _, c, j, t, _ in edits(i, s))])
    i, s, audit, out = 0, "", "", []
    while togo[i][s] or i < n:
        letter, _, i, s, made = min((e for e in edits(i, s) if e[1] + togo[e[2]][e[3]] == togo[i][s]), key=lambda e: e[0])
        audit += letter
        out += [made] if made else []
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows if r[0]}
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, togo[0][""], audit), out


def check(spark, rows, stretch):
    got = C.repair(spark.createDataFrame(rows, ROWS), stretch=stretch)
    per = {}
    for c, *r in rows:
        per.setdefault(c, []).append(r)
    report = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in got.report.collect()}
    assert report.keys() == per.keys()
    turns = {}
    for r in sorted(got.turns.collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    shas = {r.conv_id: r.repaired_sha256 for r in C.digest(got.turns).collect()}
    for c, mine in per.items():
        want, out = account(mine)
        assert report[c] == want, (mine, report[c], want)
        assert turns.get(c, []) == out
        assert (shas[c] if out else None) == (hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest() if out else None)


@pytest.mark.parametrize("stretch", [1, 3, 1024])
def test_against_costs_still_to_come(spark, stretch):
    rng = random.Random(stretch)
    roles = ["user", "assistant", "system", "tool", None, ""]
    texts = ["Yes.", "No!", "cut", " ", "", None, "Why? ", "long" * 30 + "."]
    rows = []
    for c in range(60):
        for i in range(rng.choice([1, 2, 3, 5, 9])):
            turn = rng.choice([i, i, i, i, None, 0])
            text = rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."
            rows.append((c if c else None, turn, rng.choice(roles[:2]) if rng.random() < 0.7 else rng.choice(roles), text))
            if rng.random() < 0.15:
                rows.append(rows[-1])
    check(spark, rows, stretch)


def test_a_conversation_of_many_turns_is_parsed_in_parts(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant"]), f"turn {i % 700}{rng.choice(['.', ''])}") for i in range(3000)]
    check(spark, rows + [(2, 0, "user", "hi."), (2, 1, "assistant", "hello.")], 256)


def test_empty_extra_columns_and_long_texts(spark):
    empty = C.repair(spark.createDataFrame([], ROWS))
    assert empty.report.count() == 0 and empty.turns.count() == 0 and C.digest(empty.turns).count() == 0
    long = "words and words " * 80_000 + "."
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "ok.")], ROWS).withColumn("seq", F.lit(1)).withColumn("place", F.lit("x")).withColumn("audit", F.lit(2))
    got = C.repair(rows)
    assert got.report.select("cost", "audit").collect() == [(0, "KK")]
    assert [r.text for r in sorted(got.turns.collect(), key=lambda r: r.place)] == [long, "ok."]


def test_grammars_are_left_linear_and_edits_cost():
    with pytest.raises(ValueError):
        C.RoleGrammar((("x", ("u", "x")),), {})
    with pytest.raises(ValueError):
        C.RoleGrammar((("x", ("u",)),), {}, insert=0)
    only_users = C.RoleGrammar((("x", ()), ("x", ("x", "u"))), {"u": "user"})
    column = only_users.parse("u0a0u3", only_users.first_column())
    assert min(v for i, v in column.items() if only_users.done(i) and only_users.rules[i[0]][0] == "x") == (6, "KRK", "uuu")
