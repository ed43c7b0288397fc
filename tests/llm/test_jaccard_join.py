import random

import numpy as np
import pytest

from tidemark.llm import jaccard_join as jj
from tidemark.llm.components import components
from tidemark.llm.scratch import Scratch


def sets_of(text):
    w = [bytes(x).decode() for x in ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).encode().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = [sets_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(60)] + ["é", "Ñ"]
    bases = [rng.choices(words, k=rng.choice([3, 6, 30, 80, 200])) for _ in range(12)]
    common = rng.choices(words, k=40)
    docs = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if i % 4 == 0:
            w += common
        if i % 7 == 0:
            w = w[: rng.randrange(len(w) + 1)]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return docs + [(1000, None), (1001, ""), (1002, " \t"), (3, docs[3][1]), (5, docs[9][1]), (1003, "a b"), (1004, "A b"), (-4, "a b")]


@pytest.mark.parametrize("tile, seed", [(512, 1), (3, 2)])
def test_against_brute_force(spark, monkeypatch, tile, seed):
    monkeypatch.setattr(jj, "TILE", tile)
    monkeypatch.setattr(jj, "CHUNK_ROWS", 50)
    if tile == 3:
        monkeypatch.setattr(jj, "PARTNERS", 2)
        monkeypatch.setattr(jj, "NEIGHBOURS", 1)
    docs = corpus(seed)
    got = jj.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs)


def test_sets_that_share_a_name_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(jj, "NAME_BITS", 6)
    docs = corpus(5)
    got = jj.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs)


def test_a_large_tile_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jj, "TILE", 16)
    rng = random.Random(8)
    base, docs = [f"w{i}" for i in range(120)], []
    for i in range(700):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(100)] = rng.choice(["x", "y", "z"])
        docs.append((i, " ".join(w + [f"u{rng.randrange(40)}"] * rng.randrange(30))))
    got = jj.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs)


def test_many_equal_rows_and_rows_without_words(spark):
    docs = [(7, "a b c d e f g")] * 300 + [(None, None)] * 50 + [(8, "a b c d e f g"), (9, "")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, k int")
    got = jj.near_duplicates(df).groupBy("component_id", "n_shingles").count().collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(-(2**63), 0, 50), (7, 3, 301), (9, 0, 1)]
    kept = jj.keep_one(df)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 7), (False, 9)] + [(True, 0)] * 50


def test_empty_table_null_id_and_clashing_columns(spark):
    schema = "doc_id long, text string, c int, component string"
    assert jj.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = jj.near_duplicates(spark.createDataFrame([(None, "a b c", 1, "x"), (4, "A b c", 1, "x")], schema)).collect()
    assert {r.component_id for r in rows} == {-(2**63)}


def test_prefix_and_bound_never_exclude_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)
        a = np.unique(pool[rng.random(len(pool)) < 0.9])
        b = np.unique(pool[rng.random(len(pool)) < 0.9])
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            na, nb = np.array([len(a)]), np.array([len(b)])
            assert both >= jj.needed(na, nb, 80)[0]
            assert set(a[: jj.prefix_length(na, 80)[0]]) & set(b[: jj.prefix_length(nb, 80)[0]])
            g = [np.frombuffer(x, np.uint64) for x in jj.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))]
            words = min(map(len, g))
            assert both <= jj._bounds(len(a), len(b), *(jj.folded(x, words) for x in g))


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_components_of_chains_and_stars(spark, monkeypatch, chunk):
    monkeypatch.setattr("tidemark.llm.components.CHUNK_EDGES", chunk)
    monkeypatch.setattr("tidemark.llm.components.TASK_EDGES", 100)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + rng.randrange(40), 2000 + rng.randrange(40)) for _ in range(30)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "x").collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    assert got == {k: v for k, v in want.items() if any(a != b and k in (a, b) for a, b in edges)}
