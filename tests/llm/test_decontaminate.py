import hashlib
import random
import re

from tidemark.llm.decontaminate import digest, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for d, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, body in items:
            b = words(body)
            n = min(10, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    names.add(str(name))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"W{i}é" for i in range(8)] + ["x", "Y", "1a"]
    say = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(vocab, k=n))
    items = [(i, say(rng.choice([0, 3, 7, 9, 10, 11, 25]))) for i in range(40)] + [(99, None), (98, ""), (97, "x " * 30), (3, say(12))]
    docs = [(i, say(rng.choice([0, 5, 40])) + " " + (items[i % 40][1][2:].upper() if i % 2 else "") + "; " + say(6)) for i in range(80)]
    docs += [(200, None), (201, ""), (5, docs[5][1]), (None, items[6][1]), (202, "x x x " * 50)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1_000_000, 300, 80):
        got = sorted((tuple(r) for r in digest(find_contamination(df, bench, ["doc_id"], block_bytes=limit)).collect()), key=str)
        assert got == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "z", 3)], "doc_id long, text string, hits string, row int")
    none = spark.createDataFrame([], "item_id long, text string")
    out = find_contamination(df, none, df.columns)
    assert out.select("row.*").collect() == df.collect() and out.first()["n_words"] == 2
    assert find_contamination(df.limit(0), none, ["doc_id"]).count() == 0
