"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import pytest

from gaplens.llm import passages


def brute(docs, window=50):
    """{row number: (n_words, n_removed, kept)} of rows (doc_id, text)."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    least = {}
    for (i, _), w in zip(docs, words):
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p : p + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and least[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.op2_substring_dedup(spark, d).collect()}
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, g, k) in zip(docs, brute(docs))}
    assert got == want
    assert sum(g for _, g, _ in want.values()) > 0


@pytest.mark.parametrize("seed", range(3))
def test_shuffled_passages(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefgh") + rng.choice("é xy") for _ in range(rng.choice([49, 50, 51, 60, 90, 130]))) for _ in range(8)]
    docs = []
    for i in rng.sample(range(1000), 60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            own = " ".join(f"w{rng.getrandbits(30)}" for _ in range(rng.randint(0, 40)))
            p = rng.choice(pool).split(" ")
            cut = rng.randint(0, 6)
            parts += [own, rng.choice([" ", "\n", "\t"]).join(p[cut : len(p) - rng.randint(0, 4)])]
        docs.append((i, "  ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in passages.dedup_passages(df).collect())
    assert got == sorted((i, *b) for (i, _), b in zip(docs, brute(docs)))


@pytest.mark.parametrize("letters,window,gram", [("ab", 8, 3), ("abc", 6, 2), ("ab", 12, 4)])
def test_branching_contexts(spark, letters, window, gram):
    rng = random.Random(window)
    docs = [(rng.randrange(60), " ".join(rng.choice(letters) for _ in range(rng.randint(5, 60)))) for _ in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in passages.dedup_passages(df, window=window, gram=gram).collect())
    assert got == sorted((i, *b) for (i, _), b in zip(docs, brute(docs, window)))


def test_extension_both_ways():
    a, b = b"x1 a b c", b"G H d e f y1"
    assert passages.extended(0, 4, a, b, b"x2 a b c", b"G H d e f y2", 6) == ((1, 3), (4, 4, b"lx1 a b c"), (0, 0, b"rG H d e f y1"))
    assert passages.extended(0, 4, a, b, a, b, 6) == ((0, 4), None, None)
    assert passages.extended(2, 3, a, b, b"c", b"G", 6) == (None, (2, 3, b"lb c"), None)


def test_edge_cases(spark):
    long = " ".join(f"v{k % 300}" for k in range(60_000))
    fifty = " ".join(f"q{k}" for k in range(50))
    docs = [(3, None), (4, ""), (1, fifty), (2, f"a {fifty} b"), (2, f"a {fifty} b"), (2, f"c\n{fifty}"), (None, fifty), (9, long), (10, long + " x"), (1, fifty + " end"), (11, "short")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, doc int, spans int")
    out = passages.dedup_passages(df).collect()
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept) for r in out), key=str)
    assert got == sorted(((i, *b) for (i, _), b in zip(docs, brute(docs))), key=str)
    assert [(x.start, x.end) for r in out if r.row.doc_id == 2 and r.kept == "a b" for x in r.repeats] == [(1, 51), (1, 51)]
    assert passages.dedup_passages(df.limit(0)).count() == 0
