"""SimHash near-dedup against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from gaplens.llm import simhash


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items):
    """{index: component} of (id, fp) by all pairs of distinct fingerprints."""
    prints = sorted({fp for _, fp in items})
    at, root = {fp: i for i, fp in enumerate(prints)}, list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    arr = np.array(prints, np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            root[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    least = {}
    for k, fp in items:
        r = find(at[fp])
        least[r] = min(least.get(r, k), k)
    return [least[find(at[fp])] for _, fp in items]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    got = {r.doc_id: r for r in simhash.op1_simhash(spark, d).collect()}
    items = [(r.doc_id, brute_fingerprint(r.text) if sf == "sf0.001" else simhash.fingerprint(r.text) % 2**64) for r in docs]
    assert {k: got[k].fingerprint for k, _ in items} == {k: f"{fp:016x}" for k, fp in items}
    assert [got[k].component_id for k, _ in items] == brute_components(items)


@pytest.mark.parametrize("group", [3, 40, 2048])
def test_dense_groups(spark, group):
    rng = random.Random(group)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        where = rng.sample(range(64), 12) if rng.random() < 0.5 else list(range(20, 32))
        for _ in range(150):
            prints.add(centre ^ sum(1 << b for b in rng.sample(where, rng.randint(0, 6))))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    items = [(k, fp) for k, fp in enumerate(sorted(prints))]
    df = spark.createDataFrame([(fp - 2**64 * (fp >> 63),) for _, fp in items], "fp long").repartition(5)
    edges = simhash.links(df, group)
    root = {r.v % 2**64: r.root % 2**64 for r in simhash.stars(edges).collect()}
    mine = [root.get(fp, fp) for _, fp in items]
    want = brute_components(items)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_dense_forest_spans():
    rng = np.random.default_rng(1)
    fp = np.unique(np.uint64(0xABCD << 40) ^ (rng.integers(0, 2**18, 4000).astype(np.uint64)))
    ids = {int(f): i for i, f in enumerate(fp)}
    a, b = simhash._dense_forest(fp)
    items = [(i, int(f)) for i, f in enumerate(fp)]
    want = brute_components(items)
    groups = {}
    for x, y in zip(a, b):
        groups.setdefault(int(x), set()).add(int(y))
    mine = {int(y): int(x) for x, y in zip(a, b)}
    roots = [mine.get(int(f), int(f)) for f in fp]
    assert len(set(zip(roots, want))) == len(set(roots)) == len(set(want)) and ids


def test_edge_cases(spark):
    rows = [(5, None), (4, ""), (3, " \t"), (9, "One two"), (8, "one  TWO"), (None, "one two"), (None, "alone here by itself now"), (9, "One two"), (2, "w " * 200_000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, id int")
    got = sorted(((r.id, r.component) for r in simhash.components(df).collect()), key=str)
    assert got == sorted([(5, 3), (4, 3), (3, 3), (9, 8), (8, 8), (None, 8), (None, None), (9, 8), (2, 2)], key=str)
    assert simhash.components(df.limit(0)).count() == 0
