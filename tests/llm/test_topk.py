"""Top-k search against all pairs."""

import math
import random

import pytest

from gaplens.llm import topk

from .oracle import assert_same


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    assert_same(topk.op10_topk(spark, d), topk.OP10_SQL, d)


def brute(rows, k, every):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(fine):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(fine) if m != n and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("pivots,block,chunk", [(1, 50, 3), (5, 16, 4), (64, 4096, 4096)])
def test_small_cells_ties_and_odd_rows(spark, pivots, block, chunk):
    rng = random.Random(pivots)
    hot = [0.5, -0.25, 1.0, 0.0]
    rows = [(i, hot if i % 3 == 0 else [rng.uniform(-2, 2) for _ in range(4)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [1.0, float("nan"), 0.0, 0.0]), (303, [float("inf")] * 4), (None, hot), (40, hot), (41, rows[41][1])]
    rows += [(305, [1.0, 2.0]), (310, [3.0, -1.0]), (320, []), (330, []), (340, [1e12, 0.0, 0.0, 0.0]), (-20, [0.1, 0.2, 0.3, 0.4])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cell int, score int")
    got = sorted(map(tuple, topk.top_k(df, k=7, every=10, pivots=pivots, block=block, chunk=chunk).collect()))
    assert got == brute(rows, 7, 10)


def test_clusters_are_excluded(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 4) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 12]]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, share = topk.search(df, k=5, every=30, pivots=12, block=64, chunk=8)
    assert sorted(map(tuple, out.collect())) == brute(rows, 5, 30)
    assert share > 0.6


@pytest.mark.parametrize("size", [3, 40])
def test_bounds_hold(size):
    import numpy as np

    rng = np.random.default_rng(size)
    x = np.floor(64 * rng.normal(size=(400, size)) + rng.normal(size=size) * 50)
    cells = topk.Cells({size: x[:5].copy()}, 5)
    batch = topk.pa.RecordBatch.from_arrays([topk.pa.array(range(400)), topk.pa.array(range(400)), topk.pa.array(x.astype(np.int64).tolist(), topk.pa.list_(topk.pa.int64()))], names=["rid", "id", "v"])
    (made,) = topk._assign(cells)(iter([batch]))
    cell, far, along, off = (made.column(k).to_numpy() for k in range(3, 7))
    cells.learn([{"cell": c, "n": int((cell == c).sum()), "radius": far[cell == c].max(), "low": along[cell == c].min(), "high": along[cell == c].max(), "off": off[cell == c].max()} for c in np.unique(cell).tolist()])
    bound = cells.bounds(x)
    for c in np.unique(cell).tolist():
        assert (x @ x[cell == c].T <= bound[:, [c - 5 * size]]).all()


def test_very_long_vectors(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5000)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, k=3, every=10, pivots=4, block=16, chunk=2).collect())) == brute(rows, 3, 10)


def test_empty_and_alone(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(df).count() == 0
    assert topk.top_k(df.limit(0)).count() == 0
