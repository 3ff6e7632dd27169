"""Tails, tests and pooling against published values and plain versions."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaplens.functions import stats, tails
from gaplens.operators import evidence, ranges


def test_tails():
    assert abs(tails.chi2_sf(7.815, 3) - 0.04999) < 1e-5
    assert abs(tails.t_two_sided(2.228, 10) - 0.05001) < 1e-5
    assert abs(tails.t_quantile(0.975, 10) - 2.228139) < 1e-5
    assert tails.chi2_sf(0, 3) == 1 and tails.t_two_sided(math.inf, 4) == 0
    assert abs(tails.ks_two_sided(0.5, 4, 4, 10_000) - 0.7714285714) < 1e-9
    assert abs(tails.ks_two_sided(0.05, 5000, 5000, 100) - tails.ks_two_sided(0.05, 5001, 5000, 100)) < 1e-3


def test_chi_squared():
    assert abs(stats.chi2_independence([[30, 10], [15, 25]])["statistic"] - 9.9556) < 1e-4
    assert stats.chi2_independence([[1, 2]]) is None and stats.chi2_independence([[0, 0], [1, 2]]) is None
    assert stats.chi2_independence([[10, 20, 30], [20, 20, 20]])["df"] == 2


def test_medians_by_ranges_equal_those_of_one_buffer(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", float(v)) for i, v in enumerate(np.round(rng.normal(size=3000), 2))]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), (None, 9.0), ("none", None), ("ties", 5.0), ("ties", 5.0), ("ties", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {}
    for g, v in rows:
        if g is not None and v is not None:
            want.setdefault(g, []).append(v)
    want = {g: float(np.median(v)) for g, v in want.items()}
    for small in (0, 10_000):
        got = {r.g: r.m for r in ranges.medians(df, F.col("v"), F.col("g"), small).collect()}
        assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-12 for g in want)
        assert [r.m for r in ranges.medians(df, F.col("v"), None, small).collect()] == [float(np.median([v for _, v in rows if v is not None]))]  # null groups count without grouping
        assert ranges.medians(df.limit(0), F.col("v"), F.col("g"), small).count() == 0


def test_ranges_of_any_keys(spark):
    rows = [(None if i % 50 == 0 else f"k{i * 7919 % 1000:04d}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i % 400), i % 3 == 0, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "s string, t timestamp_ntz, b boolean, i int").repartition(6)
    for keys in (["s"], ["t", "i"], ["b", "s"], ["i"]):
        order = lambda r: [(r[k] is not None, r[k]) for k in keys]  # noqa: E731,B023
        got = sorted(ranges.with_range(df, [F.col(k) for k in keys], 16).collect(), key=order)
        parts = [r.part for r in got]
        assert parts == sorted(parts) and len(set(parts)) > 10 and max(np.bincount(parts)) < 250
        assert len({(tuple(order(r)), r.part) for r in got}) == len({tuple(order(r)) for r in got})
    assert ranges.with_range(df.limit(0), [F.col("s")], 4).count() == 0


def test_sums_of_products_give_the_same_evidence(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5)) * [1, 10, 1e3, 0, 5] + [0, 3, 1e6, 2, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4][rng.random(400) < 0.5] = 0.0
    cats = [[None if rng.random() < 0.3 else "abc"[int(rng.integers(3))] for _ in range(2)] for _ in range(400)]
    df = spark.createDataFrame([(*map(float, v), *c) for v, c in zip(x, cats)], "a double, b double, c double, d double, e double, u string, v string").repartition(4)
    names = {"indicator_correlations": ("column", "feature"), "structural_counts": ("categorical_col", "numeric_col"), "indicator_matrix": ("a", "b")}
    nums, some = list("abcde"), {"indicator_correlations": (["a", "b", "u"], list("abcde")), "structural_counts": (["u", "v"], list("abcde")), "indicator_matrix": (list("abcdeuv"),)}
    for name, keys in names.items():
        one, many = ({tuple(r[k] for k in keys): r.asDict() for r in getattr(evidence, name)(df, *some[name], width=w).collect()} for w in (1000, 0))
        assert one.keys() == many.keys() and len(one) > 5
        for k, row in one.items():
            for field, value in row.items():
                assert many[k][field] == (value if isinstance(value, str) else pytest.approx(value, rel=1e-9, abs=1e-9)), (name, k, field)
    assert evidence.indicator_matrix(df.limit(0), nums, width=0).count() == 0


def test_wide_tables_take_one_scan(spark, monkeypatch):
    df = spark.range(500).select(*(F.when(F.col("id") % (k + 3) == 0, None).otherwise(F.col("id") * (k + 1) % 97).alias(f"c{k}") for k in range(40)))
    scans = []
    plain = evidence.cross_sums
    monkeypatch.setattr(evidence, "cross_sums", lambda *a: scans.append(1) or plain(*a))
    monkeypatch.setattr(evidence, "_inlined", None)
    assert evidence.indicator_correlations(df, df.columns).count() > 1400  # constant sides have none
    assert evidence.indicator_matrix(df).count() == 820
    assert len(scans) == 2


def test_rubin():
    p = stats.pool_rubin([1, 2, 3, 4, 5], [0.1] * 5)
    assert p["pooled_estimate"] == 3 and p["total_variance"] > p["within_variance"] and 0 < p["fraction_missing_information"] < 1
    one = stats.pool_rubin([2.0], [0.25])
    assert one["total_variance"] == 0.25 and one["fraction_missing_information"] == 0 and one["df"] is None
    assert stats.pool_rubin([1.0, 2.0], [0.0, 0.0])["relative_increase_variance"] is None
    with pytest.raises(ValueError):
        stats.pool_rubin([], [])


def row_em(x, rounds=100, tol=1e-5, ridge=1e-6):
    """EM over rows, the long way."""
    n, p = x.shape
    mu = np.nanmean(x, axis=0)
    sigma = np.cov(np.where(np.isnan(x), mu, x), rowvar=False) + ridge * np.eye(p)
    for _ in range(rounds):
        t1, t2 = np.zeros(p), np.zeros((p, p))
        for r in x:
            o, h = np.flatnonzero(~np.isnan(r)), np.flatnonzero(np.isnan(r))
            v, c = r.copy(), np.zeros((p, p))
            if len(h):
                b = sigma[np.ix_(h, o)] @ np.linalg.pinv(sigma[np.ix_(o, o)])
                v[h] = mu[h] + b @ (r[o] - mu[o])
                c[np.ix_(h, h)] = sigma[np.ix_(h, h)] - b @ sigma[np.ix_(o, h)]
            t1 += v
            t2 += np.outer(v, v) + c
        new = t1 / n
        sigma = t2 / n - np.outer(new, new) + ridge * np.eye(p)
        done = np.abs(new - mu).max() < tol
        mu = new
        if done:
            break
    return mu, sigma


def test_em_over_patterns_equals_em_over_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal([1, 2, 3], [[2, 1, 0.5], [1, 2, 0.3], [0.5, 0.3, 1]], 200)
    x[rng.random((200, 3)) < 0.2] = np.nan
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    mu, sigma = stats.em_normal(evidence.collect_patterns(df, ["a", "b", "c"]))
    want_mu, want_sigma = row_em(x)
    assert np.abs(mu - want_mu).max() < 1e-9 and np.abs(sigma - want_sigma).max() < 1e-9
    assert evidence.little_mcar(df)["applicable"]


def test_logistic_test_under_separation(spark):
    rows = [(float(i % 4), None if i % 4 == 0 else 1.0 * i) for i in range(800)]
    df = spark.createDataFrame(rows, "edu double, income double")
    got = evidence.logistic_lr(df, "income", ["edu"])
    limit = -2 * (200 * math.log(0.25) + 600 * math.log(0.75))
    assert 0.98 * limit < got["statistic"] <= limit + 1e-6 and got["p_value"] == 0
    assert evidence.logistic_lr(df.limit(10), "income", ["edu"]) is None


def test_both_solvers_agree(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(600):
        a, b = rng.normal(size=2)
        rows.append((float(a), None if rng.random() < 0.1 else float(b), None if rng.random() < 1 / (1 + np.exp(-a - 0.5)) else 1.0))
    df = spark.createDataFrame(rows, "a double, b double, gap double")
    newton = evidence.logistic_lr(df, "gap", ["a", "b"])
    descent = evidence.logistic_lr(df, "gap", ["a", "b"], newton_to=0)
    assert abs(newton["statistic"] - descent["statistic"]) < 1e-6 and newton["df"] == 2


def test_bayesian_ridge_recovers_a_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = x @ np.array([2.0, -1.0]) + 3 + rng.normal(scale=0.1, size=500)
    xc, yc = x - x.mean(0), y - y.mean()
    coef, intercept, alpha, cov = stats.bayesian_ridge(xc.T @ xc, xc.T @ yc, yc @ yc, 500, x.mean(0), y.mean())
    assert np.abs(coef - [2, -1]).max() < 0.02 and abs(intercept - 3) < 0.02 and 60 < alpha < 140
    assert np.all(np.linalg.eigvalsh(cov) > 0)
