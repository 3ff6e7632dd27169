"""Strategies, leakage, order, and degenerate inputs."""

import json
import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaplens.operators import impute, neighbours, sensitivity
from gaplens.operators.chained import ChainedImputer, pool_means
from gaplens.operators.columns import missing
from gaplens.operators.neighbours import knn_fill
from gaplens.operators.profile import summary
from gaplens.plans import rules
from gaplens.plans.audit import Audit, mechanism, recommend
from gaplens.plans.report import context_summary, report_md
from gaplens.sources import demo
from gaplens.sources.files import read_csv
from gaplens.streaming.apply import impute_stream

NAN = float("nan")


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(12345)
    rows = []
    for i in range(400):
        target, edu, pool = float(rng.random() < 0.4), float(rng.randint(1, 4)), rng.random() < 0.5
        rows.append((
            i, None if rng.random() < 0.08 else rng.gauss(40, 10), None if edu <= 2 and rng.random() < 0.6 else NAN if rng.random() < 0.02 else rng.gauss(50, 9), edu,
            None if target and rng.random() < 0.55 else rng.gauss(0, 1), rng.choice(["concrete", "vinyl"]) if pool else None, rng.uniform(10, 60) if pool else 0.0, target,
        ))
    return spark.createDataFrame(rows, "id long, age double, income double, education double, risk_score double, pool_type string, pool_area double, target double").cache()


@pytest.mark.parametrize("column,strategy", [
    ("age", "numeric_median"), ("age", "numeric_median_plus_indicator"), ("age", "numeric_mean"), ("income", "groupwise_numeric_median_plus_indicator"), ("income", "group_median"),
    ("income", "time_series_ffill_bfill_plus_indicator"), ("pool_type", "categorical_missing_token"), ("pool_type", "categorical_missing_token_plus_indicator"),
    ("pool_type", "categorical_mode_plus_indicator"), ("pool_type", "structural_none_token_plus_indicator"), ("age", "structural_zero_plus_indicator"), ("pool_type", "structural_none_or_zero"),
    ("age", "structural_none_or_zero"), ("income", "model_based_imputation_optional"), ("income", "mice_multiple_imputation"), ("pool_type", "model_based_imputation_optional"), ("age", "knn"),
])
def test_strategies_leave_nothing_missing(mixed, column, strategy):
    df = mixed.select("id", "age", "income", "education", "pool_type", "target")
    out = impute.fill(df, column, strategy, group_col="education", order_by=["id"])
    assert out.count() == 400 and out.where(missing(out, column)).count() == 0
    alias = impute.ALIASES.get(strategy, strategy)
    assert (column + "_was_missing" in out.columns) == alias.endswith("_plus_indicator")
    if strategy.endswith("_plus_indicator"):
        assert out.agg(F.sum(column + "_was_missing")).first()[0] == df.where(missing(df, column)).count()


def test_drop_and_unknown(mixed):
    assert "age" not in impute.fill(mixed, "age", "drop_column").columns
    with pytest.raises(ValueError):
        impute.fill(mixed, "age", "magic")
    with pytest.raises(ValueError):
        impute.fill(mixed, "age", "time_series_ffill_bfill_plus_indicator")


def test_statistics_come_from_training_rows(spark):
    train = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0, 5.0, None)], "x double")
    predict = spark.createDataFrame([(1000.0,), (None,), (2000.0,), (NAN,)], "x double")
    assert [r.x for r in impute.fill(predict, "x", "numeric_median", train).collect()] == [1000.0, 3.0, 2000.0, 3.0]
    train = spark.createDataFrame([("A", 10.0), ("A", 12.0), ("A", None), ("B", 100.0), ("B", None), ("B", 102.0), (None, 7.0)], "g string, y double")
    predict = spark.createDataFrame([("A", None), ("B", None), ("C", None), (None, None)], "g string, y double")
    got = impute.fill(predict, "y", "group_median", train, "g").collect()
    assert {r.g: r.y for r in got} == {"A": 11.0, "B": 101.0, "C": 12.0, None: 12.0}


def test_ordered_fill_over_string_keys(spark):
    rows = [(f"k{i * 37 % 600:04d}", "ab"[i % 2], None if i % 4 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "s string, t string, v double").repartition(7)
    plain, last = {}, None
    for s, t, v in sorted(rows, key=lambda r: r[:2]):
        last = last if v is None else v
        plain[s, t] = last
    first = next(v for v in plain.values() if v is not None)
    got = {(r.s, r.t): r.v for r in impute.ordered_fill(df, "v", ["s", "t"], parts=9).collect()}
    assert got == {k: first if v is None else v for k, v in plain.items()}


def test_ordered_fill_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(i, i % 7, None if rng.random() < 0.6 else float(i)) for i in range(500)]
    rng.shuffle(rows)
    want, last = {}, None
    for i, _, v in sorted(rows):
        last = v if v is not None else last
        want[i] = last
    nxt = None
    for i, _, v in sorted(rows, reverse=True):
        nxt = v if v is not None else nxt
        want[i] = nxt if want[i] is None else want[i]
    for parts in (1, 5, 64):
        df = spark.createDataFrame(rows, "t long, e int, v double").repartition(3)
        assert {r.t: r.v for r in impute.ordered_fill(df, "v", ["t"], parts=parts).collect()} == want
    by = impute.ordered_fill(spark.createDataFrame(rows, "t long, e int, v double"), "v", ["t"], ["e"]).collect()
    assert all(r.v % 7 == r.e for r in by if r.v is not None)
    assert impute.ordered_fill(spark.createDataFrame([(1, None)], "t long, v double"), "v", ["t"]).first().v is None


def test_structural_absence_end_to_end(mixed):
    found = {e.column: e for e in mechanism(mixed, "target")}
    assert found["pool_type"].structural == "structural_absence"
    plan = rules.make_plan(list(found.values()))
    assert plan["columns"]["pool_type"]["strategy"] == "structural_none_token_plus_indicator"
    assert plan["columns"]["target"]["strategy"] == "no_imputation_needed"
    assert found["risk_score"].target_signal and found["income"].mar_signal


def test_target_is_never_changed(spark, mixed):
    df = mixed.withColumn("target", F.when(F.col("id") >= 5, F.col("target")))
    audit = Audit(df, target="target")
    out = audit.impute()
    assert out.where("target IS NULL").count() == 5
    plan = audit.results["plan"]
    assert impute.violations(df, out, plan, "id", "target").first().asDict() == {"residual_missing": 0, "bad_indicators": 0, "dropped_present": 0, "target_changed": 0}
    broken = out.withColumn("target", F.col("target") + 1).withColumn("age_was_missing", F.lit(3))
    bad = impute.violations(df, broken, plan, "id", "target").first()
    assert bad.target_changed == 395 and bad.bad_indicators == 400


@pytest.mark.parametrize("rows,schema", [
    ([(None, float(i), float(i % 2)) for i in range(30)], "allnull double, x double, target double"),
    ([(1.0, None, 0.0)], "a double, b double, target double"),
    ([(5.0 if i % 3 else None, float(i), float(i % 2)) for i in range(50)], "const double, varies double, target double"),
    ([(None, "a" if i % 2 else "b", 1.0) for i in range(20)], "allnull double, grp string, target double"),
])
def test_degenerate_tables(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    audit = Audit(df, target="target")
    out = audit.impute()
    assert out.count() == len(rows)
    first = df.columns[0]
    assert impute.fill(df, first, "numeric_median").where(F.col(first).isNull()).count() == 0
    assert impute.fill(df, first, "group_median", group_col=df.columns[1]).where(F.col(first).isNull()).count() == 0


def test_no_target_and_all_missing_training(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else float(i), i * 2.0, (i * 7 % 11) * 1.0) for i in range(60)], "a double, b double, c double")
    assert "applicable" in Audit(df).run()["mechanism"]["little_mcar_test"]
    train = spark.createDataFrame([(None,)] * 25, "feat double")
    predict = spark.createDataFrame([(100.0 + i,) for i in range(10)], "feat double")
    assert sorted(r.feat for r in impute.fill(predict, "feat", "numeric_median", train).collect()) == [100.0 + i for i in range(10)]
    assert impute.fill(df.limit(0), "a", "numeric_median").count() == 0


def test_multiple_imputation(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        b = rng.gauss(0, 1)
        rows.append((i, None if b < 0 and rng.random() < 0.6 else 2 * b + rng.gauss(0, 0.5), b, rng.gauss(5, 1), None if i < 8 else float(i % 2)))
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, target double")
    model = ChainedImputer(m=4, max_iter=3, key=["id"]).fit(df, ["a", "b", "c", "target"])
    draws = model.draws(df, ["a"], target="target")
    assert draws.count() == 1200 and draws.where("a IS NULL").count() == 0 and draws.where("target IS NULL").count() == 32
    means = [r.m for r in draws.groupBy("imputation_id").agg(F.avg("a").alias("m")).collect()]
    assert len(set(means)) == 4
    again = model.draws(df.repartition(7), ["a"], target="target").groupBy("imputation_id").agg(F.avg("a").alias("m")).collect()
    assert max(abs(x - y) for x, y in zip(sorted(means), sorted(r.m for r in again))) < 1e-9
    pooled = pool_means(df, ["a"], "target", m=5, max_iter=3, key=["id"])[0]
    assert pooled["std_error"] > pooled["naive_se"] and 0 < pooled["fraction_missing_information"] < 1
    assert abs(pooled["pooled_estimate"]) < 0.5  # the observed rows alone have a mean near 0.6


def test_neighbours(spark):
    rng = random.Random(2)
    rows = [(i, rng.uniform(0, 10), rng.uniform(0, 10) if rng.random() < 0.9 else None) for i in range(120)]
    rows = [(i, x, y, None if i % 10 == 0 else x + 0.1) for i, x, y in rows]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")

    def plain(r):
        best = []
        for o in rows:
            if o[3] is not None:
                shared = [(a - b) ** 2 for a, b in zip(r, o) if a is not None and b is not None]
                best.append(((sum(shared) * 4 / len(shared)) ** 0.5, o[3]))
        return sum(v for _, v in sorted(best)[:5]) / 5

    for block in (16, 4096):
        got = {r.id: r.z for r in knn_fill(df, df, ["z"], block=block).collect()}
        assert all(abs(got[r[0]] - (plain(r) if r[3] is None else r[3])) < 1e-9 for r in rows)


def plain_neighbours(rows, k=5):
    """The mean of the k nearest by comparing all; a row is numbers and a value, None where missing."""

    def fill(r):
        best = []
        for o in rows:
            shared = [(a - b) * (a - b) for a, b in zip(r[:-1], o[:-1]) if a is not None and b is not None]
            if o[-1] is not None and shared and math.isfinite(far := sum(shared) * len(r) / len(shared)):
                best.append((far, o[-1]))
        found = [v for _, v in sorted(best)[:k]] or [o[-1] for o in rows if o[-1] is not None]
        return sum(found) / len(found)

    return [r[-1] if r[-1] is not None else fill(r) for r in rows]


def filled_by_neighbours(spark, rows, **how):
    names = [f"c{j}" for j in range(len(rows[0]))]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "id string, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {int(r.id): r[names[-1]] for r in knn_fill(df, df, names[-1:], **how).collect()}
    assert len(got) == len(rows)
    return [got[i] for i in range(len(rows))]


@pytest.mark.parametrize("block, patterns", [(4096, 256), (8, 256), (8, 3), (1, 0)])
def test_neighbours_of_odd_rows(spark, monkeypatch, block, patterns):
    """Many patterns of gaps, ties, copies, infinities, rows that share nothing, cells and rows dealt into pieces."""
    monkeypatch.setattr("gaplens.operators.neighbours.PATTERNS", patterns)
    rng = random.Random(5)
    few = lambda: rng.choice([0.0, -0.0, 1.0, 2.0, 5.0])
    rows = [[few(), rng.gauss(0, 3), rng.gauss(7, 1), few()] for _ in range(250)] + [[1.0, 2.0, 7.0, 1.0]] * 60 + [[math.inf, 0.0, 7.0, 1.0], [-math.inf, 0.0, 1e200, 1.0], [None] * 4] * 2
    rows = [[v if at % 3 or rng.random() > 0.3 else None for v in r] + [None if at % 4 == 1 else rng.choice([rng.gauss(0, 1), 0.5])] for at, r in enumerate(rows)]
    rows.append([None, None, None, None, None])
    want = plain_neighbours(rows)
    assert all(abs(a - b) < 1e-9 for a, b in zip(filled_by_neighbours(spark, rows, block=block), want))


def test_neighbours_without_donors_or_gaps(spark):
    assert filled_by_neighbours(spark, [[1.0, None], [2.0, None]]) == [0.0, 0.0]
    assert filled_by_neighbours(spark, [[1.0, 3.0], [2.0, 4.0]]) == [3.0, 4.0]
    assert filled_by_neighbours(spark, [[None, 3.0], [2.0, None], [None, 4.0]]) == [3.0, 3.5, 4.0]


def test_neighbours_tell_where_gaps_are(spark):
    """Rows that differ only in which number is missing have other neighbours."""
    rows = [[float(i), 100.0 - i, float(i)] for i in range(40)]
    frame = lambda r: spark.createDataFrame(r, "x double, y double, z double")
    got = knn_fill(frame([[5.0, None, None], [None, 5.0, None]]), frame(rows), ["z"], k=1).collect()
    assert {(r.x, r.y): r.z for r in got} == {(5.0, None): 5.0, (None, 5.0): 39.0}


def test_neighbours_far_from_zero(spark):
    """Keys of ten digits: squares of numbers lose what squares of differences keep."""
    rows = [[9e9 + i, None if i % 10 == 0 else float(i)] for i in range(200)]
    assert filled_by_neighbours(spark, rows) == plain_neighbours(rows)


def test_neighbours_compare_few(spark):
    """The pairs of a row and a cell that are compared, all of them needed ones."""
    rng = np.random.default_rng(3)
    x = np.column_stack([np.arange(20_000.0), rng.integers(0, 25, 20_000)])
    donors, rows = x[np.arange(len(x)) % 13 > 0], x[::13]
    cells = neighbours._Cells(donors[rng.random(len(donors)) < 0.1], 16, 5)
    home = cells.of(donors)
    cells.tree.close([(at, *neighbours._box(donors[who])) for at, who in neighbours._groups(home)])
    limit, who, cell = cells.reached(rows)
    sent = set(zip(who.tolist(), cell.tolist()))
    assert sum(int((home == at).sum()) for at in cell) < 0.05 * len(rows) * len(donors)
    for i in range(0, len(rows), 25):
        far = neighbours._far(rows[i : i + 1], donors)[0]
        near = np.argsort(far, kind="stable")[:5]
        assert far[near].max() <= limit[i] and {(i, int(home[n])) for n in near} <= sent


def test_sensitivity(spark):
    rng = random.Random(99)
    rows = [(None if i % 5 < 2 else rng.gauss(10, 2), None if i % 50 == 0 else rng.gauss(10, 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "fragile double, robust double")
    got = {r.column: r for r in sensitivity.tipping(df, ["fragile", "robust"]).collect()}
    assert abs(got["fragile"].tipping_point) <= 0.75 and got["robust"].tipping_point is None and got["robust"].robustness == "robust"
    means = [r["mean"] for r in sensitivity.trajectory(df, "fragile").orderBy("delta").collect()]
    assert means == sorted(means)
    flat = df.withColumn("fragile", F.coalesce("fragile", F.lit(0.0)))
    assert sensitivity.numeric_alerts(df, flat, "fragile") and not sensitivity.numeric_alerts(df, df, "fragile")
    words = spark.createDataFrame([("a" if i % 2 else None,) for i in range(40)], "w string")
    assert sensitivity.categorical_alerts(words, impute.fill(words, "w", "categorical_missing_token"), "w") == ["w: over 30 % are MISSING"]


def test_categorical_alerts_count_all_values(spark):
    words = spark.range(20_000).select(F.when(F.col("id") >= 2000, F.concat(F.lit("v"), "id")).alias("w"))
    assert sensitivity.categorical_alerts(words, impute.fill(words, "w", "categorical_missing_token"), "w") == []
    moved = words.fillna("common")  # 10 % of all rows
    assert sensitivity.categorical_alerts(words, moved, "w") == []
    half = words.withColumn("w", F.when(F.col("w") > "v5", F.col("w")).otherwise("common"))
    assert sensitivity.categorical_alerts(words, half, "w") == ["w: common more than doubled"]
    assert sensitivity.categorical_alerts(half, half, "w") == [] == sensitivity.categorical_alerts(words.limit(0), words.limit(0), "w")


def test_categorical_target_of_many_classes(spark):
    from gaplens.functions import stats

    rng = random.Random(7)
    rows = [(None if rng.random() < 0.3 else 1.0, f"class {i % 3000}", i % 7) for i in range(18_000)]
    cells = {}
    for x, t, _ in rows:
        cells.setdefault(t, [0, 0])[x is not None] += 1
    want = stats.chi2_independence(list(zip(*cells.values())))
    shares = [a / (a + b) for a, b in cells.values()]
    found = next(e for e in mechanism(spark.createDataFrame(rows, "x double, t string, y int"), "t") if e.column == "x")
    assert found.target_p == round(want["p_value"], 6) and 0 < found.target_p < 1
    assert found.target_effect == round(max(shares) - min(shares), 4)


def test_rules_in_python_and_sql_agree(spark):
    from itertools import product

    rows = []
    for numeric, n, rate, high, target, structural, group, sig, tp, mp, tag in product((True, False), (0, 30), (0.04, 0.3, 0.9), (True, False), (False,), (None, "structural_absence", "co_missing_structural"), (None, "g"), (True, False), (None, 0.01), (0.01, 0.5), (None, "sensor_reading")):
        e = rules.Evidence("c", numeric, n, rate if n else 0.0, high, target, structural, group, sig, tp, None, mp)
        rows.append((numeric, n, e.missing_rate, high, target, structural, group, e.target_signal, rules.mechanism_label(e), tag is not None, rules.strategy(e, tag)[0]))
    df = spark.createDataFrame(rows, "is_numeric boolean, n_missing long, missing_rate double, high_cardinality boolean, is_target boolean, structural string, group_col string, target_signal boolean, label string, temporal boolean, want string")
    assert df.where(F.expr(rules.STRATEGY_SQL) != F.col("want")).count() == 0


def test_leakage_levels():
    plan = {"columns": {c: {"strategy": s, "fit_on": f} for c, s, f in (("a", "drop_column", "x"), ("b", "model_based_imputation_optional", "train_only"), ("c", "numeric_median", "train_only"), ("d", "numeric_median", "all"))}}
    assert [f["leakage_risk"] for f in rules.leakage_findings(plan)["findings"]] == ["none", "medium", "low", "high"]


def test_compat_rounding():
    e = rules.Evidence("c", True, 1, 1e-5)
    assert rules.strategy(e)[0] == "numeric_median" and rules.strategy(e, compat_rounding=True)[0] == "no_imputation_needed"


def test_stream_of_files(spark, mixed, tmp_path):
    mixed.select("id", "age", "education", "income").repartition(4).write.parquet(f"{tmp_path}/in")
    fitted = impute.PlanImputer([impute.Step("age", "numeric_median_plus_indicator"), impute.Step("income", "group_median", group_col="education")]).fit(mixed.select("id", "age", "education", "income"))
    stream = spark.readStream.schema("id long, age double, education double, income double").parquet(f"{tmp_path}/in")
    q = impute_stream(stream, fitted).writeStream.format("memory").queryName("filled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = fitted.transform(mixed.select("id", "age", "education", "income"))
    assert spark.sql("SELECT * FROM filled").exceptAll(batch.select(*spark.sql("SELECT * FROM filled").columns)).count() == 0
    assert spark.sql("SELECT * FROM filled").count() == 400


def test_files_report_and_script(spark, mixed, tmp_path):
    path = f"{tmp_path}/in.csv"
    rows = mixed.orderBy("id").toPandas()
    rows.to_csv(path, index=False, na_rep="NA")
    df = read_csv(spark, path)
    assert dict(df.dtypes)["age"] == "double" and df.where("age IS NULL").count() == mixed.where("age IS NULL").count()
    audit = Audit(df.drop("id"), target="target")
    audit.run()
    audit.save(f"{tmp_path}/out", {"data": path}, m=2)
    plan = json.load(open(f"{tmp_path}/out/logs/imputation_plan.json"))
    assert plan["columns"]["pool_type"]["strategy"] == "structural_none_token_plus_indicator"
    text = report_md(audit.results)
    assert "Little's test" in text and "pool_type" in context_summary(audit.results)
    compile(open(f"{tmp_path}/out/reproduce.py").read(), "reproduce.py", "exec")
    done = subprocess.run([sys.executable, f"{tmp_path}/out/reproduce.py", path, f"{tmp_path}/imputed"], capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-800:]
    assert spark.read.csv(f"{tmp_path}/imputed", header=True).count() == 400


def test_demo_tables_have_their_mechanisms(spark):
    labels = {}
    for name in ("random", "explained", "target", "structural"):
        df = demo.TABLES[name](spark)
        assert df.count() in (800, 200) and df.collect() == demo.TABLES[name](spark).collect()
        plan = recommend(df, "target")["columns"]
        labels[name] = {c: (p["mechanism_label"], p["strategy"]) for c, p in plan.items() if p["missing_rate"] > 0}
    assert labels["random"] == {"measurement_a": ("MCAR-compatible", "numeric_median")}
    assert labels["explained"]["income"] == ("MAR-like evidence", "numeric_median_plus_indicator")
    assert labels["target"]["credit_score"][0] == "target-associated missingness"
    assert labels["structural"] == {"facility_type": ("structural missingness", "structural_none_token_plus_indicator")}
    assert demo.mixed_gaps(spark).count() == 600 and len(demo.mixed_gaps(spark).columns) == 8
    week = demo.panel(spark)
    share = summary(week).first().overall_missing_rate
    assert week.count() == 780 and 0.05 < share < 0.15


def test_audit_tells_its_evidence_and_takes_limits(spark, tmp_path):
    df = demo.panel(spark)
    audit = Audit(df, domain_tags={"naloxone_admin_rate": "time_series_metric"}, order_by=["week"], partition_by=["state"])
    told = audit.run()["mechanism"]["columns"]["ed_visit_rate"]
    assert told["mechanism_label"] == "group-dependent missingness" and told["driving_test"]["test"] == "chi_squared" and told["driving_test"]["p_value"] < 0.05
    (state,) = [g for g in told["categorical_correlated_features"] if g["feature"] == "state"]
    assert len(state["all_group_rates"]) == 15 and all(r >= 0.5 for r in state["high_missing_groups"].values()) and state["chi2_statistic"] > 0
    assert told["correlated_features"] and any("state" in line for line in told["mechanism_evidence"])
    audit.save(str(tmp_path / "out"), m=2)
    text = (tmp_path / "out" / "reports" / "missingness_report.md").read_text()
    assert "### ed_visit_rate" in text and "driving test: chi squared" in text and "### Decisions" in text
    strict = Audit(df, limits=rules.Limits(spread=1.1, alpha=1e-300, pair_r=1.1, drop_over=0.01)).run()
    assert strict["mechanism"]["columns"]["ed_visit_rate"]["mechanism_label"] == "MCAR-compatible"
    assert strict["plan"]["columns"]["ed_visit_rate"]["strategy"] == "drop_column"


def test_captions():
    assert rules.severity_caption({}) == "No values are missing."
    assert "b (90.0%)" in rules.severity_caption({"a": 0.1, "b": 0.9}) and "1 miss 80 %" in rules.severity_caption({"a": 0.1, "b": 0.9})
    assert "at once" in rules.pattern_caption(0.4, 0.2) and "independent gaps would" in rules.pattern_caption(0.4, 0.01)
    assert "a, b" in rules.target_caption({"b": 0.2, "a": -0.5, "c": 0.01}) and "hardly" in rules.target_caption({"c": 0.01})
    assert rules.mice_method(False, 4, True) == "polyr" and rules.mice_method(False, 2) == "logreg"


def test_csv_with_quoted_line_feeds(spark, tmp_path):
    path = str(tmp_path / "q.csv")
    with open(path, "w") as f:
        f.write('name,v\n"two\nlines, ""quoted""",1\nplain,NA\n')
    rows = read_csv(spark, path).collect()
    assert [(r.name, r.v) for r in rows] == [('two\nlines, "quoted"', 1), ("plain", None)]
