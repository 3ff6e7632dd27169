"""The whole audit: profile, mechanism, structure, plan, leakage; then imputation and files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.tails import chi2_sf
from ..operators import evidence as ev
from ..operators.columns import categorical_columns, normalise, numeric_columns
from ..operators.impute import PlanImputer
from ..operators.profile import profile, summary
from .rules import DEFAULT, Evidence, Limits, driving_test, evidence_lines, leakage_findings, make_plan, mechanism_label, robustness_note


def mechanism(df: DataFrame, target: str | None = None, profiles: list[dict] | None = None, pairs: list[dict] | None = None, limits: Limits = DEFAULT) -> list[Evidence]:
    """The evidence on every column; one scan each for profile, groups, correlations and structure, and one fit for each numeric test."""
    df = normalise(df)
    profiles = profiles if profiles is not None else [r.asDict() for r in profile(df, target=target).orderBy("position").collect()]
    gaps = [p["column"] for p in profiles if 0 < p["n_missing"]]
    partly = [p["column"] for p in profiles if 0 < p["n_missing"] < p["n_total"]]
    numerics, categoricals = numeric_columns(df, target), [c for c in categorical_columns(df, target) if c not in {p["column"] for p in profiles if p["n_missing"] == p["n_total"]}]
    rates: dict[tuple[str, str], list] = {}
    if gaps and categoricals:
        spread = ev.group_spread(df, gaps, categoricals)
        wide = {(r["column"], r["feature"]): r["spread"] for r in spread.where(F.col("spread") >= limits.spread).collect()}
        if wide:
            cells = ev.group_rates(df, sorted({c for c, _ in wide}), sorted({f for _, f in wide}))
            for r in cells.collect():  # at most 50 levels for each pair that was kept
                if (r["column"], r["feature"]) in wide:
                    rates.setdefault((r["column"], r["feature"]), []).append((r["level"], r["n"], r["n_missing"]))
    beside: dict[str, list[dict]] = {}
    if partly and numerics:
        for r in ev.indicator_correlations(df, partly, numerics).collect():
            beside.setdefault(r["column"], []).append({"feature": r["feature"], "correlation": round(r["r"], 4)})
    for found in beside.values():
        found.sort(key=lambda x: (-abs(x["correlation"]), x["feature"]))
    if pairs is None:
        cats = [p["column"] for p in profiles if p["dtype_category"] == "categorical" and p["n_missing"] >= 5 and p["column"] in categorical_columns(df)]
        nums = numeric_columns(df)
        pairs = [r.asDict() for r in ev.structural_pairs(df, cats, nums).collect()] if cats and nums else []
    structural: dict[str, str] = {}
    for p in pairs:
        structural.setdefault(p["categorical_col"], p["pattern"])
        structural.setdefault(p["numeric_col"], p["pattern"])
    out = []
    for p in profiles:
        c = p["column"]
        groups = sorted((_group(f, wide[c, f], x) for (col, f), x in rates.items() if col == c), key=lambda g: (-g["correlation"], g["feature"]))
        significant = any(g["p_value"] is None or g["p_value"] < limits.alpha for g in groups)
        more = {}
        if c in partly and c != target:
            lr = ev.logistic_lr(df, c, [x for x in numerics if x != c]) if [x for x in numerics if x != c] else None
            more["mar_p"] = lr["p_value"] if lr else None
            if target and target in df.columns:
                more |= _target(df, c, target)
        out.append(Evidence(
            c, p["dtype_category"] == "numeric", p["n_missing"], p["missing_rate"], p["is_high_cardinality"], c == target, structural.get(c),
            groups[0]["feature"] if groups else None, significant, max_r=abs(beside[c][0]["correlation"]) if c in beside else 0.0,
            groups=tuple(groups), correlated=tuple(beside.get(c, ())[:5]), limits=limits, **more,
        ))
    return out


def _group(feature: str, spread: float, levels: list[tuple[str, int, int]]) -> dict:
    """The evidence of one feature: the spread, its test, and the rates of its levels of five rows or more."""
    test = stats.chi2_independence([[m for _, _, m in levels], [n - m for _, n, m in levels]])
    shares = {level: m / n for level, n, m in sorted(levels) if n >= ev.MIN_GROUP}
    return {
        "feature": feature, "correlation": round(spread, 4), "p_value": round(test["p_value"], 6) if test else None, "chi2_statistic": round(test["statistic"], 4) if test else None,
        "high_missing_groups": {k: round(r, 3) for k, r in shares.items() if r >= 0.5}, "all_group_rates": {k: round(r, 3) for k, r in shares.items()},
    }


def _target(df: DataFrame, column: str, target: str) -> dict:
    if target in numeric_columns(df):
        row = ev.point_biserial(df, column, target).first()
        if row is None or row["r"] is None:
            return {}
        return {"target_p": round(stats.correlation_p(row["r"], row["n"]), 6), "target_effect": round(row["r"], 4)}
    table = ev.contingency(df, column, target)
    test = ev.chi2_frame(table).first()
    classes = table.groupBy("level").agg(F.sum("n").alias("n"), F.sum(F.col("missing") * F.col("n")).alias("n_missing")).where(F.col("n") >= ev.MIN_GROUP)
    share = F.col("n_missing") / F.col("n")
    wide = classes.agg(F.count(F.lit(1)).alias("k"), (F.max(share) - F.min(share)).alias("spread")).first()
    return {"target_p": round(chi2_sf(test["statistic"], test["df"]), 6) if test else None, "target_effect": round(wide["spread"], 4) if wide["k"] > 1 else None}


def _told(e: Evidence) -> dict:
    """The evidence on a column as plain values."""
    plain = {k: v for k, v in e.__dict__.items() if k not in ("groups", "correlated", "limits")}
    more = {"categorical_correlated_features": list(e.groups), "correlated_features": list(e.correlated), "mechanism_evidence": evidence_lines(e)}
    return {**plain, "mechanism_label": mechanism_label(e), "mar_robustness_note": robustness_note(e), "target_signal": e.target_signal, "driving_test": driving_test(e), **more}


class Audit:
    """``run`` gives all findings; ``fit`` an imputer; ``save`` writes files.

    ``domain_tags`` maps columns to tags; temporal ones ask for filling in ``order_by``.
    ``limits`` holds the thresholds of the decisions.
    """

    def __init__(self, df: DataFrame, predict: DataFrame | None = None, *, target: str | None = None, domain_tags: dict[str, str] | None = None, order_by: list[str] | None = None, partition_by: list[str] | None = None, compat_rounding: bool = False, limits: Limits = DEFAULT):
        self.limits = limits
        self.df, self.predict = normalise(df), normalise(predict) if predict is not None else None
        self.target, self.domain_tags, self.order_by, self.partition_by, self.compat = target, domain_tags or {}, order_by, partition_by, compat_rounding
        self.results: dict | None = None

    def run(self) -> dict:
        df = self.df
        profiles = [r.asDict() for r in profile(df, self.predict, self.target).orderBy("position").collect()]
        cats = [p["column"] for p in profiles if p["dtype_category"] == "categorical" and p["n_missing"] >= 5 and p["column"] in categorical_columns(df)]
        nums = numeric_columns(df)
        pairs = [r.asDict() for r in ev.structural_pairs(df, cats, nums).collect()] if cats and nums else []
        found = mechanism(df, self.target, profiles, pairs, self.limits)
        plan = make_plan(found, self.domain_tags, self.compat)
        self.results = {
            "profile": {"columns": {p["column"]: {**p, "missing_rate": round(p["missing_rate"], 4)} for p in profiles}, "summary": summary(df).first().asDict()},
            "mechanism": {"columns": {e.column: _told(e) for e in found if e.n_missing}, "little_mcar_test": ev.little_mcar(df)},
            "structural": {"pairs": pairs, "n_structural_pairs": len(pairs)},
            "plan": plan,
            "leakage": leakage_findings(plan),
        }
        return self.results

    def fit(self, plan: dict | None = None):
        """Statistics of the training table for a plan (the audit's own by default)."""
        plan = plan or (self.results or self.run())["plan"]
        return PlanImputer.from_plan(plan, order_by=self.order_by, partition_by=self.partition_by).fit(self.df)

    def impute(self, plan: dict | None = None) -> DataFrame | tuple[DataFrame, DataFrame]:
        fitted = self.fit(plan)
        done = fitted.transform(self.df)
        return (done, fitted.transform(self.predict)) if self.predict is not None else done

    def save(self, folder: str, sources: dict[str, str] | None = None, m: int = 5, key: list[str] | None = None) -> dict:
        """Write logs, report and script below ``folder``; returns the inference results."""
        from ..operators.chained import pool_means
        from ..operators.sensitivity import tipping
        from ..sources.files import write_json
        from .report import report_md
        from .script import emit_script

        r = self.results or self.run()
        plan = r["plan"]["columns"]
        nums = [c for c in numeric_columns(self.df, self.target) if 0 < r["profile"]["columns"][c]["n_missing"] < r["profile"]["columns"][c]["n_total"]]
        flagged = [c for c in nums if plan[c]["mi_upgrade_recommended"]] or nums
        more = {
            "mice_pooling": pool_means(self.df, nums, self.target, m, key=key) if nums else [],
            "mnar_sensitivity": [x.asDict() for x in tipping(self.df, flagged).collect()] if flagged else [],
        }
        names = {"missingness_profile": r["profile"], "missingness_mechanism_audit": r["mechanism"], "structural_missingness_audit": r["structural"], "imputation_plan": r["plan"], "leakage_report": r["leakage"], **more}
        for part in ("logs", "reports", "figures"):
            os.makedirs(f"{folder}/{part}", exist_ok=True)
        for name, value in names.items():
            write_json(value, f"{folder}/logs/{name}.json")
        with open(f"{folder}/reports/missingness_report.md", "w") as f:
            f.write(report_md(r, more))
        emit_script(r["plan"], self.fit(), (sources or {}).get("data", "data.csv"), f"{folder}/reproduce.py", self.target)
        return more


def recommend(df: DataFrame, target: str | None = None) -> dict:
    """The plan alone."""
    return make_plan(mechanism(df, target))


