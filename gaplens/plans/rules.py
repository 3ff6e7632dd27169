"""Decision rules over evidence: no data access, plain values in and out."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """The thresholds of the decisions."""

    alpha: float = 0.05
    few_missing: int = 20
    spread: float = 0.20  # range of missing rates over groups
    target_effect: float = 0.10
    pair_r: float = 0.15
    drop_over: float = 0.80
    some_rate: float = 0.10
    mi_rate: float = 0.25
    mi_r: float = 0.40


DEFAULT = Limits()
#: Names of the labels.
LABELS = ("insufficient evidence", "group-dependent missingness", "target-associated missingness", "MAR-like evidence", "MCAR-compatible")
#: Domain tags that ask for filling in time order.
TEMPORAL_TAGS = frozenset({"weather_metric", "sensor_reading", "time_series_metric", "physiological_measurement", "environmental_metric", "financial_time_series", "temporal_measurement"})


@dataclass(frozen=True)
class Evidence:
    """What is known about one column."""

    column: str
    numeric: bool
    n_missing: int
    missing_rate: float
    high_cardinality: bool = False
    is_target: bool = False
    structural: str | None = None
    group: str | None = None  # the feature with the largest spread
    group_significant: bool = False
    target_p: float | None = None
    target_effect: float | None = None
    mar_p: float | None = None
    max_r: float = 0.0
    groups: tuple[dict, ...] = ()  # features whose groups differ, the widest first
    correlated: tuple[dict, ...] = ()  # numbers that go with the gaps, the strongest first
    limits: Limits = DEFAULT

    @property
    def target_signal(self) -> bool:
        if self.target_p is not None:
            return self.target_p < self.limits.alpha
        return self.target_effect is not None and abs(self.target_effect) >= self.limits.target_effect

    @property
    def mar_signal(self) -> bool:
        return self.mar_p < self.limits.alpha if self.mar_p is not None else self.max_r >= self.limits.pair_r


def mechanism_label(e: Evidence) -> str:
    """First match wins."""
    signals = (e.group_significant, e.target_signal, e.mar_signal)
    if e.n_missing < e.limits.few_missing and not any(signals):
        return LABELS[0]
    return next((label for label, hit in zip(LABELS[1:], signals) if hit), LABELS[4])


def robustness_note(e: Evidence) -> str:
    """How much a wrong mechanism might matter."""
    if e.missing_rate >= e.limits.mi_rate or e.max_r >= e.limits.mi_r:
        return "mechanism_assumption_may_matter_consider_full_mi"
    if mechanism_label(e) == LABELS[4]:
        return "likely_robust_per_collins2001"
    return "insufficient_evidence_to_assess"


def effective_label(e: Evidence) -> str:
    if e.structural:
        return "structural missingness"
    if e.high_cardinality and not e.numeric:
        return "high-cardinality categorical"
    return mechanism_label(e)


def strategy(e: Evidence, tag: str | None = None, compat_rounding: bool = False) -> tuple[str, bool, str]:
    """(strategy, add an indicator, reason); first match wins.

    A column is complete when nothing is missing; ``compat_rounding`` decides on the rate
    rounded to four places instead.
    """
    rate, label = e.missing_rate, mechanism_label(e)
    none = round(rate, 4) == 0 if compat_rounding else e.n_missing == 0
    grouped = label == LABELS[1]
    ladder = (
        (e.is_target, "no_imputation_needed", False, "the target is never filled"),
        (none, "no_imputation_needed", False, "complete"),
        (rate > e.limits.drop_over, "drop_column", False, "over 80 % missing"),
        (e.structural is not None and e.numeric and e.structural != "co_missing_structural", "structural_zero_plus_indicator", True, "absent by structure"),
        (e.structural is not None and not e.numeric, "structural_none_token_plus_indicator", True, "absent by structure"),
        (e.numeric and grouped and e.group is not None, "groupwise_numeric_median_plus_indicator", True, "missingness differs by group"),
        (e.numeric and tag in TEMPORAL_TAGS, "time_series_ffill_bfill_plus_indicator", True, "ordered in time"),
        (e.numeric and (label in LABELS[2:4] or e.target_signal or rate >= e.limits.some_rate), "numeric_median_plus_indicator", True, "missingness carries a signal or is common"),
        (e.numeric, "numeric_median", False, "few values missing without a signal"),
        (e.high_cardinality, "categorical_missing_token_plus_indicator", True, "too many levels to guess one"),
        (grouped, "categorical_missing_token_plus_indicator", True, "missingness differs by group"),
        (rate >= e.limits.some_rate, "categorical_missing_token_plus_indicator", True, "missingness is common"),
        (True, "categorical_missing_token", False, "few values missing"),
    )
    return next((name, flag, why) for hit, name, flag, why in ladder if hit)


#: The decisions as SQL over an evidence table. Its columns are named as in ``Evidence``, with ``is_numeric``,
#: ``group_col`` and ``temporal``; each step needs the columns of those before it.
SIGNALS_SQL = f"""coalesce(target_p < {DEFAULT.alpha}, abs(target_effect) >= {DEFAULT.target_effect}, FALSE) AS target_signal,
  coalesce(mar_p < {DEFAULT.alpha}, max_r >= {DEFAULT.pair_r}) AS mar_signal"""
LABEL_SQL = f"""CASE WHEN n_missing < {DEFAULT.few_missing} AND NOT group_significant AND NOT target_signal AND NOT mar_signal THEN '{LABELS[0]}'
  WHEN group_significant THEN '{LABELS[1]}' WHEN target_signal THEN '{LABELS[2]}' WHEN mar_signal THEN '{LABELS[3]}' ELSE '{LABELS[4]}' END"""
EFFECTIVE_SQL = "CASE WHEN structural IS NOT NULL THEN 'structural missingness' WHEN high_cardinality AND NOT is_numeric THEN 'high-cardinality categorical' ELSE label END"
NOTE_SQL = f"""CASE WHEN missing_rate >= {DEFAULT.mi_rate} OR max_r >= {DEFAULT.mi_r} THEN 'mechanism_assumption_may_matter_consider_full_mi'
  WHEN label = '{LABELS[4]}' THEN 'likely_robust_per_collins2001' ELSE 'insufficient_evidence_to_assess' END"""
MI_SQL = f"n_missing > 0 AND NOT is_target AND (missing_rate >= {DEFAULT.mi_rate} OR target_signal OR label IN ('{LABELS[1]}', '{LABELS[2]}') OR max_r >= {DEFAULT.mi_r})"
STRATEGY_SQL = f"""CASE
  WHEN is_target OR n_missing = 0 THEN 'no_imputation_needed'
  WHEN missing_rate > {DEFAULT.drop_over} THEN 'drop_column'
  WHEN structural IS NOT NULL AND is_numeric AND structural <> 'co_missing_structural' THEN 'structural_zero_plus_indicator'
  WHEN structural IS NOT NULL AND NOT is_numeric THEN 'structural_none_token_plus_indicator'
  WHEN is_numeric AND label = '{LABELS[1]}' AND group_col IS NOT NULL THEN 'groupwise_numeric_median_plus_indicator'
  WHEN is_numeric AND temporal THEN 'time_series_ffill_bfill_plus_indicator'
  WHEN is_numeric AND (label IN ('{LABELS[2]}', '{LABELS[3]}') OR target_signal OR missing_rate >= {DEFAULT.some_rate}) THEN 'numeric_median_plus_indicator'
  WHEN is_numeric THEN 'numeric_median'
  WHEN high_cardinality OR label = '{LABELS[1]}' OR missing_rate >= {DEFAULT.some_rate} THEN 'categorical_missing_token_plus_indicator'
  ELSE 'categorical_missing_token' END"""


def recommend_mi(e: Evidence) -> bool:
    """Whether full multiple imputation is advised."""
    if e.n_missing == 0 or e.is_target:
        return False
    return e.missing_rate >= e.limits.mi_rate or e.target_signal or mechanism_label(e) in LABELS[1:3] or e.max_r >= e.limits.mi_r


def make_plan(evidence: list[Evidence], domain_tags: dict[str, str] | None = None, compat_rounding: bool = False) -> dict:
    """The declarative plan: a strategy for every column, and a summary."""
    columns = {}
    for e in evidence:
        name, flag, why = strategy(e, (domain_tags or {}).get(e.column), compat_rounding)
        columns[e.column] = {
            "strategy": name, "add_missing_indicator": flag, "reason": why, "fit_on": "train_only", "missing_rate": round(e.missing_rate, 4),
            "dtype": "numeric" if e.numeric else "categorical", "cardinality": "high" if e.high_cardinality else "normal", "mechanism_label": effective_label(e),
            "mar_robustness_note": robustness_note(e), "group_col": e.group if name.startswith("groupwise") else None, "mi_upgrade_recommended": recommend_mi(e),
            "safety_warning": "high missing rate" if e.missing_rate > 0.5 else None,
        }
    return {"columns": columns, "summary": plan_summary(columns)}


def plan_summary(columns: dict) -> dict:
    counts: dict[str, int] = {}
    for p in columns.values():
        counts[p["strategy"]] = counts.get(p["strategy"], 0) + 1
    return {
        "strategy_counts": dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))),
        "columns_needing_missing_indicator": [c for c, p in columns.items() if p["add_missing_indicator"]],
        "n_columns_to_impute": sum(p["strategy"] != "no_imputation_needed" for p in columns.values()),
        "columns_where_full_mi_recommended": [c for c, p in columns.items() if p["mi_upgrade_recommended"]],
    }


def leakage_findings(plan: dict, normalise_aliases: bool = False) -> dict:
    """The risk that each strategy carries test data into training."""
    found = []
    for c, p in plan["columns"].items():
        name = p["strategy"]
        model = name == "model_based_imputation_optional" or (normalise_aliases and name == "mice_multiple_imputation")
        if name in ("no_imputation_needed", "drop_column"):
            risk, note = "none", "nothing is fitted"
        elif model:
            risk, note = "medium", "a model is fitted on other columns; fit it on training rows alone"
        elif p.get("fit_on") == "train_only":
            risk, note = "low", "statistics come from training rows"
        else:
            risk, note = "high", "statistics may come from rows to predict"
        found.append({"column": c, "strategy": name, "leakage_risk": risk, "leakage_note": note, "recommendation": "fit on training rows only" if risk in ("medium", "high") else "none needed"})
    count = lambda *risks: sum(f["leakage_risk"] in risks for f in found)
    return {"findings": found, "summary": {"high_leakage_risk": count("high"), "medium_leakage_risk": count("medium"), "low_or_no_leakage_risk": count("low", "none")}}


def mice_method(numeric: bool, unique_count: int | None, ordered: bool = False) -> str:
    """The method a multiple-imputation package would take for a column; ``polyr`` for levels with an order."""
    if numeric:
        return "pmm"
    return "logreg" if unique_count == 2 else "polyr" if ordered else "polyreg"


def evidence_lines(e: Evidence) -> list[str]:
    """What speaks for a column's label, in words."""
    out = []
    for g in e.groups[:3]:
        tested = "" if g["p_value"] is None else f", chi-squared {g['chi2_statistic']:.4g}, p = {g['p_value']:.4g}"
        worst = ", ".join(f"{k} {r:.0%}" for k, r in sorted(g["high_missing_groups"].items(), key=lambda x: (-x[1], x[0]))[:5])
        out.append(f"missing rates differ by {g['correlation']:.0%} over {g['feature']}{tested}" + (f"; mostly missing in {worst}" if worst else ""))
    if e.target_p is not None or e.target_effect is not None:
        size = "" if e.target_effect is None else f", effect {e.target_effect:.3g}"
        out.append("missingness against the target" + size + ("" if e.target_p is None else f", p = {e.target_p:.4g}"))
    if e.mar_p is not None:
        out.append(f"missingness on the other numbers, likelihood ratio: p = {e.mar_p:.4g}")
    out += [f"correlation with {c['feature']}: {c['correlation']:.3f}" for c in e.correlated[:3]]
    return out or ["no feature goes with the gaps"]


def driving_test(e: Evidence) -> dict:
    """The test that led to a label."""
    label = mechanism_label(e)
    group_p = next((g["p_value"] for g in e.groups if g["feature"] == e.group), None)
    shown = {LABELS[1]: ("chi_squared", group_p), LABELS[2]: ("target_association", e.target_p), LABELS[3]: ("logistic_likelihood_ratio", e.mar_p)}
    test, p = shown.get(label, ("none", None))
    return {"test": test, "p_value": p}


def insight_cards(summary: dict, plan: dict, little: dict | None = None) -> list[str]:
    """Short statements for an overview: profile, mechanisms, structure and plan."""
    out = [f"{summary['columns_with_any_missing']} of {summary['total_columns']} columns have missing values; {summary['overall_missing_rate']:.1%} of all cells are missing."]
    gaps = {c: p for c, p in plan["columns"].items() if p["missing_rate"] > 0}
    if gaps:
        worst = max(gaps, key=lambda c: (gaps[c]["missing_rate"], c))
        out.append(f"Most is missing in {worst}: {gaps[worst]['missing_rate']:.1%}.")
        common = [c for c, p in gaps.items() if p["missing_rate"] >= DEFAULT.some_rate]
        out.append(f"{len(common)} columns miss a tenth of their values or more." if common else "No column misses a tenth of its values.")
    for label, words in ((LABELS[1], "Gaps differ between groups in"), (LABELS[2], "Gaps go with the target in"), (LABELS[3], "Gaps go with other numbers in"), (LABELS[4], "Nothing speaks against random gaps in")):
        named = [c for c, p in gaps.items() if p["mechanism_label"] == label]
        if named:
            out.append(f"{words} {', '.join(named)}.")
    flagged = plan["summary"]["columns_needing_missing_indicator"]
    if flagged:
        out.append(f"Indicators of missing values are planned for {', '.join(flagged)}.")
    dropped = [c for c, p in plan["columns"].items() if p["strategy"] == "drop_column"]
    if dropped:
        out.append(f"Over 80 % is missing in {', '.join(dropped)}; the plan drops them.")
    structural = [c for c, p in plan["columns"].items() if p["mechanism_label"] == "structural missingness"]
    if structural:
        out.append(f"Values are absent by structure in {', '.join(structural)}.")
    if plan["summary"]["columns_where_full_mi_recommended"]:
        out.append(f"Multiple imputation is advised for {', '.join(plan['summary']['columns_where_full_mi_recommended'])}.")
    if little and little.get("applicable"):
        out.append(f"Little's test: {little['interpretation']} (p = {little['p_value']:.4f}).")
    return out


def severity_caption(rates: dict[str, float]) -> str:
    """A caption for the chart of missing rates."""
    if not rates:
        return "No values are missing."
    worst = max(rates, key=lambda c: (rates[c], c))
    high, some = sum(r >= 0.80 for r in rates.values()), sum(0.20 <= r < 0.80 for r in rates.values())
    out = f"{len(rates)} columns have missing values, most of all {worst} ({rates[worst]:.1%})."
    if high:
        out += f" {high} miss 80 % or more, too much to fill."
    return out + (f" {some} lie between 20 and 80 % and {len(rates) - high - some} below: fill them and keep an indicator." if some else " All others lie below 20 %: medians will mostly do." if high else " All lie below 20 %: medians will mostly do.")


def pattern_caption(share_any: float, share_multi: float) -> str:
    """A caption for the pattern matrix."""
    out = f"{share_any:.1%} of rows have a missing value"
    return f"{out}; {share_multi:.1%} miss two or more at once, which speaks against independent gaps." if share_multi > 0.05 else f"{out}; few miss two at once, as independent gaps would."


def target_caption(effects: dict[str, float], least: float = 0.10) -> str:
    """A caption for the target split; ``effects`` are differences of means in standard deviations."""
    strong = sorted((c for c, d in effects.items() if abs(d) >= least), key=lambda c: (-abs(effects[c]), c))
    return f"The target differs by {least:.2f} standard deviations or more where {', '.join(strong)} is missing." if strong else "The target hardly differs where values are missing."


def decision_flow(plan: dict) -> list[tuple[str, int]]:
    """How many columns reach each step of the decisions."""
    columns = plan["columns"].values()
    rows = [("columns", len(plan["columns"])), ("with_missing", sum(p["missing_rate"] > 0 for p in columns)), ("dropped", sum(p["strategy"] == "drop_column" for p in columns))]
    rows += [("structural", sum(p["strategy"].startswith("structural") for p in columns)), ("imputed", sum(p["strategy"] not in ("drop_column", "no_imputation_needed") for p in columns))]
    return [*rows, ("with_indicator", sum(bool(p["add_missing_indicator"]) for p in columns)), ("mi_recommended", sum(bool(p["mi_upgrade_recommended"]) for p in columns))]
