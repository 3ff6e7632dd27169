"""Markdown report and text summary of an audit."""

from __future__ import annotations

from .rules import decision_flow, insight_cards, mice_method, severity_caption


def _table(head: list[str], rows: list[list]) -> str:
    line = lambda xs: "| " + " | ".join(str(x) for x in xs) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def _num(x, digits: int = 4) -> str:
    return "-" if x is None else f"{x:.{digits}g}" if isinstance(x, float) else str(x)


def report_md(results: dict, more: dict | None = None) -> str:
    """The report; ``more`` holds pooled means and sensitivity, if computed."""
    s, plan, more = results["profile"]["summary"], results["plan"], more or {}
    out = ["# Missing data report", "", "## Overview", ""]
    out += [f"- {x}" for x in insight_cards(s, plan, results["mechanism"]["little_mcar_test"])]
    out += ["", "Labels are clues from observed data; they do not prove a cause."]
    gaps = sorted((p for p in results["profile"]["columns"].values() if p["n_missing"]), key=lambda p: -p["missing_rate"])
    out += ["", "## Profile", "", _table(["column", "type", "missing", "rate", "severity"], [[p["column"], p["dtype_category"], p["n_missing"], f"{p['missing_rate']:.1%}", p["severity"]] for p in gaps])]
    out += ["", severity_caption({p["column"]: p["missing_rate"] for p in gaps})]
    rows = [[c, e["mechanism_label"], _num(e["mar_p"]), _num(e["target_p"]), _num(e["max_r"])] for c, e in results["mechanism"]["columns"].items()]
    out += ["", "## Mechanism", "", _table(["column", "label", "p (other numbers)", "p (target)", "largest r"], rows)]
    for c, e in results["mechanism"]["columns"].items():
        test = e["driving_test"]
        out += ["", f"### {c}", "", f"{e['mechanism_label']}; driving test: {test['test'].replace('_', ' ')}" + (f", p = {_num(test['p_value'])}" if test["p_value"] is not None else "") + f"; robustness: {e['mar_robustness_note'].replace('_', ' ')}.", ""]
        out += [f"- {line}" for line in e["mechanism_evidence"]]
    little = results["mechanism"]["little_mcar_test"]
    out += ["", f"Little's test: chi-squared {_num(little['statistic'])}, df {little['df']}, p = {_num(little['p_value'])}." if little["applicable"] else f"Little's test was not applicable: {little['reason']}."]
    pairs = results["structural"]["pairs"]
    if pairs:
        out += ["", "## Structural absence", "", _table(["categorical", "number", "pattern"], [[p["categorical_col"], p["numeric_col"], p["pattern"]] for p in pairs])]
    rows = [[c, p["strategy"], p["reason"], mice_method(p["dtype"] == "numeric", results["profile"]["columns"][c]["unique_count"])] for c, p in plan["columns"].items() if p["strategy"] != "no_imputation_needed"]
    out += ["", "## Plan", "", _table(["column", "strategy", "reason", "multiple-imputation method"], rows)]
    out += ["", "### Decisions", "", _table(["step", "columns"], [list(x) for x in decision_flow(plan)])]
    advised = plan["summary"]["columns_where_full_mi_recommended"]
    if advised:
        out += ["", "### Multiple imputation", "", _table(["column", "missing", "label", "note"], [[c, f"{plan['columns'][c]['missing_rate']:.1%}", plan["columns"][c]["mechanism_label"], plan["columns"][c]["mar_robustness_note"].replace("_", " ")] for c in advised])]
    warned = [(c, p["safety_warning"]) for c, p in plan["columns"].items() if p["safety_warning"]]
    out += ["", *(f"- {c}: {w}" for c, w in warned)] if warned else []
    lk = results["leakage"]["summary"]
    out += ["", "## Leakage", "", f"High {lk['high_leakage_risk']}, medium {lk['medium_leakage_risk']}, low or none {lk['low_or_no_leakage_risk']}.", ""]
    out += [f"- {f['column']} ({f['strategy']}): {f['leakage_note']}" for f in results["leakage"]["findings"] if f["leakage_risk"] != "none"]
    if more.get("mice_pooling"):
        rows = [[x["column"], _num(x["pooled_estimate"], 6), _num(x["std_error"]), _num(x["naive_se"]), _num(x["fraction_missing_information"])] for x in more["mice_pooling"]]
        out += ["", "## Pooled means", "", _table(["column", "mean", "standard error", "without between-imputation variance", "missing information"], rows)]
    if more.get("mnar_sensitivity"):
        rows = [[x["column"], _num(x["complete_case_mean"]), _num(x["tipping_point"]), x["robustness"]] for x in more["mnar_sensitivity"]]
        out += ["", "## Sensitivity", "", _table(["column", "complete-case mean", "tipping point (sd)", "robustness"], rows)]
    return "\n".join(out) + "\n"


def context_summary(results: dict) -> str:
    """All results in a few lines."""
    s = results["profile"]["summary"]
    lines = [f"rows {s['total_rows']}, columns {s['total_columns']}, missing cells {s['total_missing_cells']}"]
    lines += [f"{c}: {p['missing_rate']:.1%} missing, {p['mechanism_label']}, {p['strategy']}" for c, p in results["plan"]["columns"].items() if p["missing_rate"] > 0]
    return "\n".join(lines)
