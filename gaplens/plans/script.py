"""A standalone PySpark script that repeats a fitted imputation and verifies itself."""

from __future__ import annotations

import pprint

_BODY = '''"""Applies fitted imputation values to a table; needs nothing but PySpark."""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

STEPS = {steps}
TARGET = {target!r}


def apply_steps(df):
    for s in STEPS:
        c, name = s["column"], s["strategy"]
        if c not in df.columns or name == "no_imputation_needed":
            continue
        if name == "drop_column":
            df = df.drop(c)
            continue
        col = F.col("`" + c + "`")
        gone = col.isNull() | F.isnan(col) if dict(df.dtypes)[c] in ("double", "float") else col.isNull()
        if s["add_missing_indicator"] or name.endswith("_plus_indicator"):
            df = df.withColumn(c + "_was_missing", gone.cast("int"))
        value = F.lit(s["value"])
        if s["groups"]:
            cases = F.lit(None).cast("double")
            for group, median in s["groups"].items():
                cases = F.when(F.col("`" + s["group_col"] + "`") == F.lit(group), F.lit(median)).otherwise(cases)
            value = F.coalesce(cases, value)
        if s["value"] is not None:
            df = df.withColumn(c, F.when(gone, value).otherwise(col))
    return df


def verify(before, after):
    bad = []
    for s in STEPS:
        c = s["column"]
        if s["strategy"] == "drop_column":
            bad += [c + " is still there"] if c in after.columns else []
        elif s["value"] is not None and c in after.columns and after.where(F.col("`" + c + "`").isNull()).limit(1).count():
            bad.append(c + " still has missing values")
    for c in after.columns:
        if c.endswith("_was_missing") and after.where(~F.col("`" + c + "`").isin(0, 1)).limit(1).count():
            bad.append(c + " is not an indicator")
    if TARGET and TARGET in before.columns:
        counts = lambda d: d.agg(F.count(F.lit(1)), F.count(TARGET), F.sum(F.xxhash64(TARGET).cast("decimal(38,0)"))).first()  # noqa: E731
        if counts(before) != counts(after):
            bad.append("the target changed")
    return bad


if __name__ == "__main__":
    source, out = (sys.argv[1:] + [{source!r}, "imputed"])[:2] if len(sys.argv) < 3 else sys.argv[1:3]
    spark = SparkSession.builder.getOrCreate()
    table = spark.read.csv(source, header=True, inferSchema=True, nullValue="NA") if source.endswith(".csv") else spark.read.parquet(source)
    done = apply_steps(table)
    problems = verify(table, done)
    if problems:
        sys.exit("; ".join(problems))
    done.write.mode("overwrite").csv(out, header=True)
'''


def emit_script(plan: dict, fitted, source: str, path: str, target: str | None = None) -> str:
    """Write the script; model-based columns are reduced to their training median."""
    steps = fitted.describe()
    text = _BODY.replace("{steps}", pprint.pformat(steps, width=120)).replace("{target!r}", repr(target)).replace("{source!r}", repr(source))
    with open(path, "w") as f:
        f.write(text)
    return path
