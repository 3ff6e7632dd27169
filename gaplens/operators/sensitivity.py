"""How results move if missing values are not missing at random, and how imputation moved a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tails import ks_two_sided
from .columns import missing, normalise, number, q
from .ranges import medians

#: Shifts in standard deviations.
DELTAS = (-2.0, -1.5, -1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
FRAGILE = 0.5


def trajectory(df: DataFrame, column: str, deltas: tuple[float, ...] = DELTAS) -> DataFrame:
    """(delta, mean, outside_ci): the mean if missing values were median + delta sd, in closed form.

    No row with under two observed values or none missing.
    """
    seen = F.when(~missing(df, column), number(column))
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count(seen).alias("n_observed"), F.avg(seen).alias("cc_mean"), F.stddev_samp(seen).alias("sd"))
    one = one.where("n_observed >= 2 AND n_observed < n").crossJoin(medians(df, seen).select(F.col("m").alias("median")))  # one row each
    rows = one.withColumn("delta", F.explode(F.array(*(F.lit(float(d)) for d in deltas))))
    mean = (F.col("n_observed") * F.col("cc_mean") + (F.col("n") - F.col("n_observed")) * (F.col("median") + F.col("delta") * F.col("sd"))) / F.col("n")
    half = 1.96 * F.col("sd") / F.sqrt("n_observed")
    return rows.select(
        "delta", mean.alias("mean"), (F.abs(mean - F.col("cc_mean")) > half).alias("outside_ci"), "n", "n_observed", "sd", "cc_mean",
        (F.col("cc_mean") - half).alias("ci_low"), (F.col("cc_mean") + half).alias("ci_high"),
    )


def robustness(tip: Column) -> Column:
    return F.when(tip.isNull(), "robust").when(F.abs(tip) <= FRAGILE, "fragile").otherwise("moderately_robust")


def tipping(df: DataFrame, columns: list[str], deltas: tuple[float, ...] = DELTAS) -> DataFrame:
    """(column, ..., tipping_point, robustness): the smallest shift that leaves the interval; of two equal ones, the negative."""
    out = None
    for c in columns:
        t = trajectory(df, c, deltas)
        moved = F.when((F.col("delta") != 0) & F.col("outside_ci"), F.struct(F.abs("delta").alias("a"), F.col("delta")))
        row = t.agg(
            F.first("n").alias("n"), F.first("n_observed").alias("n_observed"), F.first("sd").alias("observed_sd"), F.first("cc_mean").alias("complete_case_mean"),
            F.first("ci_low").alias("ci_low"), F.first("ci_high").alias("ci_high"), F.min(moved)["delta"].alias("tipping_point"),
        ).where("n IS NOT NULL").withColumn("robustness", robustness(F.col("tipping_point"))).select(F.lit(c).alias("column"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def fragile_first(df: DataFrame, columns: list[str], most: int = 4) -> DataFrame:
    """The columns whose conclusions tip soonest, for a chart of a few panels."""
    return tipping(df, columns).orderBy(F.abs("tipping_point").asc_nulls_last(), "column").limit(most)


def before_after(before: DataFrame, after: DataFrame, column: str, ddof: int = 0) -> DataFrame:
    """(stage, n, n_missing, mean, median, std, min, max) of a number before and after imputation."""
    out = None
    for name, df in (("before", before), ("after", after)):
        v = F.when(~missing(df, column), number(column))
        std = F.stddev_samp(v) if ddof else F.stddev_pop(v)
        row = df.agg(F.count(v).alias("n"), F.count_if(missing(df, column)).alias("n_missing"), F.avg(v).alias("mean"), std.alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
        row = row.join(F.broadcast(medians(df, v).select(F.col("m").alias("median"))), F.lit(True), "left")  # one row each
        row = row.select(F.lit(name).alias("stage"), "n", "n_missing", "mean", "median", "std", "min", "max")
        out = row if out is None else out.unionByName(row)
    return out


def ks_statistic(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row (n, m, statistic): the largest gap between two empirical distributions.

    Both are counted by value first, then by ranges of values, so that running totals
    within a range and over ranges never meet in one large task.
    """
    one = lambda df, k: normalise(df).where(~missing(df, column)).groupBy(number(column).alias("v")).agg(F.count(F.lit(1)).alias("c")).select("v", F.when(F.lit(k == 0), F.col("c")).otherwise(0).alias("a"), F.when(F.lit(k == 1), F.col("c")).otherwise(0).alias("b"))
    steps = one(a, 0).unionByName(one(b, 1)).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ends = steps.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    part = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * 1024)).otherwise(0)
    dealt = steps.crossJoin(ends).withColumn("part", part.cast("int"))  # ends is one row
    from pyspark.sql import Window

    sums = dealt.groupBy("part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    w = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 1025 rows
    base = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("pa").over(w), F.lit(0)).alias("oa"), F.coalesce(F.sum("pb").over(w), F.lit(0)).alias("ob"))
    own = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    runs = dealt.withColumn("ra", F.sum("a").over(own)).withColumn("rb", F.sum("b").over(own)).join(F.broadcast(base), F.col("part") == F.col("p"))
    gap = F.abs((F.col("ra") + F.col("oa")) / F.col("n") - (F.col("rb") + F.col("ob")) / F.col("m"))
    return runs.agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max(gap).alias("statistic"))


def numeric_alerts(before: DataFrame, after: DataFrame, column: str) -> list[str]:
    """Drift alerts: mean moved over 10 %, spread under 80 %, distributions differ (KS, 5 %)."""
    rows = {r["stage"]: r for r in before_after(before, after, column).collect()}
    a, b = rows["before"], rows["after"]
    out = []
    if a["mean"] and abs(b["mean"] - a["mean"]) / abs(a["mean"]) > 0.10:
        out.append(f"{column}: the mean moved by over 10 %")
    if a["std"] and b["std"] / a["std"] < 0.80:
        out.append(f"{column}: the spread fell below 80 %")
    ks = ks_statistic(before, after, column).first()
    if ks["n"] and ks["m"] and ks_two_sided(ks["statistic"], ks["n"], ks["m"]) < 0.05:
        out.append(f"{column}: the distribution differs")
    return out


def categorical_alerts(before: DataFrame, after: DataFrame, column: str, token: str = "MISSING") -> list[str]:
    """Drift alerts: the token holds over 30 %, or the commonest value more than doubled to over 30 %; shares are of all observed rows."""
    values = lambda df: df.where(~missing(df, column)).select(F.col(q(column)).cast("string").alias("v"))
    totals = lambda df, v: values(df).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == F.lit(v)).alias("held")).first()
    out = []
    b = totals(after, token)
    if b["n"] and b["held"] / b["n"] > 0.30:
        out.append(f"{column}: over 30 % are {token}")
    commonest = values(after).groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").first()
    top = commonest["v"] if commonest else None
    if top is not None and top != token and commonest["n"] / b["n"] > 0.30:
        a = totals(before, top)
        if a["n"] and commonest["n"] / b["n"] > 2 * a["held"] / a["n"]:
            out.append(f"{column}: {top} more than doubled")
    return out
