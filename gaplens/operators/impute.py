"""Imputation as fitted statistics and a projection that applies them.

``fit`` reads training data only and returns ``Fitted``; its ``transform`` works on any
DataFrame, streaming ones too unless a column is filled in order. Group medians stay a
DataFrame and are joined; everything else becomes a literal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import SUFFIX, is_numeric, missing, normalise, number, q
from .ranges import medians, parts_of, with_range

MISSING, NONE = "MISSING", "NONE"
ALIASES = {"group_median": "groupwise_numeric_median", "mice_multiple_imputation": "model_based_imputation_optional"}
#: Strategies of the override menu in terms of the others.
OVERRIDES = {
    "mean": "numeric_mean", "median": "numeric_median", "mode": "categorical_mode", "knn": "knn", "mice": "model_based_imputation_optional", "groupwise": "groupwise_numeric_median",
    "missing_token": "categorical_missing_token", "none": "no_imputation_needed", "drop": "drop_column",
}
#: Which override a planned strategy becomes in that menu; indicators are lost on the way.
AS_OVERRIDE = {
    "no_imputation_needed": "none", "drop_column": "drop", "numeric_median": "median", "numeric_median_plus_indicator": "median", "groupwise_numeric_median_plus_indicator": "groupwise",
    "group_median": "groupwise", "time_series_ffill_bfill_plus_indicator": "median", "categorical_missing_token": "missing_token", "categorical_missing_token_plus_indicator": "missing_token",
    "categorical_mode_plus_indicator": "mode", "structural_none_token_plus_indicator": "missing_token", "structural_zero_plus_indicator": "median", "model_based_imputation_optional": "mice", "mice_multiple_imputation": "mice",
}


@dataclass
class Step:
    """What one column gets."""

    column: str
    strategy: str
    add_indicator: bool = False
    group_col: str | None = None
    value: object = None
    groups: DataFrame | None = None
    model: object = None


class Fitted(Model):
    """Fitted steps; a transformer that can stand in a machine-learning pipeline."""

    def __init__(self, steps: list[Step], order_by: list[str] | None = None, partition_by: list[str] | None = None):
        super().__init__()
        self.steps, self.order_by, self.partition_by = steps, order_by or [], partition_by or []

    def _transform(self, df: DataFrame) -> DataFrame:
        df = normalise(df)
        for s in self.steps:
            if s.column in df.columns:
                df = _apply(df, s, self)
        return df.drop(*(s.column for s in self.steps if s.strategy == "drop_column"))

    def describe(self) -> list[dict]:
        """The fitted numbers, for a file or a script; group medians are collected."""
        out = []
        for s in self.steps:
            groups = {r["g"]: r["m"] for r in s.groups.collect()} if s.groups is not None else None
            out.append({"column": s.column, "strategy": s.strategy, "add_missing_indicator": s.add_indicator, "group_col": s.group_col, "value": s.value, "groups": groups})
        return out


def exact_median(df: DataFrame, column: str) -> float | None:
    row = medians(df.where(~missing(df, column)), number(column)).first()
    return row["m"] if row else None


def group_medians(df: DataFrame, column: str, group: str) -> DataFrame:
    """(g, m): the median of each group that has one; null groups have none."""
    return medians(df.where(~missing(df, group) & ~missing(df, column)), number(column), F.col(q(group)))


def mode_of(df: DataFrame, column: str):
    """The most frequent value, the smallest of several."""
    counts = df.where(~missing(df, column)).groupBy(F.col(q(column)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v")).first()
    return row["v"]


def ordered_fill(df: DataFrame, column: str, order_by: list[str], partition_by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Forward, then backward fill in an explicit order.

    With ``partition_by`` each entity is filled by itself. Without, the order is cut into
    ranges of the keys, whatever their types, as many as the session has shuffle
    partitions (64 at least): each range is filled in its own task, and the last value
    before and the first after a range come from a table with one row for each range.
    """
    c = F.col(q(column))
    keys = [F.col(q(k)) for k in order_by]
    if not partition_by:
        return _ranged_fill(df, column, order_by, parts or parts_of(df))
    w = Window.partitionBy(*(F.col(q(k)) for k in partition_by))
    before, after = _nearest(c, w, keys)
    return df.withColumn(column, F.coalesce(before, after))


def _nearest(value, window, keys):
    """The last value at or before, and the first at or after a row. Both frames grow: one that shrinks is summed anew for every row."""
    ends = (Window.unboundedPreceding, 0)
    before = F.last(value, ignorenulls=True).over(window.orderBy(*keys).rowsBetween(*ends))
    after = F.last(value, ignorenulls=True).over(window.orderBy(*(k.desc_nulls_last() for k in keys)).rowsBetween(*ends))
    return before, after


def _ranged_fill(df: DataFrame, column: str, order_by: list[str], parts: int) -> DataFrame:
    names = df.columns
    dealt = df.select(F.struct(*(F.col(q(n)) for n in names)).alias("row"))
    dealt = with_range(dealt, [F.col("row").getField(k) for k in order_by], parts)
    value = F.col("row").getField(column)
    keys = [F.col("row").getField(k) for k in order_by]
    rank = F.struct(*keys)
    ends = dealt.groupBy("part").agg(F.max_by(value, F.when(value.isNotNull(), rank)).alias("last"), F.min_by(value, F.when(value.isNotNull(), rank)).alias("first"))
    w = Window.partitionBy(F.lit(0)).orderBy("part")  # one row for each range
    carry = ends.select(
        F.col("part").alias("p"), F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"),
        F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
    )
    before, after = _nearest(value, Window.partitionBy("part"), keys)
    full = dealt.withColumn("before", before).withColumn("after", after).join(F.broadcast(carry), F.col("part") == F.col("p"))
    filled = F.coalesce("before", "carry", "after", "next")
    return full.select(*(filled.alias(n) if n == column else F.col("row").getField(n).alias(n) for n in names))


def _tokens(strategy: str) -> str:
    return NONE if strategy.startswith("structural_none") else MISSING


def fit_step(df: DataFrame, s: Step, fitted: Fitted, seed: int = 0) -> Step:
    """Fit one column on training data that the earlier steps have been applied to."""
    s.strategy = ALIASES.get(s.strategy, s.strategy)
    name, c = s.strategy, s.column
    numeric = is_numeric(df, c, 1)
    if name == "numeric_mean":
        s.value = df.agg(F.avg(number(c))).first()[0] or 0.0
    elif name.startswith("numeric_median"):
        median = exact_median(df, c)
        s.value = 0.0 if median is None else median
    elif name.startswith("groupwise_numeric_median"):
        median = exact_median(df, c)
        s.value = 0.0 if median is None else median
        if s.group_col and s.group_col in df.columns:
            s.groups = group_medians(df, c, s.group_col)
    elif name.startswith("time_series"):
        if not fitted.order_by:
            raise ValueError(f"{c}: filling in order needs order_by")
        filled = ordered_fill(df, c, fitted.order_by, fitted.partition_by).select(q(c)).persist()  # a median looks twice
        median = exact_median(filled, c)
        filled.unpersist()
        s.value = 0.0 if median is None else median
    elif name.startswith("categorical_mode"):
        found = mode_of(df, c)
        s.value = (0.0 if numeric else MISSING) if found is None else found
    elif name.startswith(("categorical_missing_token", "structural_none_token")):
        s.value = _tokens(name)
    elif name == "structural_zero_plus_indicator":
        s.value = 0
    elif name == "structural_none_or_zero":
        s.value = 0 if numeric else NONE
    elif name == "model_based_imputation_optional":
        if numeric:
            from .chained import ChainedImputer
            from .columns import numeric_columns

            s.model = ChainedImputer(m=1, sample_posterior=False, seed=seed).fit(df, numeric_columns(df))
            median = exact_median(df, c)  # what a script without the model falls back to
            s.value = 0.0 if median is None else median
        else:
            s.value = MISSING
    elif name == "knn":
        s.model = df
    elif name not in ("no_imputation_needed", "drop_column"):
        raise ValueError(f"unknown strategy {name!r}")
    return s


def _apply(df: DataFrame, s: Step, fitted: Fitted) -> DataFrame:
    name, c = s.strategy, s.column
    if name in ("no_imputation_needed", "drop_column"):
        return df
    if s.add_indicator or name.endswith("_plus_indicator"):
        df = df.withColumn(c + SUFFIX, missing(df, c).cast("int"))
    col = F.col(q(c))
    if name.startswith("groupwise_numeric_median"):
        if s.groups is None:
            return df.withColumn(c, F.coalesce(col.cast("double"), F.lit(float(s.value))))
        names = df.columns
        rows = df.select(F.struct(*(F.col(q(n)) for n in names)).alias("row"))
        both = rows.join(s.groups, F.col("row").getField(s.group_col) == F.col("g"), "left")
        full = F.coalesce(F.col("row").getField(c).cast("double"), F.col("m"), F.lit(float(s.value)))
        return both.select(*(full.alias(n) if n == c else F.col("row").getField(n).alias(n) for n in names))
    if name.startswith("time_series"):
        df = ordered_fill(df, c, fitted.order_by, fitted.partition_by)
        return df.withColumn(c, F.coalesce(F.col(q(c)).cast("double"), F.lit(float(s.value))))
    if name == "knn":
        from .neighbours import knn_fill

        return knn_fill(df, s.model, [c])
    if s.model is not None:
        return s.model.fill(df, [c])
    if isinstance(s.value, str):
        return df.withColumn(c, F.coalesce(col.cast("string"), F.lit(s.value)))
    if name.startswith("structural"):
        return df.withColumn(c, F.coalesce(col, F.lit(s.value).cast(df.schema[c].dataType)))
    if isinstance(s.value, float):
        return df.withColumn(c, F.coalesce(col.cast("double"), F.lit(s.value)))
    return df.withColumn(c, F.coalesce(col, F.lit(s.value)))


class PlanImputer(Estimator):
    """Fits the steps of a plan on training data, in plan order: a later column sees earlier ones filled."""

    def __init__(self, steps: list[Step], order_by: list[str] | None = None, partition_by: list[str] | None = None, seed: int = 0):
        super().__init__()
        self.steps, self.order_by, self.partition_by, self.seed = steps, order_by or [], partition_by or [], seed

    @classmethod
    def from_plan(cls, plan: dict, **more) -> PlanImputer:
        return cls([Step(c, p["strategy"], bool(p.get("add_missing_indicator")), p.get("group_col")) for c, p in plan["columns"].items()], **more)

    def _fit(self, train: DataFrame) -> Fitted:
        df = normalise(train)
        out = Fitted([], self.order_by, self.partition_by)
        for s in self.steps:
            if s.column not in df.columns:
                continue
            done = fit_step(df, Step(s.column, s.strategy, s.add_indicator, s.group_col), out, self.seed)
            out.steps.append(done)
            df = _apply(df, done, out)
        return out


def fill(df: DataFrame, column: str, strategy: str, train: DataFrame | None = None, group_col: str | None = None, order_by: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """One column by one strategy, with statistics of ``train`` (of ``df`` itself, if not given)."""
    model = PlanImputer([Step(column, strategy, group_col=group_col)], order_by, partition_by).fit(df if train is None else train)
    return model.transform(df)


def violations(before: DataFrame, after: DataFrame, plan: dict, key: str | None = None, target: str | None = None) -> DataFrame:
    """One row of counts that must all be zero.

    Missing values left in filled columns, indicators other than 0 and 1, dropped columns
    still there, and (with a key) targets that changed.
    """
    filled = [c for c, p in plan["columns"].items() if p["strategy"] not in ("drop_column", "no_imputation_needed") and c in after.columns]
    flags = [c for c in after.columns if c.endswith(SUFFIX)]
    dropped = [c for c, p in plan["columns"].items() if p["strategy"] == "drop_column" and c in after.columns]
    left = sum((F.count_if(missing(after, c)) for c in filled), F.lit(0))
    odd = sum((F.count_if(~F.coalesce(F.col(q(c)).isin(0, 1), F.lit(False))) for c in flags), F.lit(0))
    out = after.agg(left.cast("long").alias("residual_missing"), odd.cast("long").alias("bad_indicators"), F.lit(len(dropped)).cast("long").alias("dropped_present"))
    if key and target and target in before.columns and target in after.columns:
        a = before.select(F.col(q(key)).alias("k"), F.col(q(target)).alias("a"))
        b = after.select(F.col(q(key)).alias("k2"), F.col(q(target)).alias("b"))
        changed = a.join(b, F.col("k") == F.col("k2"), "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b")) | F.col("k").isNull() | F.col("k2").isNull()).alias("target_changed"))
        return out.crossJoin(changed)  # one row each
    return out.withColumn("target_changed", F.lit(0).cast("long"))
