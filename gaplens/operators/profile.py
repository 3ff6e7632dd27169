"""Missingness profile: counts for all columns from one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import categorical_columns, is_nested, is_numeric, missing, q

#: Lower bounds of the severities, on the rate rounded to four places.
SEVERITIES = (("high", 0.80), ("moderate", 0.20), ("low", 0.05))
MANY_LEVELS, MANY_SHARE = 50, 0.20
#: Aggregates in one pass; wider tables take more passes, so that generated code stays compilable.
WIDTH = 60


def severity(rate: Column) -> Column:
    r = F.round(rate, 4)
    out = F.when(r == 0, "none").when(r >= 1, "complete")
    for name, least in SEVERITIES:
        out = out.when(r >= least, name)
    return out.otherwise("trace")


def _counts(df: DataFrame, columns: list[str], distinct: str | None) -> DataFrame:
    """One row: n, and for each column k its missing values m{k} and distinct values u{k}."""
    out = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(columns):
        out.append(F.count_if(missing(df, c)).alias(f"m{k}"))
        seen = F.when(~missing(df, c), F.col(q(c)))
        if distinct and not is_nested(df, c):
            out.append((F.count_distinct(seen) if distinct == "exact" else F.approx_count_distinct(seen, 0.02)).alias(f"u{k}"))
    return df.agg(*out)


def profile(df: DataFrame, predict: DataFrame | None = None, target: str | None = None, distinct: str | None = "exact") -> DataFrame:
    """One row for each column of ``df``.

    ``distinct`` is "exact", "approx" (one pass without expansion, for very large
    tables) or None. ``predict`` adds the missing rate of the columns it has.
    """
    out = None
    for at in range(0, len(df.columns), WIDTH):
        part = _profile(df, df.columns[at : at + WIDTH], at, predict, target, distinct)
        out = part if out is None else out.unionByName(part)
    return out


def _profile(df, columns, start, predict, target, distinct) -> DataFrame:
    wide = _counts(df, columns, distinct)
    n, rows = F.col("n"), []
    both = [c for c in columns if predict is not None and c in predict.columns]
    if both:
        rates = [F.try_divide(F.count_if(missing(predict, c)).cast("double"), F.count(F.lit(1))).alias(f"p{columns.index(c)}") for c in both]
        wide = wide.crossJoin(predict.agg(*rates))  # one row each
    for k, c in enumerate(columns):
        unique = F.col(f"u{k}") if distinct and not is_nested(df, c) else F.lit(None).cast("long")
        kind = "numeric" if is_numeric(df, c) else "categorical"
        category = F.lit(kind)
        if df.schema[c].dataType.typeName() == "boolean":
            category = F.when(F.col(f"m{k}") == 0, "numeric").otherwise("categorical")
        rate = F.coalesce(F.try_divide(F.col(f"m{k}").cast("double"), n), F.lit(0.0))
        many = (category == "categorical") & ((unique > MANY_LEVELS) | (F.try_divide(unique.cast("double"), n) > MANY_SHARE))
        rows.append(F.struct(
            F.lit(start + k).alias("position"), F.lit(c).alias("column"), n.alias("n_total"), F.col(f"m{k}").alias("n_missing"), rate.alias("missing_rate"),
            severity(rate).alias("severity"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), category.alias("dtype_category"), unique.alias("unique_count"),
            F.coalesce(many, F.lit(False)).alias("is_high_cardinality"), F.lit(c == target).alias("is_target"),
            (F.col(f"p{k}") if c in both else F.lit(None).cast("double")).alias("predict_missing_rate"),
        ))
    return wide.select(F.inline(F.array(*rows)))


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, columns with a missing value, missing cells and their rate."""
    p = profile(df, distinct=None)
    cells = F.sum("n_missing")
    return p.agg(
        F.max("n_total").alias("total_rows"), F.count(F.lit(1)).alias("total_columns"), F.count_if(F.col("n_missing") > 0).alias("columns_with_any_missing"),
        cells.alias("total_missing_cells"), F.coalesce(F.try_divide(cells.cast("double"), F.sum("n_total")), F.lit(0.0)).alias("overall_missing_rate"),
    )


def column_summary(df: DataFrame, samples: int = 3) -> DataFrame:
    """Type, distinct values, least and greatest value, and the least few values of each column, as text."""
    aggs, rows = [], []
    plain = [c for c in df.columns if not is_nested(df, c)]
    for k, c in enumerate(plain):
        seen = F.when(~missing(df, c), F.col(q(c)))
        aggs += [F.count_distinct(seen).alias(f"u{k}"), F.min(seen).alias(f"a{k}"), F.max(seen).alias(f"b{k}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col(f"u{k}").alias("n_unique"), F.col(f"a{k}").cast("string").alias("min"), F.col(f"b{k}").cast("string").alias("max")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def sample_values(df: DataFrame, name: str, samples: int = 3) -> DataFrame:
    """The least few distinct values of a column."""
    return df.where(~missing(df, name)).select(F.col(q(name)).alias("value")).distinct().orderBy("value").limit(samples)


def row_missing_share(df: DataFrame) -> DataFrame:
    """One row: the share of rows with at least one, and with at least two missing values."""
    n = sum((missing(df, c).cast("int") for c in df.columns), F.lit(0))
    rows = df.select(n.alias("k"))
    share = lambda least: F.try_divide(F.count_if(F.col("k") >= least).cast("double"), F.count(F.lit(1)))
    return rows.agg(share(1).alias("share_any"), share(2).alias("share_multi"))


def value_counts(df: DataFrame, name: str, top: int = 8) -> DataFrame:
    """The most frequent values with their shares of the observed ones; ties to the smaller value."""
    seen = df.where(~missing(df, name))
    counts = seen.groupBy(F.col(q(name)).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = seen.agg(F.count(F.lit(1)).alias("total"))
    return counts.orderBy(F.desc("n"), "value").limit(top).crossJoin(total).select("value", "n", F.try_divide(F.col("n").cast("double"), "total").alias("share"))


def histogram(df: DataFrame, name: str, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins from the least to the greatest value; the last bin is closed."""
    v = F.col(q(name)).cast("double")
    seen = df.where(~missing(df, name)).select(v.alias("v"))
    ends = seen.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins)))
    return seen.crossJoin(ends).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def features(df: DataFrame, target: str | None = None) -> list[str]:
    return categorical_columns(df, target)
