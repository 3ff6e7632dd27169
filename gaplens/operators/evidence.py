"""Evidence on why values are missing, from aggregations; only small tables reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .columns import categorical_columns, missing, number, numeric_columns, q
from .gram import cross_sums

MIN_GROUP, MIN_LEVELS, MAX_LEVELS = 5, 2, 50
MIN_PAIRS = 20
#: Aggregates in one pass; more are taken as sums of products.
WIDTH = 60


def group_rates(df: DataFrame, columns: list[str], features: list[str] | None = None) -> DataFrame:
    """(column, feature, level, n, n_missing, rate): one scan, one grouping over all features.

    Levels are the observed ones; a feature of itself is left out.
    """
    features = categorical_columns(df) if features is None else features
    flags = [missing(df, c).cast("int").alias(f"m{k}") for k, c in enumerate(columns)]
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(q(f)).cast("string").alias("level")) for f in features))
    long = df.select(F.inline(pairs), *flags).where(F.col("level").isNotNull())
    sums = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"m{k}").alias(f"m{k}") for k in range(len(columns))))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{k}").alias("n_missing")) for k, c in enumerate(columns)))
    out = sums.select("feature", "level", "n", F.inline(each)).where(F.col("column") != F.col("feature"))
    return out.select("column", "feature", "level", "n", "n_missing", (F.col("n_missing") / F.col("n")).alias("rate"))


def group_spread(df: DataFrame, columns: list[str], features: list[str] | None = None) -> DataFrame:
    """(column, feature, n_levels, spread): the range of missing rates over levels of at least five rows, for 2 to 50 of them."""
    fit = group_rates(df, columns, features).groupBy("column", "feature").agg(
        F.count(F.lit(1)).alias("levels"), F.count_if(F.col("n") >= MIN_GROUP).alias("n_levels"),
        (F.max(F.when(F.col("n") >= MIN_GROUP, F.col("rate"))) - F.min(F.when(F.col("n") >= MIN_GROUP, F.col("rate")))).alias("spread"),
    )
    return fit.where(F.col("levels").between(MIN_LEVELS, MAX_LEVELS) & (F.col("n_levels") >= MIN_LEVELS)).select("column", "feature", "n_levels", "spread")


def contingency(df: DataFrame, column: str, feature: str) -> DataFrame:
    """(missing, level, n) over the observed levels."""
    return df.where(~missing(df, feature)).groupBy(missing(df, column).cast("int").alias("missing"), F.col(q(feature)).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def chi2_frame(table: DataFrame) -> DataFrame:
    """One row (statistic, df) of the chi-squared test of a contingency table, with Yates' correction at df 1; no row below 2 x 2."""
    both = table.groupBy("level").agg(F.sum(F.when(F.col("missing") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("missing") == 0, F.col("n")).otherwise(0)).alias("b"))
    sums = both.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.count(F.lit(1)).alias("k"))
    rows = both.crossJoin(sums).where("sa > 0 AND sb > 0 AND k >= 2")  # one row
    total, n = F.col("sa") + F.col("sb"), F.col("a") + F.col("b")
    part = lambda seen, side: F.struct((F.col(seen) - n * F.col(side) / total).alias("gap"), (n * F.col(side) / total).alias("e"))
    cells = rows.select("k", F.explode(F.array(part("a", "sa"), part("b", "sb"))).alias("c"))
    gap = F.abs("c.gap")
    gap = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = cells.groupBy("k").agg(F.sum(gap * gap / F.col("c.e")).alias("statistic"))
    return out.select("statistic", (F.col("k") - 1).alias("df"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r as an aggregate; null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def _paired(c: Column, other: Column) -> Column:
    return F.when(other.isNotNull(), c)


def _near_zero(df: DataFrame, columns: list[str]) -> list[float]:
    """A number close to the middle of each column, from a few rows: taken off before squares are summed, it keeps digits and changes no result."""
    few = df.limit(1000).agg(*(F.avg(F.when(~missing(df, c), number(c))).alias(f"a{k}") for k, c in enumerate(columns))).first()
    return [x if x is not None and np.isfinite(x) else 0.0 for x in few]


def _frame(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _r(n: float, x: float, xx: float, y: float, yy: float, xy: float) -> float | None:
    """Pearson's r from sums; None where either side is constant."""
    vx, vy = xx / n - (x / n) ** 2, yy / n - (y / n) ** 2
    if vx <= 1e-14 * (xx / n) or vy <= 1e-14 * (yy / n):
        return None
    return float((xy / n - (x / n) * (y / n)) / np.sqrt(vx * vy))


def indicator_correlations(df: DataFrame, columns: list[str], features: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """(column, feature, n, r): missingness of a column against the numbers of another, over rows where that is observed (20 at least).

    One aggregation up to ``width`` aggregates; over that, sums of products by one scan.
    """
    features = numeric_columns(df) if features is None else features
    pairs = [(c, f) for c in columns for f in features if c != f]
    if 2 * len(pairs) > width:
        near = _near_zero(df, features)
        x = [F.when(~missing(df, f), number(f) - a) for f, a in zip(features, near)]
        sums = cross_sums(df, [F.lit(1.0), *(missing(df, c) for c in columns)], [y for v in x for y in (v.isNotNull(), v, v * v)])
        found = []
        for c, f in pairs:
            k, (n, sx, sxx), at = columns.index(c) + 1, sums[0, 3 * features.index(f) : 3 * features.index(f) + 3], 3 * features.index(f)
            if n >= MIN_PAIRS and (r := _r(n, sx, sxx, sums[k, at], sums[k, at], sums[k, at + 1])) is not None:
                found.append((c, f, int(n), r))
        return _frame(df, found, "column string, feature string, n long, r double")
    aggs, rows = [], []
    for k, (c, f) in enumerate(pairs):
        x = F.when(~missing(df, f), number(f))
        y = _paired(missing(df, c).cast("double"), x)
        aggs += [correlation(x, y).alias(f"r{k}"), F.count(x).alias(f"n{k}")]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(f).alias("feature"), F.col(f"n{k}").alias("n"), F.col(f"r{k}").alias("r")))
    return _inlined(df, aggs, rows).where(F.col("r").isNotNull() & (F.col("n") >= MIN_PAIRS))


def top_features(found: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k features of each column with the largest size of ``by``, ranked; ties by name."""
    w = Window.partitionBy("column").orderBy(F.abs(by).desc(), "feature")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def class_spread(df: DataFrame, column: str, target: str) -> DataFrame:
    """One row (n_classes, spread): the range of missing rates over classes of a categorical target with five rows at least."""
    return group_spread(df, [column], [target]).select("n_levels", "spread")


def _inlined(df: DataFrame, aggs: list[Column], rows: list[Column]) -> DataFrame:
    """Rows made of the aggregates of one pass."""
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def point_biserial(df: DataFrame, column: str, target: str) -> DataFrame:
    """One row (n, r): missingness of a column against a numeric target; no row under 20 observed targets."""
    x = F.when(~missing(df, target), number(target))
    y = _paired(missing(df, column).cast("double"), x)
    return df.agg(F.count(x).alias("n"), correlation(x, y).alias("r")).where(F.col("n") >= MIN_PAIRS)


def target_split(df: DataFrame, column: str, target: str) -> DataFrame:
    """(missing, n, target_mean) with both sides of three rows at least."""
    sides = df.where(~missing(df, target)).groupBy(missing(df, column).cast("int").alias("missing")).agg(F.count(F.lit(1)).alias("n"), F.avg(number(target)).alias("target_mean"))
    fit = sides.agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("sides"))
    return sides.crossJoin(fit).where("sides = 2 AND least >= 3").select("missing", "n", "target_mean")


def target_class_split(df: DataFrame, column: str, target: str) -> DataFrame:
    """(missing, n, top_class, share) for a categorical target."""
    counts = df.where(~missing(df, target)).groupBy(missing(df, column).cast("int").alias("missing"), F.col(q(target)).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("missing").agg(F.sum("k").alias("n"), F.min_by("v", F.struct(-F.col("k"), F.col("v"))).alias("top_class"), (F.max("k") / F.sum("k")).alias("share"))


def structural_counts(df: DataFrame, categoricals: list[str], numerics: list[str], width: int = WIDTH) -> DataFrame:
    """For each (categorical, numeric) pair, counts with the categorical missing and present, by one scan."""
    aggs, rows = [], []
    pairs = [(c, x) for c in categoricals for x in numerics]
    if 7 * len(pairs) > width:
        return _structural_sums(df, categoricals, numerics)
    for k, (c, x) in enumerate(pairs):
        gone, v = missing(df, c), number(x)
        none = missing(df, x)
        zero = F.coalesce(F.when(none, 0.0).otherwise(v), F.lit(0.0)) == 0  # a missing number counts as zero
        aggs += [
            F.count_if(gone).alias(f"a{k}"), F.count_if(gone & none).alias(f"b{k}"), F.count_if(gone & zero).alias(f"c{k}"), F.count_if(~gone).alias(f"d{k}"),
            F.count_if(~gone & zero).alias(f"e{k}"), F.avg(F.when(gone & ~none, F.abs(v))).alias(f"f{k}"), F.avg(F.when(~gone & ~none, F.abs(v))).alias(f"g{k}"),
        ]
        names = ("n_cat_na", "n_both_na", "n_zero_na", "n_cat_present", "n_zero_present", "mean_abs_na", "mean_abs_present")
        rows.append(F.struct(F.lit(c).alias("categorical_col"), F.lit(x).alias("numeric_col"), *(F.col(f"{s}{k}").alias(n) for s, n in zip("abcdefg", names))))
    return _inlined(df, aggs, rows)


def _structural_sums(df: DataFrame, categoricals: list[str], numerics: list[str]) -> DataFrame:
    """The same by sums of products."""
    each = []
    for x in numerics:
        none, v = missing(df, x), number(x)
        each += [none, F.when(none, 0.0).otherwise(v) == 0, F.when(~none, F.abs(v))]
    sums = cross_sums(df, [F.lit(1.0), *(missing(df, c) for c in categoricals)], [F.lit(1.0), *each])
    rows = []
    for i, c in enumerate(categoricals, 1):
        for j, x in enumerate(numerics):
            (n, none, zero, size), (gone, gone_none, gone_zero, gone_size) = (sums[k, [0, 3 * j + 1, 3 * j + 2, 3 * j + 3]].tolist() for k in (0, i))
            mean = lambda total, k: total / k if k else None
            rows.append((c, x, int(gone), int(gone_none), int(gone_zero), int(n - gone), int(zero - gone_zero), mean(gone_size, gone - gone_none), mean(size - gone_size, n - gone - none + gone_none)))
    return _frame(df, rows, "categorical_col string, numeric_col string, n_cat_na long, n_both_na long, n_zero_na long, n_cat_present long, n_zero_present long, mean_abs_na double, mean_abs_present double")


def structural_pairs(df: DataFrame, categoricals: list[str] | None = None, numerics: list[str] | None = None) -> DataFrame:
    """Pairs that look structurally absent.

    ``co_missing_structural``: the number is missing in 85 % of rows where the
    categorical is; ``structural_absence``: it is zero there 40 points more often than
    elsewhere, and zero in 85 % or under a tenth of its usual size.
    """
    found = structural_counts(df, categoricals or categorical_columns(df), numerics or numeric_columns(df)).where("n_cat_na >= 5")
    na = F.col("n_both_na") / F.col("n_cat_na")
    zero = F.col("n_zero_na") / F.col("n_cat_na")
    lift = zero - F.coalesce(F.try_divide(F.col("n_zero_present").cast("double"), "n_cat_present"), F.lit(0.0))
    ratio = F.try_divide(F.coalesce("mean_abs_na", F.lit(0.0)), F.nullif(F.col("mean_abs_present"), F.lit(0.0)))
    absent = (F.col("n_cat_present") > 0) & (lift >= 0.40) & ((zero >= 0.85) | (ratio < 0.10))
    pattern = F.when(na >= 0.85, "co_missing_structural").when(absent, "structural_absence")
    return found.withColumn("pattern", pattern).where(F.col("pattern").isNotNull()).select(
        "categorical_col", "numeric_col", "pattern", na.alias("na_fraction_when_cat_na"), zero.alias("zero_fraction_when_cat_na"), lift.alias("zero_lift_over_baseline"))


def pattern_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(pattern, n): rows by which columns are missing, as a string of 0 and 1."""
    columns = columns or df.columns
    return df.groupBy(F.concat(*(missing(df, c).cast("int").cast("string") for c in columns)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def pattern_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each pattern of missing numbers: rows, sums and cross-products with missing taken as zero."""
    flat = df.select(F.concat(*(missing(df, c).cast("int").cast("string") for c in columns)).alias("pattern"), *(F.when(missing(df, c), 0.0).otherwise(number(c)).alias(f"x{k}") for k, c in enumerate(columns)))
    p = range(len(columns))
    return flat.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in p), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i in p for j in p if i <= j))


def collect_patterns(df: DataFrame, columns: list[str], most: int = 100_000):
    """The moments on the driver; at most 2^p rows of p^2 numbers, and no more than ``most``."""
    rows = pattern_moments(df, columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} patterns of missing values; audit fewer columns at a time")
    out = []
    for r in sorted(rows, key=lambda r: r["pattern"]):
        seen = [k for k, c in enumerate(r["pattern"]) if c == "0"]
        cross = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in seen] for i in seen], float).reshape(len(seen), len(seen))
        out.append((tuple(c == "0" for c in r["pattern"]), r["n"], np.array([r[f"s{i}"] for i in seen], float), cross))
    return out


def little_mcar(df: DataFrame, columns: list[str] | None = None) -> dict:
    """Little's test over all numeric columns that have a value."""
    columns = columns or numeric_columns(df)
    seen = df.agg(*(F.count_if(~missing(df, c)).alias(f"c{k}") for k, c in enumerate(columns))).first() if columns else []
    columns = [c for k, c in enumerate(columns) if seen[f"c{k}"]]
    if len(columns) < 2:
        return {"applicable": False, "reason": "needs two numeric columns"}
    # centred for the sums only: the statistic does not change
    ends = df.agg(*(F.avg(F.when(~missing(df, c), number(c))).alias(f"a{k}") for k, c in enumerate(columns))).first()
    moved = df.select(*(F.when(~missing(df, c), number(c) - ends[f"a{k}"]).alias(f"v{k}") for k, c in enumerate(columns)))
    return stats.little_mcar(collect_patterns(moved, moved.columns))


def indicator_matrix(df: DataFrame, columns: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """(a, b, r): correlations of missingness between columns of which some, but not all values are missing."""
    columns = columns or df.columns
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns)) if i <= j]
    if len(pairs) > width:
        flags = [F.lit(1.0), *(missing(df, c) for c in columns)]
        sums, found = cross_sums(df, flags, flags), []
        for i, j in pairs:
            n, a, b, both = sums[0, 0], sums[0, i + 1], sums[0, j + 1], sums[i + 1, j + 1]
            if n and (r := _r(n, a, a, b, b, both)) is not None:
                found.append((columns[i], columns[j], r))
        return _frame(df, found, "a string, b string, r double")
    flags = df.select(*(missing(df, c).cast("double").alias(f"i{k}") for k, c in enumerate(columns)))
    aggs = [correlation(F.col(f"i{i}"), F.col(f"i{j}")).alias(f"r{k}") for k, (i, j) in enumerate(pairs)]
    rows = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.col(f"r{k}").alias("r")) for k, (i, j) in enumerate(pairs)]
    return _inlined(flags, aggs, rows).where(F.col("r").isNotNull())


def mean_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Covariates with missing values at their mean; columns without a value are left out."""
    ends = df.agg(*(F.avg(F.when(~missing(df, c), number(c))).alias(f"a{k}") for k, c in enumerate(columns))).first()
    return df.select(*(F.when(missing(df, c), F.lit(ends[f"a{k}"])).otherwise(number(c)).alias(c) for k, c in enumerate(columns) if ends[f"a{k}"] is not None))


def _start(made: DataFrame, p: int, ridge: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Coefficients fitted to a few rows: a start that spares rounds over the whole; zeros where these rows separate."""
    few = np.array([[float(x) for x in r] for r in made.select("y", *(f"x{k}" for k in range(p))).limit(rows).collect()]).reshape(-1, p + 1)
    y, x = few[:, 0], np.column_stack([few[:, 1:], np.ones(len(few))])
    beta = np.zeros(p + 1)
    if min(y.sum(), len(y) - y.sum()) < MIN_PAIRS:
        return beta
    for _ in range(25):
        q_ = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.lstsq((x * (q_ * (1 - q_))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (q_ - y) + ridge * beta, rcond=None)[0]
        beta = beta - step
        if not np.isfinite(beta).all() or np.abs(beta).max() > 20:
            return np.zeros(p + 1)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _newton(made: DataFrame, p: int, n: int, rounds: int = 60, c: float = 1e6) -> float:
    """The greatest log-likelihood of y on x0 to x(p-1) and a constant, with a ridge of 1/c on the slopes.

    One aggregation for each round: Newton's method needs some eight where descent needs
    dozens. The coefficients come as a row, so every round runs the same compiled code.
    """
    spark = made.sparkSession
    names = [f"x{k}" for k in range(p)]
    eta = F.col("b")[p]
    for k, x in enumerate(names):
        eta = eta + F.col("b")[k] * F.col(x)
    rows = lambda b: made.crossJoin(F.broadcast(spark.createDataFrame([(b.tolist(),)], "b array<double>"))).select("y", *names, F.lit(1.0).alias(f"x{p}"), eta.alias("eta"))
    q_ = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("eta")))))
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    # log(1 + exp(t)) without overflow
    soft = lambda t: F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
    clipped = F.greatest(F.lit(float(np.log(1e-12))), -F.when(F.col("y") == 1, soft(-F.col("eta"))).otherwise(soft(F.col("eta"))))
    aggs = [F.sum(clipped).alias("ll"), *(F.sum((F.col("q") - F.col("y")) * F.col(f"x{i}")).alias(f"g{i}") for i in range(p + 1)), *(F.sum(F.col("q") * (1 - F.col("q")) * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in pairs)]
    ridge = np.append(np.full(p, 1 / c), 0.0)
    beta, best, step = _start(made, p, ridge), None, None
    for _ in range(rounds):
        r = rows(beta).withColumn("q", q_).agg(*aggs).first()
        loss = -r["ll"] + 0.5 * float(ridge @ (beta * beta))
        if best is None and loss > n * np.log(2) and beta.any():
            beta = np.zeros(p + 1)  # the few rows misled
            continue
        if best is not None and loss > best[0] + 1e-9 * abs(best[0]):
            step = step / 2  # too far: half the step from the best point
            beta = best[1] - step
            if np.abs(step).max() < 1e-10:
                break
            continue
        done = best is not None and best[0] - loss < 1e-9 * (1 + abs(loss))
        best = (loss, beta, r["ll"])
        if done:
            break
        h = np.zeros((p + 1, p + 1))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        g = np.array([r[f"g{i}"] for i in range(p + 1)]) + ridge * beta
        step = np.linalg.lstsq(h + np.diag(ridge + 1e-12 * n), g, rcond=None)[0]
        beta = beta - step
    return best[2]


def _descent(made: DataFrame, p: int, n: int, rounds: int = 2000) -> float:
    """The same by the library's solver, for many covariates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=[f"x{k}" for k in range(p)], outputCol="x").transform(made).select("y", "x")
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (1e6 * n), elasticNetParam=0.0, maxIter=rounds, tol=1e-9, standardization=False).fit(data)
    chance = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.element_at(F.col("p"), 2)))
    told = model.transform(data).select("y", vector_to_array("probability").alias("p"))
    return told.agg(F.sum(F.when(F.col("y") == 1, F.log(chance)).otherwise(F.log(1 - chance)))).first()[0]


def logistic_lr(df: DataFrame, column: str, covariates: list[str], newton_to: int = 12) -> dict | None:
    """Likelihood-ratio test of missingness on the other numbers; None where it cannot be computed.

    The ridge keeps the fit finite where a covariate separates the classes.
    """
    y = missing(df, column).cast("double")
    ends = df.select(y.alias("y"), *(F.when(~missing(df, c), number(c)).alias(f"x{k}") for k, c in enumerate(covariates)))
    stat = ends.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *(F.avg(f"x{k}").alias(f"a{k}") for k in range(len(covariates))), *(F.stddev_pop(f"x{k}").alias(f"d{k}") for k in range(len(covariates))), *(F.count(f"x{k}").alias(f"c{k}") for k in range(len(covariates)))).first()
    n, ones = stat["n"], stat["ones"] or 0
    used = [k for k in range(len(covariates)) if stat[f"a{k}"] is not None and (stat[f"d{k}"] or 0) > 0]
    if n < MIN_PAIRS or min(ones, n - ones) < 2 or not used:
        return None
    # gaps at the mean; the spread is that of the filled column
    spread = {k: stat[f"d{k}"] * (stat[f"c{k}"] / n) ** 0.5 for k in used}
    made = ends.select("y", *(((F.coalesce(f"x{k}", F.lit(stat[f"a{k}"])) - stat[f"a{k}"]) / spread[k]).alias(f"x{at}") for at, k in enumerate(used))).persist()
    full = (_newton if len(used) <= newton_to else _descent)(made, len(used), n)
    made.unpersist()
    share = ones / n
    value = 2 * (full - (ones * np.log(share) + (n - ones) * np.log(1 - share)))
    if value < 0:
        return None
    return {"statistic": float(value), "df": len(used), "p_value": round(stats.chi2_sf(float(value), len(used)), 6)}
