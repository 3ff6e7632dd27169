"""The missing-data queries by name, and the SQL that states the same result in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import charts, evidence, impute, profile, sensitivity
from ..operators.chained import ChainedImputer, pool_means
from ..operators.neighbours import knn_fill
from ..sources.fixtures import VIEWS, view, with_view
from .audit import mechanism
from .rules import EFFECTIVE_SQL, LABEL_SQL, MI_SQL, NOTE_SQL, SIGNALS_SQL, STRATEGY_SQL, TEMPORAL_TAGS, Evidence, decision_flow, effective_label, leakage_findings, make_plan, mechanism_label, mice_method, recommend_mi, robustness_note
from .rules import plan_summary as summed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(fixture: str, sql: str | None = None, name: str | None = None):
    """Register a function of a fixture view under its name, with SQL that may refer to the view."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(view(spark, sf_dir, fixture))
        if sql:
            ORACLE_SQL[key] = with_view(fixture, sql)
        return fn

    return add


def _train(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % 5 != 0)


def _predict(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % 5 == 0)


def _profile_sql(table: str, columns: list[str], categorical: tuple = (), extra: str = "") -> str:
    parts = []
    for k, c in enumerate(columns):
        kind = "categorical" if c in categorical else "numeric"
        parts.append(f"""SELECT {k} AS position, '{c}' AS column_name, count(*) AS n_total, count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS unique_count, '{kind}' AS dtype_category FROM {table}""")
    return " UNION ALL ".join(parts)


_SEVERITY = "CASE WHEN r = 0 THEN 'none' WHEN r >= 1 THEN 'complete' WHEN r >= 0.80 THEN 'high' WHEN r >= 0.20 THEN 'moderate' WHEN r >= 0.05 THEN 'low' ELSE 'trace' END"
_ORDERS = _profile_sql("orders_gap", ["o_orderkey", "o_orderpriority", "o_orderstatus", "price"], ("o_orderpriority", "o_orderstatus"))
_DOCS = _profile_sql("doc_labels", ["doc_id", "lang", "source", "n_chars", "quality", "toxic"], ("lang", "source"))


@query("orders_gap", f"WITH p AS ({_ORDERS}) SELECT column_name, n_total, n_missing, n_missing / n_total AS missing_rate, unique_count, dtype_category FROM p")
def profile_columns(df):
    return profile.profile(df).select(F.col("column").alias("column_name"), "n_total", "n_missing", "missing_rate", "unique_count", "dtype_category")


@query("doc_labels", f"""WITH p AS ({_DOCS}) SELECT max(n_total) AS total_rows, count(*) AS total_columns, CAST(count(*) FILTER (WHERE n_missing > 0) AS BIGINT) AS columns_with_any_missing,
  CAST(sum(n_missing) AS BIGINT) AS total_missing_cells, round(sum(n_missing) / sum(n_total), 9) AS overall_missing_rate FROM p""")
def profile_summary(df):
    return profile.summary(df).withColumn("overall_missing_rate", F.round("overall_missing_rate", 9))


@query("orders_gap", """WITH t AS (SELECT * FROM orders_gap WHERE o_orderkey % 5 <> 0), p AS (SELECT * FROM orders_gap WHERE o_orderkey % 5 = 0)
  SELECT 'o_orderkey' AS column_name, 0.0::DOUBLE AS missing_rate, 0.0::DOUBLE AS predict_missing_rate UNION ALL SELECT 'o_orderpriority', 0.0, 0.0 UNION ALL SELECT 'o_orderstatus', 0.0, 0.0
  UNION ALL SELECT 'price', (SELECT (count(*) - count(price)) / count(*) FROM t), (SELECT (count(*) - count(price)) / count(*) FROM p)""")
def predict_missing_rate(df):
    out = profile.profile(_train(df, "o_orderkey"), _predict(df, "o_orderkey"), distinct=None)
    return out.select(F.col("column").alias("column_name"), "missing_rate", "predict_missing_rate")


@query("doc_labels", f"WITH p AS ({_DOCS}), q AS (SELECT column_name, round(n_missing / n_total, 4) AS r FROM p) SELECT column_name, {_SEVERITY} AS severity FROM q")
def severity_bucket(df):
    return profile.profile(df, distinct=None).select(F.col("column").alias("column_name"), "severity")


@query("doc_labels", f"WITH p AS ({_DOCS}) SELECT column_name, dtype_category = 'categorical' AND (unique_count > 50 OR unique_count / n_total > 0.20) AS is_high_cardinality FROM p")
def high_cardinality(df):
    return profile.profile(df).select(F.col("column").alias("column_name"), "is_high_cardinality")


@query("orders_gap", "SELECT o_orderkey, CAST(price IS NULL AS INTEGER) AS price_was_missing FROM orders_gap")
def indicator(df):
    from ..operators.columns import indicator as flag

    return df.select("o_orderkey", flag(df, "price"))


@query("customer_gap", "SELECT c_custkey, coalesce(acctbal, (SELECT median(acctbal) FROM customer_gap)) AS acctbal FROM customer_gap")
def fill_median(df):
    return impute.fill(df, "acctbal", "numeric_median").select("c_custkey", "acctbal")


@query("customer_gap", """SELECT c_custkey, coalesce(acctbal, (SELECT median(acctbal) FROM customer_gap WHERE c_custkey % 5 <> 0)) AS acctbal, CAST(acctbal IS NULL AS INTEGER) AS acctbal_was_missing
  FROM customer_gap WHERE c_custkey % 5 = 0""")
def fill_median_predict(df):
    return impute.fill(_predict(df, "c_custkey"), "acctbal", "numeric_median_plus_indicator", _train(df, "c_custkey")).select("c_custkey", "acctbal", "acctbal_was_missing")


_GROUP = """WITH t AS (SELECT * FROM orders_gap {0}), g AS (SELECT o_orderpriority, median(price) AS m FROM t GROUP BY o_orderpriority)
  SELECT o.o_orderkey, coalesce(o.price, g.m, (SELECT median(price) FROM t)) AS price, CAST(o.price IS NULL AS INTEGER) AS price_was_missing
  FROM orders_gap o LEFT JOIN g ON o.o_orderpriority = g.o_orderpriority {1}"""


@query("orders_gap", _GROUP.format("", ""))
def fill_group_median(df):
    out = impute.fill(df, "price", "groupwise_numeric_median_plus_indicator", group_col="o_orderpriority")
    return out.select("o_orderkey", "price", "price_was_missing")


@query("orders_gap", _GROUP.format("WHERE o_orderkey % 5 <> 0", "WHERE o.o_orderkey % 5 = 0"))
def fill_group_median_predict(df):
    out = impute.fill(_predict(df, "o_orderkey"), "price", "group_median", _train(df, "o_orderkey"), "o_orderpriority")
    from ..operators.columns import indicator as flag

    marks = _predict(df, "o_orderkey").select("o_orderkey", flag(df, "price"))
    return out.select("o_orderkey", "price").join(marks, "o_orderkey")


_FILL = """coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("events_gap", f"SELECT event_id, {_FILL} AS value, CAST(value IS NULL AS INTEGER) AS value_was_missing FROM events_gap")
def fill_ffill_bfill(df):
    return impute.fill(df, "value", "time_series_ffill_bfill_plus_indicator", order_by=["event_id"]).select("event_id", "value", "value_was_missing")


@query("events_gap", f"SELECT event_id, {_FILL.replace('OVER (', 'OVER (PARTITION BY user_id ')} AS value FROM events_gap")
def fill_ffill_bfill_by_entity(df):
    return impute.ordered_fill(df, "value", ["event_id"], ["user_id"]).select("event_id", "value")


@query("customer_comiss", "SELECT c_custkey, coalesce(segment, 'MISSING') AS segment FROM customer_comiss")
def fill_token(df):
    return impute.fill(df, "segment", "categorical_missing_token").select("c_custkey", "segment")


@query("customer_comiss", "SELECT c_custkey, coalesce(segment, 'MISSING') AS segment, CAST(segment IS NULL AS INTEGER) AS segment_was_missing FROM customer_comiss")
def fill_token_indicator(df):
    return impute.fill(df, "segment", "categorical_missing_token_plus_indicator").select("c_custkey", "segment", "segment_was_missing")


@query("customer_comiss", """SELECT c_custkey, coalesce(segment, (SELECT segment FROM customer_comiss WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment,
  CAST(segment IS NULL AS INTEGER) AS segment_was_missing FROM customer_comiss""")
def fill_mode(df):
    return impute.fill(df, "segment", "categorical_mode_plus_indicator").select("c_custkey", "segment", "segment_was_missing")


@query("part_gap", "SELECT p_partkey, coalesce(ptype, 'NONE') AS ptype, CAST(ptype IS NULL AS INTEGER) AS ptype_was_missing FROM part_gap")
def fill_none(df):
    return impute.fill(df, "ptype", "structural_none_token_plus_indicator").select("p_partkey", "ptype", "ptype_was_missing")


@query("customer_comiss", "SELECT c_custkey, coalesce(acctbal, 0) AS acctbal, CAST(acctbal IS NULL AS INTEGER) AS acctbal_was_missing FROM customer_comiss")
def fill_zero(df):
    return impute.fill(df, "acctbal", "structural_zero_plus_indicator").select("c_custkey", "acctbal", "acctbal_was_missing")


@query("customer_comiss", "SELECT c_custkey, coalesce(segment, 'NONE') AS segment, coalesce(acctbal, 0) AS acctbal FROM customer_comiss")
def fill_none_or_zero(df):
    return impute.fill(impute.fill(df, "segment", "structural_none_or_zero"), "acctbal", "structural_none_or_zero").select("c_custkey", "segment", "acctbal")


@query("orders_sparse", "SELECT o_orderkey, target FROM orders_sparse")
def drop_sparse(df):
    return impute.fill(df, "sparse", "drop_column")


@query("customer_gap", "SELECT c_custkey, round(coalesce(acctbal, (SELECT avg(acctbal) FROM customer_gap)), 6) AS acctbal FROM customer_gap")
def fill_mean(df):
    return impute.fill(df, "acctbal", "numeric_mean").select("c_custkey", F.round("acctbal", 6).alias("acctbal"))


_RATES = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS level, count(*) AS n, count(*) - count(price) AS n_missing, (count(*) - count(price)) / count(*) AS rate FROM orders_gap WHERE {f} IS NOT NULL GROUP BY {f}" for f in ("o_orderpriority", "o_orderstatus"))


@query("orders_gap", _RATES)
def group_missing_rates(df):
    return evidence.group_rates(df, ["price"]).select("feature", "level", "n", "n_missing", "rate")


@query("orders_gap", f"WITH r AS ({_RATES}) SELECT feature, count(*) FILTER (WHERE n >= 5) AS n_levels, round(max(rate) FILTER (WHERE n >= 5) - min(rate) FILTER (WHERE n >= 5), 9) AS spread FROM r GROUP BY feature HAVING count(*) BETWEEN 2 AND 50 AND count(*) FILTER (WHERE n >= 5) >= 2")
def group_spread(df):
    return evidence.group_spread(df, ["price"]).select("feature", "n_levels", F.round("spread", 9).alias("spread"))


@query("orders_gap", "SELECT CAST(price IS NULL AS INTEGER) AS missing, o_orderpriority AS level, count(*) AS n FROM orders_gap WHERE o_orderpriority IS NOT NULL GROUP BY ALL")
def contingency(df):
    return evidence.contingency(df, "price", "o_orderpriority")


def _chi2_sql(level: str, correction: str) -> str:
    return f"""WITH b AS (SELECT {level} AS l, count(*) - count(price) AS a, count(price) AS b FROM orders_gap GROUP BY 1), s AS (SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS k FROM b),
  c AS (SELECT k, a - (a + b) * sa / (sa + sb) AS gap, (a + b) * sa / (sa + sb) AS e FROM b, s UNION ALL SELECT k, b - (a + b) * sb / (sa + sb), (a + b) * sb / (sa + sb) FROM b, s)
  SELECT round(sum(power({correction}, 2) / e), 6) AS statistic, k - 1 AS df FROM c GROUP BY k"""


@query("orders_gap", _chi2_sql("CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'other' END", "abs(gap) - least(0.5, abs(gap))"))
def chi2_yates(df):
    two = df.withColumn("urgent", F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other"))
    return evidence.chi2_frame(evidence.contingency(two, "price", "urgent")).select(F.round("statistic", 6).alias("statistic"), "df")


@query("orders_gap", _chi2_sql("o_orderpriority", "gap"))
def chi2_pearson_k(df):
    return evidence.chi2_frame(evidence.contingency(df, "price", "o_orderpriority")).select(F.round("statistic", 6).alias("statistic"), "df")


_R = "(covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0))"
_Y = "CAST(discount IS NULL AS DOUBLE)"


@query("lineitem_gap", " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, round({_R.format(_Y, f'CAST({f} AS DOUBLE)')}, 6) AS r FROM lineitem_gap" for f in ("l_orderkey", "l_quantity", "l_extendedprice", "l_tax")))
def corr_indicator_numeric(df):
    return evidence.indicator_correlations(df, ["discount"]).select("feature", "n", F.round("r", 6).alias("r"))


@query("lineitem_gap", "WITH c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {_R.format(_Y, f'CAST({f} AS DOUBLE)')} AS r FROM lineitem_gap" for f in ("l_orderkey", "l_quantity", "l_extendedprice", "l_tax"))
       + "), k AS (SELECT feature, round(r, 6) AS r, CAST(row_number() OVER (ORDER BY abs(r) DESC, feature) AS INTEGER) AS rank FROM c) SELECT feature, r, rank FROM k WHERE rank <= 5")
def top_correlated_features(df):
    return evidence.top_features(evidence.indicator_correlations(df, ["discount"]), "r").select("feature", F.round("r", 6).alias("r"), "rank")


@query("orders_gap", f"WITH r AS ({_RATES}), s AS (SELECT feature, max(rate) FILTER (WHERE n >= 5) - min(rate) FILTER (WHERE n >= 5) AS spread FROM r GROUP BY feature) SELECT feature, round(spread, 9) AS spread, CAST(row_number() OVER (ORDER BY spread DESC, feature) AS INTEGER) AS rank FROM s")
def top_spread_features(df):
    return evidence.top_features(evidence.group_spread(df, ["price"]), "spread").select("feature", F.round("spread", 9).alias("spread"), "rank")


@query("orders_gap", "WITH r AS (SELECT o_orderstatus, count(*) AS n, (count(*) - count(price)) / count(*) AS rate FROM orders_gap GROUP BY 1) SELECT count(*) AS n_levels, round(max(rate) - min(rate), 9) AS spread FROM r WHERE n >= 5")
def categorical_target_spread(df):
    return evidence.class_spread(df, "price", "o_orderstatus").withColumn("spread", F.round("spread", 9))


@query("events_target", f"SELECT count(target) AS n, round({_R.format('CAST(feat IS NULL AS DOUBLE)', 'target')}, 6) AS r FROM events_target")
def point_biserial(df):
    return evidence.point_biserial(df, "feat", "target").select("n", F.round("r", 6).alias("r"))


@query("events_target", "SELECT CAST(feat IS NULL AS INTEGER) AS missing, count(*) AS n, round(avg(target), 6) AS target_mean FROM events_target GROUP BY 1")
def target_split_means(df):
    return evidence.target_split(df, "feat", "target").withColumn("target_mean", F.round("target_mean", 6))


@query("orders_gap", """WITH c AS (SELECT CAST(price IS NULL AS INTEGER) AS missing, o_orderstatus AS v, count(*) AS k FROM orders_gap GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY missing ORDER BY k DESC, v) AS n1, sum(k) OVER (PARTITION BY missing) AS s FROM c)
  SELECT missing, CAST(s AS BIGINT) AS n, v AS top_class, round(k / s, 9) AS share FROM r WHERE n1 = 1""")
def target_class_split(df):
    return evidence.target_class_split(df, "price", "o_orderstatus").withColumn("share", F.round("share", 9))


@query("part_gap", """WITH s AS (SELECT count(*) FILTER (WHERE ptype IS NULL) AS a, count(*) FILTER (WHERE ptype IS NULL AND psize = 0) AS c, count(*) FILTER (WHERE ptype IS NOT NULL) AS d,
  count(*) FILTER (WHERE ptype IS NOT NULL AND psize = 0) AS e FROM part_gap)
  SELECT 'ptype' AS categorical_col, 'psize' AS numeric_col, 'structural_absence' AS pattern, round(c / a, 9) AS zero_fraction_when_cat_na, round(c / a - e / d, 9) AS zero_lift_over_baseline
  FROM s WHERE a >= 5 AND c / a - e / d >= 0.40 AND c / a >= 0.85""")
def structural_zero_pairs(df):
    out = evidence.structural_pairs(df)
    return out.select("categorical_col", "numeric_col", "pattern", F.round("zero_fraction_when_cat_na", 9).alias("zero_fraction_when_cat_na"), F.round("zero_lift_over_baseline", 9).alias("zero_lift_over_baseline"))


@query("customer_comiss", """SELECT 'segment' AS categorical_col, 'acctbal' AS numeric_col, 'co_missing_structural' AS pattern,
  round(count(*) FILTER (WHERE segment IS NULL AND acctbal IS NULL) / count(*) FILTER (WHERE segment IS NULL), 9) AS na_fraction_when_cat_na FROM customer_comiss""")
def structural_co_missing(df):
    return evidence.structural_pairs(df).select("categorical_col", "numeric_col", "pattern", F.round("na_fraction_when_cat_na", 9).alias("na_fraction_when_cat_na"))


@query("customer_comiss", "SELECT concat('00', CAST(segment IS NULL AS INTEGER), CAST(acctbal IS NULL AS INTEGER)) AS pattern, count(*) AS n FROM customer_comiss GROUP BY 1")
def pattern_counts(df):
    return evidence.pattern_counts(df)


@query("customer_gap", """SELECT concat('0', CAST(acctbal IS NULL AS INTEGER)) AS pattern, count(*) AS n, round(sum(c_nationkey), 4)::DOUBLE AS s0, round(sum(coalesce(acctbal, 0)), 4) AS s1,
  round(sum(c_nationkey * c_nationkey), 4)::DOUBLE AS s0_0, round(sum(c_nationkey * coalesce(acctbal, 0)), 4) AS s0_1, round(sum(coalesce(acctbal, 0) * coalesce(acctbal, 0)), 2) AS s1_1 FROM customer_gap GROUP BY 1""")
def pattern_moments(df):
    out = evidence.pattern_moments(df, ["c_nationkey", "acctbal"])
    return out.select("pattern", "n", *(F.round(c, 2 if c == "s1_1" else 4).alias(c) for c in ("s0", "s1", "s0_0", "s0_1", "s1_1")))


@query("doc_labels", "WITH k AS (SELECT CAST(quality IS NULL AS INTEGER) + CAST(toxic IS NULL AS INTEGER) AS k FROM doc_labels) SELECT count(*) FILTER (WHERE k >= 1) / count(*) AS share_any, count(*) FILTER (WHERE k >= 2) / count(*) AS share_multi FROM k")
def row_missing_share(df):
    return profile.row_missing_share(df)


@query("customer_comiss", f"""WITH f AS (SELECT CAST(segment IS NULL AS DOUBLE) AS a, CAST(acctbal IS NULL AS DOUBLE) AS b FROM customer_comiss)
  SELECT 'segment' AS a, 'segment' AS b, round({_R.format('a', 'a')}, 9) AS r FROM f UNION ALL SELECT 'segment', 'acctbal', round({_R.format('a', 'b')}, 9) FROM f UNION ALL SELECT 'acctbal', 'acctbal', round({_R.format('b', 'b')}, 9) FROM f""")
def indicator_corr_matrix(df):
    return evidence.indicator_matrix(df).withColumn("r", F.round("r", 9))


@query("customer_gap", "SELECT CAST(c_nationkey AS DOUBLE) AS c_nationkey, round(coalesce(acctbal, (SELECT avg(acctbal) FROM customer_gap)), 6) AS acctbal FROM customer_gap")
def covariate_mean_fill(df):
    return evidence.mean_filled(df, ["c_nationkey", "acctbal"]).withColumn("acctbal", F.round("acctbal", 6))


_DELTAS = ", ".join(f"({d})" for d in sensitivity.DELTAS)
_MNAR = f"""WITH s AS (SELECT count(*) AS n, count(value) AS k, avg(value) AS m, stddev_samp(value) AS sd, median(value) AS md FROM events_gap), d(delta) AS (VALUES {_DELTAS}),
  t AS (SELECT CAST(delta AS DOUBLE) AS delta, (k * m + (n - k) * (md + delta * sd)) / n AS mean, abs((k * m + (n - k) * (md + delta * sd)) / n - m) > 1.96 * sd / sqrt(k) AS outside_ci FROM s, d)"""


@query("events_gap", f"{_MNAR} SELECT delta, round(mean, 6) AS mean, outside_ci FROM t")
def mnar_trajectory(df):
    return sensitivity.trajectory(df, "value").select("delta", F.round("mean", 6).alias("mean"), "outside_ci")


@query("events_gap", f"""{_MNAR}, p AS (SELECT (SELECT delta FROM t WHERE outside_ci AND delta <> 0 ORDER BY abs(delta), delta LIMIT 1) AS tipping_point)
  SELECT 'value' AS column_name, tipping_point, CASE WHEN tipping_point IS NULL THEN 'robust' WHEN abs(tipping_point) <= 0.5 THEN 'fragile' ELSE 'moderately_robust' END AS robustness FROM p""")
def mnar_tipping(df):
    return sensitivity.tipping(df, ["value"]).select(F.col("column").alias("column_name"), "tipping_point", "robustness")


@query("events_gap", """WITH e AS (SELECT event_id % 5 AS i, avg(value) AS q, var_samp(value) / count(value) AS u FROM events_gap GROUP BY 1),
  p AS (SELECT count(*) AS m, avg(q) AS q, avg(u) AS u, var_samp(q) AS b FROM e), r AS (SELECT *, u + (1 + 1 / m) * b AS t, (1 + 1 / m) * b / u AS r FROM p), d AS (SELECT *, (m - 1) * power(1 + 1 / r, 2) AS df FROM r)
  SELECT m, round(q, 6) AS pooled_estimate, round(u, 6) AS within_variance, round(b, 6) AS between_variance, round(t, 6) AS total_variance, round(sqrt(t), 6) AS std_error, round(df, 4) AS df, round((r + 2 / (df + 3)) / (r + 1), 6) AS fmi FROM d""")
def rubin_pool(df):
    parts = df.groupBy((F.col("event_id") % 5).alias("i")).agg(F.avg("value").alias("q"), (F.var_samp("value") / F.count("value")).alias("u"))
    p = parts.agg(F.count(F.lit(1)).alias("m"), F.avg("q").alias("q"), F.avg("u").alias("u"), F.var_samp("q").alias("b"))
    p = p.withColumn("t", F.expr("u + (1 + 1 / m) * b")).withColumn("r", F.expr("(1 + 1 / m) * b / u")).withColumn("df", F.expr("(m - 1) * power(1 + 1 / r, 2)"))
    return p.select("m", *(F.round(F.expr(e), k).alias(n) for e, k, n in (("q", 6, "pooled_estimate"), ("u", 6, "within_variance"), ("b", 6, "between_variance"), ("t", 6, "total_variance"), ("sqrt(t)", 6, "std_error"), ("df", 4, "df"), ("(r + 2 / (df + 3)) / (r + 1)", 6, "fmi"))))


@query("events_gap", f"{_MNAR}, p AS (SELECT (SELECT delta FROM t WHERE outside_ci AND delta <> 0 ORDER BY abs(delta), delta LIMIT 1) AS tipping_point) SELECT 'value' AS column_name, tipping_point FROM p")
def mnar_fragile_first(df):
    return sensitivity.fragile_first(df, ["value"]).select(F.col("column").alias("column_name"), "tipping_point")


@query("customer_gap", """WITH f AS (SELECT coalesce(acctbal, (SELECT median(acctbal) FROM customer_gap)) AS v FROM customer_gap)
  SELECT 'before' AS stage, count(acctbal) AS n, count(*) - count(acctbal) AS n_missing, round(avg(acctbal), 6) AS mean, median(acctbal) AS median, round(stddev_pop(acctbal), 6) AS std, min(acctbal) AS min, max(acctbal) AS max FROM customer_gap
  UNION ALL SELECT 'after', count(v), 0, round(avg(v), 6), median(v), round(stddev_pop(v), 6), min(v), max(v) FROM f""")
def before_after_stats(df):
    out = sensitivity.before_after(df, impute.fill(df, "acctbal", "numeric_median"), "acctbal")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("doc_labels", "SELECT source AS value, count(*) AS n, count(*) / (SELECT count(source) FROM doc_labels) AS share FROM doc_labels WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, value LIMIT 8")
def value_counts_topk(df):
    return profile.value_counts(df, "source", 8)


@query("events_gap", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events_gap)
  SELECT CAST(least(29, floor((value - lo) / (hi - lo) * 30)) AS INTEGER) AS bin, count(*) AS n FROM events_gap, e WHERE value IS NOT NULL GROUP BY 1""")
def histogram30(df):
    return profile.histogram(df, "value", 30)


@query("customer_gap", """WITH a AS (SELECT acctbal AS v FROM customer_gap WHERE acctbal IS NOT NULL), b AS (SELECT coalesce(acctbal, (SELECT median(acctbal) FROM customer_gap)) AS v FROM customer_gap),
  u AS (SELECT v, 1 AS x, 0 AS y FROM a UNION ALL SELECT v, 0, 1 FROM b), g AS (SELECT v, sum(x) AS x, sum(y) AS y FROM u GROUP BY v),
  r AS (SELECT abs(sum(x) OVER (ORDER BY v) / (SELECT count(*) FROM a) - sum(y) OVER (ORDER BY v) / (SELECT count(*) FROM b)) AS d FROM g)
  SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM b) AS m, round(max(d), 9) AS statistic FROM r""")
def ks_statistic(df):
    return sensitivity.ks_statistic(df, impute.fill(df, "acctbal", "numeric_median"), "acctbal").withColumn("statistic", F.round("statistic", 9))


@query("customer_comiss", "SELECT CAST(0 AS BIGINT) AS residual_missing, CAST(0 AS BIGINT) AS bad_indicators, CAST(0 AS BIGINT) AS dropped_present, CAST(0 AS BIGINT) AS target_changed")
def verify_imputation(df):
    plan = {"columns": {"segment": {"strategy": "structural_none_token_plus_indicator"}, "acctbal": {"strategy": "numeric_median_plus_indicator"}}}
    after = impute.PlanImputer.from_plan(plan).fit(df).transform(df)
    return impute.violations(df, after, plan, "c_custkey", "c_nationkey")


_SUMMARY = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM orders_gap" for c in ("o_orderkey", "o_orderpriority", "o_orderstatus"))


@query("orders_gap", _SUMMARY)
def column_summary(df):
    return profile.column_summary(df.drop("price")).select(F.col("column").alias("column_name"), "n_unique", "min", "max")


@query("customer_comiss", "SELECT count(*) - count(segment) + count(*) - count(acctbal) AS remaining FROM customer_comiss")
def remaining_missing(df):
    return profile.summary(df).select(F.col("total_missing_cells").alias("remaining"))


@query("doc_labels", f"WITH p AS ({_DOCS}), q AS (SELECT column_name, n_missing / n_total AS missing_rate, round(n_missing / n_total, 4) AS r FROM p WHERE n_missing > 0) SELECT column_name, missing_rate, {_SEVERITY} AS severity FROM q")
def chart_missingness_bar(df):
    return charts.missingness_bar(df).withColumnRenamed("column", "column_name")


@query("customer_comiss", "SELECT 'segment' AS a, 'acctbal' AS b, 1.0::DOUBLE AS r")
def chart_missing_correlation(df):
    return charts.missing_correlation(df).withColumn("r", F.round("r", 9))


@query("events_target", "SELECT 'feat' AS column_name, CAST(feat IS NULL AS INTEGER) AS missing, count(*) AS n, round(avg(target), 6) AS target_mean FROM events_target GROUP BY 2")
def chart_target_signal(df):
    return charts.target_signal(df, "target", ["feat"]).select(F.col("column").alias("column_name"), "missing", "n", F.round("target_mean", 6).alias("target_mean"))


@query("doc_labels", "SELECT " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")) + " FROM doc_labels ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42')), doc_id LIMIT 300")
def chart_pattern_matrix(df):
    return charts.pattern_matrix(df, ["doc_id"])


#: The audited views with their targets. Their evidence has tests that SQL cannot state; the decisions on given
#: evidence are stated by the rule queries below.
_PLANNED = (("orders_gap", None), ("customer_gap", None), ("lineitem_gap", None), ("part_gap", None), ("customer_comiss", None), ("events_target", "target"), ("orders_sparse", "target"), ("doc_labels", None))


def _plans(spark: SparkSession, sf_dir: str):
    for name, target in _PLANNED:
        found = mechanism(view(spark, sf_dir, name), target)
        yield name, found, make_plan(found)


def plan_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy of every column of the audited views."""
    rows = [(v, c, p["strategy"], p["mechanism_label"], bool(p["add_missing_indicator"])) for v, _, plan in _plans(spark, sf_dir) for c, p in plan["columns"].items()]
    return spark.createDataFrame(rows, "view string, column_name string, strategy string, mechanism_label string, add_missing_indicator boolean")


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each strategy is planned over the audited views."""
    return plan_strategies(spark, sf_dir).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


def mi_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(v, c, bool(p["mi_upgrade_recommended"])) for v, _, plan in _plans(spark, sf_dir) for c, p in plan["columns"].items()]
    return spark.createDataFrame(rows, "view string, column_name string, mi_upgrade_recommended boolean")


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(v, f["column"], f["strategy"], f["leakage_risk"]) for v, _, plan in _plans(spark, sf_dir) for f in leakage_findings(plan)["findings"]]
    return spark.createDataFrame(rows, "view string, column_name string, strategy string, leakage_risk string")


def mechanism_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(v, e.column, mechanism_label(e), e.mar_p, e.target_p, e.max_r) for v, found, _ in _plans(spark, sf_dir) for e in found if e.n_missing]
    return spark.createDataFrame(rows, "view string, column_name string, mechanism_label string, mar_p double, target_p double, max_r double")


QUERIES |= {"plan_strategies": plan_strategies, "plan_summary": plan_summary, "mi_upgrade": mi_upgrade, "leakage_findings": leakage, "mechanism_labels": mechanism_labels}


#: Combinations of evidence on a column, in both dialects.
_GRID = """WITH k(kind, is_numeric, high_cardinality, is_target) AS (VALUES ('n', TRUE, FALSE, FALSE), ('c', FALSE, FALSE, FALSE), ('h', FALSE, TRUE, FALSE), ('t', TRUE, FALSE, TRUE)),
  m(n_missing) AS (VALUES (0), (3), (10), (25), (40), (81), (100)), st(structural) AS (VALUES (CAST(NULL AS VARCHAR(30))), ('structural_absence'), ('co_missing_structural')),
  g(group_col, group_significant) AS (VALUES (CAST(NULL AS VARCHAR(30)), FALSE), ('region', FALSE), ('region', TRUE)),
  t(target_p, target_effect) AS (VALUES (CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)), (NULL, 0.25), (0.5, 0.25), (0.01, 0.02)),
  p(mar_p) AS (VALUES (CAST(NULL AS DOUBLE)), (0.01), (0.6)), r(max_r) AS (VALUES (0.0), (0.2), (0.45)), d(temporal) AS (VALUES (TRUE), (FALSE)),
  e AS (SELECT concat_ws('/', kind, CAST(n_missing AS VARCHAR(9)), coalesce(structural, '-'), coalesce(group_col, '-'), CAST(group_significant AS VARCHAR(9)), coalesce(CAST(target_p AS VARCHAR(9)), '-'),
    coalesce(CAST(target_effect AS VARCHAR(9)), '-'), coalesce(CAST(mar_p AS VARCHAR(9)), '-'), CAST(max_r AS VARCHAR(9)), CAST(temporal AS VARCHAR(9))) AS column_name, *, n_missing / 100.0 AS missing_rate
    FROM k CROSS JOIN m CROSS JOIN st CROSS JOIN g CROSS JOIN t CROSS JOIN p CROSS JOIN r CROSS JOIN d)"""
_DECIDED = f"""{_GRID}, s AS (SELECT *, {SIGNALS_SQL} FROM e), l AS (SELECT *, {LABEL_SQL} AS label FROM s),
  x AS (SELECT *, {STRATEGY_SQL} AS strategy, {MI_SQL} AS mi_upgrade_recommended FROM l)"""


def _grid(spark: SparkSession) -> list[tuple[Evidence, str | None]]:
    """The combinations as evidence, and their domain tags."""
    tag = sorted(TEMPORAL_TAGS)[0]
    return [(Evidence(
        r["column_name"], r["is_numeric"], r["n_missing"], float(r["missing_rate"]), r["high_cardinality"], r["is_target"], r["structural"], r["group_col"], r["group_significant"],
        None if r["target_p"] is None else float(r["target_p"]), None if r["target_effect"] is None else float(r["target_effect"]), None if r["mar_p"] is None else float(r["mar_p"]), float(r["max_r"]),
    ), tag if r["temporal"] else None) for r in spark.sql(f"{_GRID} SELECT * FROM e").collect()]


def rule(sql: str):
    """Register rules over the evidence grid with SQL that may refer to ``x``, the decided grid."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(spark, _grid(spark))
        ORACLE_SQL[fn.__name__] = f"{_DECIDED} {sql}"
        return fn

    return add


@rule(f"SELECT column_name, label, {EFFECTIVE_SQL} AS effective_label, {NOTE_SQL} AS robustness_note FROM x")
def rule_labels(spark, grid):
    return spark.createDataFrame([(e.column, mechanism_label(e), effective_label(e), robustness_note(e)) for e, _ in grid], "column_name string, label string, effective_label string, robustness_note string")


def _grid_plan(grid) -> dict:
    return make_plan([e for e, _ in grid], {e.column: tag for e, tag in grid if tag})


@rule("SELECT column_name, strategy, contains(strategy, 'plus_indicator') AS add_missing_indicator, CASE WHEN starts_with(strategy, 'groupwise') THEN group_col END AS group_col FROM x")
def rule_strategies(spark, grid):
    rows = [(c, p["strategy"], bool(p["add_missing_indicator"]), p["group_col"]) for c, p in _grid_plan(grid)["columns"].items()]
    return spark.createDataFrame(rows, "column_name string, strategy string, add_missing_indicator boolean, group_col string")


@rule("SELECT column_name, mi_upgrade_recommended FROM x")
def rule_mi_upgrade(spark, grid):
    return spark.createDataFrame([(e.column, recommend_mi(e)) for e, _ in grid], "column_name string, mi_upgrade_recommended boolean")


@rule("SELECT strategy, count(*) AS n FROM x GROUP BY strategy")
def rule_plan_summary(spark, grid):
    return spark.createDataFrame(list(summed(_grid_plan(grid)["columns"])["strategy_counts"].items()), "strategy string, n long")


@rule("""SELECT unnest(['columns', 'with_missing', 'dropped', 'structural', 'imputed', 'with_indicator', 'mi_recommended']) AS step,
  unnest([count(*), count(*) FILTER (WHERE n_missing > 0), count(*) FILTER (WHERE strategy = 'drop_column'), count(*) FILTER (WHERE starts_with(strategy, 'structural')),
  count(*) FILTER (WHERE strategy NOT IN ('drop_column', 'no_imputation_needed')), count(*) FILTER (WHERE contains(strategy, 'plus_indicator')), count(*) FILTER (WHERE mi_upgrade_recommended)]) AS n FROM x""")
def chart_decision_flow(spark, grid):
    return charts.decision_flow_frame(spark, decision_flow(_grid_plan(grid)))


@rule("SELECT column_name, CASE WHEN strategy IN ('drop_column', 'no_imputation_needed') THEN 'none' ELSE 'low' END AS leakage_risk FROM x")
def rule_leakage(spark, grid):
    return spark.createDataFrame([(f["column"], f["leakage_risk"]) for f in leakage_findings(_grid_plan(grid))["findings"]], "column_name string, leakage_risk string")


@query("orders_gap", f"WITH p AS ({_ORDERS}) SELECT column_name, CASE WHEN dtype_category = 'numeric' THEN 'pmm' WHEN unique_count = 2 THEN 'logreg' WHEN column_name = 'o_orderpriority' THEN 'polyr' ELSE 'polyreg' END AS method FROM p")
def mice_methods(df):
    rows = [(r["column"], mice_method(r["dtype_category"] == "numeric", r["unique_count"], r["column"] == "o_orderpriority")) for r in profile.profile(df).collect()]
    return df.sparkSession.createDataFrame(rows, "column_name string, method string")


#: A target of up to 3,000 classes that has nothing to do with the gaps, and its test over all of them.
_MANY = """WITH c AS (SELECT CAST(o_orderkey * 7919 % 3000 AS VARCHAR) AS l, count(*) - count(price) AS a, count(price) AS b FROM orders_gap GROUP BY 1), s AS (SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS k FROM c),
  x AS (SELECT a - (a + b) * sa / (sa + sb) AS ga, (a + b) * sa / (sa + sb) AS ea, b - (a + b) * sb / (sa + sb) AS gb, (a + b) * sb / (sa + sb) AS eb FROM c, s)"""


@query("orders_gap", f"{_MANY} SELECT round(sum(ga * ga / ea + gb * gb / eb), 6) AS statistic, (SELECT k FROM s) - 1 AS df FROM x")
def chi2_many_classes(df):
    many = df.withColumn("class", (F.col("o_orderkey") * 7919 % 3000).cast("string"))
    return evidence.chi2_frame(evidence.contingency(many, "price", "class")).select(F.round("statistic", 6).alias("statistic"), "df")


@query("orders_gap", """WITH b AS (SELECT CASE WHEN o_orderkey % 5 IN (1, 2) THEN NULL ELSE CAST(o_orderkey % 2000 AS VARCHAR) END AS v FROM orders_gap), a AS (SELECT coalesce(v, 'MISSING') AS v FROM b)
  SELECT 'class: over 30 % are MISSING' AS alert FROM a HAVING count(*) FILTER (WHERE v = 'MISSING') > 0.3 * count(*)""")
def drift_alerts_many_values(df):
    before = df.select(F.when(F.col("o_orderkey") % 5 >= 3, (F.col("o_orderkey") % 2000).cast("string")).when(F.col("o_orderkey") % 5 == 0, (F.col("o_orderkey") % 2000).cast("string")).alias("class"))
    alerts = sensitivity.categorical_alerts(before, before.fillna("MISSING"), "class")
    return df.sparkSession.createDataFrame([(a,) for a in alerts], "alert string")


#: With one incomplete column the estimates have a closed form, which EM nears to some seven digits, and so has the test.
@query("customer_comiss", """WITH c AS (SELECT *, acctbal IS NULL AS gone FROM customer_comiss), a AS (SELECT count(*) AS n, avg(c_custkey) AS mx, avg(c_nationkey) AS my, var_pop(c_custkey) + 1e-6 AS xx, var_pop(c_nationkey) + 1e-6 AS yy, covar_pop(c_custkey, c_nationkey) AS xy FROM c),
  p AS (SELECT gone, count(*) AS k, avg(c_custkey) AS x, avg(c_nationkey) AS y FROM c GROUP BY gone),
  d AS (SELECT sum(k * (yy * (x - mx) * (x - mx) - 2 * xy * (x - mx) * (y - my) + xx * (y - my) * (y - my)) / (xx * yy - xy * xy)) AS statistic FROM p, a)
  SELECT TRUE AS applicable, round(statistic, 4) AS statistic, 2 AS df, round(exp(-statistic / 2), 6) AS p_value FROM d""")
def little_mcar(df):
    r = evidence.little_mcar(df, ["c_custkey", "c_nationkey", "acctbal"])
    rounded = lambda name, k: None if r.get(name) is None else round(r[name], k)
    return df.sparkSession.createDataFrame([(bool(r["applicable"]), rounded("statistic", 4), r.get("df"), rounded("p_value", 6))], "applicable boolean, statistic double, df int, p_value double")


@query("customer_gap", """WITH o AS (SELECT covar_pop(c_nationkey, acctbal) / var_pop(c_nationkey) AS b, avg(acctbal) AS my, avg(c_nationkey) AS mx, var_pop(acctbal) - covar_pop(c_nationkey, acctbal) * covar_pop(c_nationkey, acctbal) / var_pop(c_nationkey) AS rest
    FROM customer_gap WHERE acctbal IS NOT NULL), a AS (SELECT avg(c_nationkey) AS m, var_pop(c_nationkey) AS v FROM customer_gap)
  SELECT 'c_nationkey' AS column_name, round(m, 2) AS mean, round(v, 2) AS cov_c_nationkey, round(b * v, 1) AS cov_acctbal FROM o, a UNION ALL SELECT 'acctbal', round(my + b * (m - mx), 2), round(b * v, 1), round(rest + b * b * v, -2) FROM o, a""")
def em_mean_cov(df):
    mu, sigma = stats.em_normal(evidence.collect_patterns(df, ["c_nationkey", "acctbal"]))
    rows = [(c, round(float(mu[k]), 2), round(float(sigma[k, 0]), (2, 1)[k]), round(float(sigma[k, 1]), (1, -2)[k])) for k, c in enumerate(("c_nationkey", "acctbal"))]
    return df.sparkSession.createDataFrame(rows, "column_name string, mean double, cov_c_nationkey double, cov_acctbal double")


@query("lineitem_gap")
def logistic_lr(df):
    r = evidence.logistic_lr(df, "discount", ["l_quantity", "l_extendedprice", "l_tax"])
    return df.sparkSession.createDataFrame([(r["statistic"], r["df"], r["p_value"])], "statistic double, df int, p_value double")


#: With one covariate of two values the fitted chances are the shares, which gives the ratio of likelihoods.
@query("orders_gap", """WITH g AS (SELECT o_orderpriority = '1-URGENT' AS u, count(*) AS n, count(*) - count(price) AS a, count(price) AS b FROM orders_gap GROUP BY 1), s AS (SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b FROM g)
  SELECT round(2 * (sum(g.a * ln(g.a / g.n) + g.b * ln(g.b / g.n)) - (max(s.a) * ln(max(s.a) / max(s.n)) + max(s.b) * ln(max(s.b) / max(s.n)))), 2) AS statistic, 1 AS df FROM g, s""")
def logistic_lr_two_groups(df):
    r = evidence.logistic_lr(df.withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("int")), "price", ["urgent"])
    return df.sparkSession.createDataFrame([(round(r["statistic"], 2), r["df"])], "statistic double, df int")


@query("customer_gap")
def mice_draws(df):
    return ChainedImputer(m=3, max_iter=5, key=["c_custkey"]).fit(df, ["c_nationkey", "acctbal"]).draws(df, ["acctbal"])


@query("customer_gap")
def mice_pool_means(df):
    rows = pool_means(df, ["acctbal"], m=3, max_iter=5, key=["c_custkey"])
    return df.sparkSession.createDataFrame([(r["column"], r["pooled_estimate"], r["std_error"], r["naive_se"], r["fraction_missing_information"]) for r in rows], "column_name string, pooled_estimate double, std_error double, naive_se double, fmi double")


@query("lineitem_gap")
def model_based_fill(df):
    return impute.fill(df, "discount", "model_based_imputation_optional")


@query("customer_gap", """WITH d AS (SELECT g.c_custkey AS k, d.acctbal AS v, row_number() OVER (PARTITION BY g.c_custkey ORDER BY (g.c_custkey - d.c_custkey) * (g.c_custkey - d.c_custkey) + (g.c_nationkey - d.c_nationkey) * (g.c_nationkey - d.c_nationkey), d.acctbal) AS n
    FROM customer_gap g JOIN customer_gap d ON g.acctbal IS NULL AND d.acctbal IS NOT NULL), m AS (SELECT k, avg(v) AS v FROM d WHERE n <= 5 GROUP BY k)
  SELECT c_custkey, c_nationkey, c_mktsegment, round(coalesce(acctbal, v), 6) AS acctbal FROM customer_gap LEFT JOIN m ON k = c_custkey""")
def knn_impute(df):
    return knn_fill(df, df, ["acctbal"]).withColumn("acctbal", F.round("acctbal", 6))


QUERIES["knn_fill"], ORACLE_SQL["knn_fill"] = QUERIES.pop("knn_impute"), ORACLE_SQL.pop("knn_impute")
__all__ = ["ORACLE_SQL", "QUERIES", "VIEWS", "Evidence"]
