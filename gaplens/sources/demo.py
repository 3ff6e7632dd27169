"""Seeded demonstration tables: one for each mechanism, a mixed one and a panel in time.

Numbers are hashed from a row's number and the seed, so a table is the same on any
cluster and may have any number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, name: str) -> Column:
    """A number from 0 to 1 for each row's ``id``."""
    return (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(name)), 11).cast("double") + 0.5) / float(2**53)


def normal(seed: int, name: str, mean: float = 0.0, sd: float = 1.0) -> Column:
    """A normal number by Box and Muller."""
    return mean + sd * F.sqrt(-2 * F.log(uniform(seed, name))) * F.cos(2 * math.pi * uniform(seed, name + "~"))


def _pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.floor(u * len(values)) + 1).cast("int"))


def random_gaps(spark: SparkSession, rows: int = 800, seed: int = 42) -> DataFrame:
    """7 % of ``measurement_a`` missing at random."""
    u = lambda name: uniform(seed, name)
    a = F.when(u("gap") >= 0.07, normal(seed, "a", 10, 2))
    return spark.range(rows).select(a.alias("measurement_a"), normal(seed, "b", 5, 1).alias("measurement_b"), normal(seed, "c", 0, 3).alias("measurement_c"), normal(seed, "t", 100, 15).alias("target"))


def explained_gaps(spark: SparkSession, rows: int = 800, seed: int = 0) -> DataFrame:
    """``income`` missing where ``education_level`` is 0."""
    df = spark.range(rows).withColumn("education_level", F.floor(uniform(seed, "education") * 3).cast("double"))
    income = F.when(F.col("education_level") > 0, normal(seed, "income", 60_000, 15_000))
    return df.select("education_level", income.alias("income"), F.greatest(F.lit(0.0), normal(seed, "years", 8, 4)).alias("years_experience"), normal(seed, "t").alias("target"))


def target_gaps(spark: SparkSession, rows: int = 800, seed: int = 7) -> DataFrame:
    """``credit_score`` missing where the target is 1."""
    df = spark.range(rows).withColumn("target", (uniform(seed, "t") < 0.30).cast("double"))
    score = F.when(F.col("target") == 0, normal(seed, "score", 650, 80))
    return df.select(score.alias("credit_score"), F.greatest(F.lit(0.0), normal(seed, "age", 5, 2)).alias("account_age_years"), "target")


def structural_gaps(spark: SparkSession, rows: int = 200, seed: int = 1) -> DataFrame:
    """``facility_type`` missing and ``facility_capacity`` 0 in two of five rows, which have no facility."""
    has = F.col("id") % 5 < 3
    kind = F.when(has, _pick(["covered", "open"], uniform(seed, "kind")))
    size = F.when(has, 10 + F.floor(90 * uniform(seed, "capacity"))).otherwise(0).cast("int")
    return spark.range(rows).select(kind.alias("facility_type"), size.alias("facility_capacity"), F.greatest(F.lit(400.0), normal(seed, "sqft", 1500, 400)).alias("property_size_sqft"), normal(seed, "t", 300_000, 80_000).alias("target"))


def mixed_gaps(spark: SparkSession, rows: int = 600, seed: int = 42) -> DataFrame:
    """All of these in one table of eight columns."""
    u = lambda name: uniform(seed, name)
    df = spark.range(rows).withColumn("education_level", F.floor(u("education") * 4) + 1).withColumn("target", (u("t") < 0.4).cast("double")).withColumn("has", u("has") < 0.6)
    return df.select(
        F.when(u("g1") >= 0.10, normal(seed, "age", 45, 12)).alias("age"),
        F.when((F.col("education_level") > 2) | (u("g2") >= 0.35), normal(seed, "income", 55_000, 12_000)).alias("income"),
        F.col("education_level").cast("double").alias("education_level"),
        F.when((F.col("target") == 0) | (u("g3") >= 0.4), normal(seed, "risk", 50, 10)).alias("risk_score"),
        F.when(F.col("has"), 20 + 80 * u("area")).otherwise(0.0).alias("facility_area"),
        F.when(F.col("has"), _pick(["excellent", "fair", "good", "poor"], u("quality"))).alias("facility_quality"),
        normal(seed, "other").alias("other_score"), "target",
    )


def panel(spark: SparkSession, states: int = 15, weeks: int = 52, seed: int = 2026) -> DataFrame:
    """States by weeks: rates with gaps by state and size, gaps of several weeks, and a structural pair."""
    u = lambda name: uniform(seed, name)
    df = spark.range(states * weeks).withColumn("s", F.floor(F.col("id") / weeks)).withColumn("week", (F.col("id") % weeks + 1).cast("int"))
    rate = 8 + F.col("s") * 0.5 + 2 * F.sin(2 * math.pi * F.col("week") / 52) + normal(seed, "rate", 0, 1)
    df = df.withColumn("rate", rate)
    later = F.pmod(F.xxhash64("s", F.floor(F.col("week") / 4), F.lit(seed)), F.lit(10))
    has = F.col("s") % 3 != 0
    return df.select(
        F.concat(F.lit("state_"), F.lpad(F.col("s").cast("string"), 2, "0")).alias("state"), "week", (20 + F.col("s") * 3.5).alias("population_100k"),
        F.when((F.col("s") % 5 != 0) | (u("g1") >= 0.5), F.when((F.col("rate") < 15) | (u("g2") >= 0.6), F.col("rate"))).alias("ed_visit_rate"),
        F.when(later > 0, normal(seed, "nal", 24, 6)).alias("naloxone_admin_rate"),
        F.when(has, _pick(["clinic", "mobile", "pharmacy"], u("kind"))).alias("subprogram_type"), F.when(has, 5 + 5 * u("sub")).otherwise(0.0).alias("copresent_subrate"),
    )


TABLES = {"random": random_gaps, "explained": explained_gaps, "target": target_gaps, "structural": structural_gaps, "mixed": mixed_gaps, "panel": panel}
