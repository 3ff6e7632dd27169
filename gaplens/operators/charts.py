"""The data behind each chart; drawing it is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evidence as ev
from .columns import missing, q
from .profile import profile


def missingness_bar(df: DataFrame) -> DataFrame:
    """(column, missing_rate, severity) of columns with missing values, most first."""
    return profile(df, distinct=None).where("n_missing > 0").orderBy(F.desc("missing_rate"), "column").select("column", "missing_rate", "severity")


def pattern_matrix(df: DataFrame, key: list[str], rows: int = 300, columns: int = 50, seed: int = 42) -> DataFrame:
    """0/1 flags of a few rows, chosen by a hash of their key."""
    shown = df.columns[:columns]
    order = F.md5(F.concat_ws("|", *(F.col(q(k)).cast("string") for k in key), F.lit(str(seed))))
    return df.orderBy(order, *(F.col(q(k)) for k in key)).limit(rows).select(*(missing(df, c).cast("int").alias(c) for c in shown))


def target_signal(df: DataFrame, target: str, columns: list[str], most: int = 12) -> DataFrame:
    """(column, missing, n, target_mean) for the first columns with both sides."""
    out = None
    for c in columns[:most]:
        part = ev.target_split(df, c, target).select(F.lit(c).alias("column"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def missing_correlation(df: DataFrame, least: float = 0.5, top: int = 3) -> DataFrame:
    """The pairs of columns whose missingness correlates most, over ``least``."""
    pairs = ev.indicator_matrix(df).where("a <> b").where(F.abs("r") > least)
    return pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def decision_flow_frame(spark: SparkSession, steps: list[tuple[str, int]]) -> DataFrame:
    """(step, n): how many columns reach each step of the decisions."""
    return spark.createDataFrame(steps, "step string, n long")


def suggest(df: DataFrame, target: str | None, n_gaps: int) -> list[str]:
    """Charts worth drawing for a table."""
    out = ["missingness_bar"] if n_gaps else []
    out += ["pattern_matrix", "missing_correlation"] if n_gaps > 1 else []
    out += ["target_signal"] if n_gaps and target else []
    return [*out, "decision_flow"]
