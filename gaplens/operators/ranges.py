"""Ranges of values: cuts that spread rows evenly, and exact medians without one large buffer."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values up to which one buffer holds them for a median.
SMALL = 1_000_000
#: Least number of ranges, and rows that cuts are chosen from.
PARTS, SAMPLE = 64, 4096


def parts_of(df: DataFrame) -> int:
    """As many ranges as the session has shuffle partitions, 64 at least."""
    return max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rank_among(cuts: Column, value: Column) -> Column:
    """How many of the ascending cuts, given as an array of arrays of ``size`` each, lie below a value: two short searches."""
    block = F.greatest(F.size(F.filter(cuts, lambda c: c[0] < value)) - 1, F.lit(0))
    size = F.size(F.coalesce(F.get(cuts, F.lit(0)), F.array()))
    return F.coalesce(block * size + F.size(F.filter(F.get(cuts, block), lambda x: x < value)), F.lit(0)).cast("int")


def nested(cuts: list) -> list[list]:
    """Ascending cuts in equal arrays, about as many arrays as cuts in each."""
    size = max(1, math.isqrt(len(cuts)))
    return [cuts[at : at + size] for at in range(0, len(cuts), size)]


def with_range(df: DataFrame, keys: list[Column], parts: int, name: str = "part") -> DataFrame:
    """``df`` with the number of a row's range by its keys, nulls first; any orderable keys.

    Cuts come from a random sample of rows: they decide how even the ranges are, nothing else.
    """
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    rows = df.select(key.alias("k")).orderBy(F.rand(1)).limit(SAMPLE).orderBy("k")
    found = [r["k"] for r in rows.collect()]
    cuts = list(dict.fromkeys(found[len(found) * i // parts] for i in range(1, parts))) if found else []
    kind = rows.schema["k"].dataType.simpleString()
    one = df.sparkSession.createDataFrame([(nested(cuts),)], f"_cuts array<array<{kind}>>")
    return df.crossJoin(F.broadcast(one)).withColumn(name, rank_among(F.col("_cuts"), key)).drop("_cuts")


def medians(df: DataFrame, value: Column, group: Column | None = None, small: int = SMALL) -> DataFrame:
    """(g, m): the exact median of each group; null values and groups are left out.

    Few values go through one buffer a group. Many are counted by value and cut into
    ranges; sums of the ranges tell which of them hold a group's middle, and only these
    are sorted, each by itself, so a group with most of the rows is not one task.
    """
    rows = df.select((F.lit(0) if group is None else group).alias("g"), value.cast("double").alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    parts = parts_of(df)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", [k / parts for k in range(1, parts)], 10_000).alias("cuts")).first()
    if told["n"] <= small:
        return rows.groupBy("g").agg(F.median("v").alias("m"))
    cuts = F.lit(nested(sorted(set(told["cuts"])))).cast("array<array<double>>")
    # the term of zero keeps Spark from carrying the part's definition, whose lambdas hide that it needs v, over the join
    part = rank_among(cuts, F.col("v")) + (F.rand() * 0).cast("int")
    counts = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("part", part)
    every = Window.partitionBy("g")
    sums = counts.groupBy("g", "part").agg(F.sum("n").alias("s"))
    sums = sums.withColumn("total", F.sum("s").over(every)).withColumn("upto", F.sum("s").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.select(F.col("g").alias("g2"), F.col("part").alias("part2"), (F.col("upto") - F.col("s")).alias("before"), "upto", F.expr("(total - 1) div 2").alias("low"), F.expr("total div 2").alias("high"))
    middle = counts.join(sums.where("upto > low AND before <= high"), (F.col("g") == F.col("g2")) & (F.col("part") == F.col("part2")))
    seen = F.col("before") + F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ends = middle.withColumn("seen", seen).groupBy("g").agg(F.min(F.when(F.col("seen") > F.col("low"), F.col("v"))).alias("a"), F.min(F.when(F.col("seen") > F.col("high"), F.col("v"))).alias("b"))
    return ends.select("g", (0.5 * F.col("a") + 0.5 * F.col("b")).alias("m"))
