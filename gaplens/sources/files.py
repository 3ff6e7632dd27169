"""Reading and writing files the way the audit expects."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that stand for a missing value in CSV files.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A CSV file with a header; NA tokens become null, then columns of whole or decimal numbers are cast.

    Two passes over the file: one aggregate decides every column's type. Quoted line feeds
    need ``multi_line``, which reads a file in one task; not given, it is chosen where a line
    has an odd number of quotes, found by one more pass.
    """
    if multi_line is None:
        odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(odd % 2 == 1).isEmpty()
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, quote='"', escape='"')
    clean = raw.select(*(F.when(F.col(f"`{c}`").isin(*NA_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in raw.columns))
    tests = []
    for k, c in enumerate(raw.columns):
        v = F.col(f"`{c}`")
        for name, kind in (("i", "bigint"), ("d", "double")):
            tests.append(F.bool_and(v.try_cast(kind).isNotNull() | v.isNull()).alias(f"{name}{k}"))
        tests.append(F.count(v).alias(f"n{k}"))
    found = clean.agg(*tests).first()
    out = []
    for k, c in enumerate(raw.columns):
        v = F.col(f"`{c}`")
        # a whole-number column with gaps is decimal, so that fitted medians need no rounding
        kind = "double" if not found[f"n{k}"] or found[f"d{k}"] else None
        if kind and found[f"i{k}"] and found[f"n{k}"]:
            kind = "bigint"
        out.append((v.try_cast(kind) if kind else v).alias(c))
    return clean.select(*out)


def write_json(value, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f, indent=2, default=str)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """A folder of CSV parts with headers."""
    plain = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c in df.columns]
    df.select(*plain).write.mode("overwrite").csv(path, header=True)
    return path
