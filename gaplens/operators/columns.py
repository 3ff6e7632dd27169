"""Column roles and the one meaning of "missing": null, and NaN in floating columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
FLOATING = (T.DoubleType, T.FloatType)
SUFFIX = "_was_missing"


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null; decimals become double."""
    out = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, FLOATING):
            c = F.when(F.isnan(c), None).otherwise(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def missing(df: DataFrame, name: str) -> Column:
    c = F.col(q(name))
    return c.isNull() | F.isnan(c) if isinstance(df.schema[name].dataType, FLOATING) else c.isNull()


def is_numeric(df: DataFrame, name: str, n_missing: int = 0) -> bool:
    """Numbers are numeric, complete booleans too; all else is categorical."""
    kind = df.schema[name].dataType
    return isinstance(kind, T.NumericType) or (isinstance(kind, T.BooleanType) and not n_missing)


def is_nested(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NESTED)


def numeric_columns(df: DataFrame, target: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target]


def categorical_columns(df: DataFrame, target: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.NumericType, *NESTED)) and f.name != target]


def indicator(df: DataFrame, name: str) -> Column:
    return missing(df, name).cast("int").alias(name + SUFFIX)


def number(name: str) -> Column:
    return F.col(q(name)).cast("double")
