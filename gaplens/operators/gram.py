"""Sums of products between many columns by one scan."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cross_sums(df: DataFrame, left: list[Column], right: list[Column]) -> np.ndarray:
    """The matrix of the sums of ``left[i] * right[j]`` over all rows; nulls count as zero.

    Each task multiplies its batches as matrices and gives one row for each pair, so what
    moves is as large as the result, whatever the table. The result reaches the driver.
    """
    p, n = len(left), len(right)
    rows = df.select(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"c{k}") for k, c in enumerate([*left, *right])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, n))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            total += np.array(columns[:p]).reshape(p, -1) @ np.array(columns[p:]).reshape(n, -1).T
        at, to = np.indices((p, n))
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (at.astype(np.int32), to.astype(np.int32), total)], names=["i", "j", "s"])

    out = np.zeros((p, n))
    for r in rows.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return out
