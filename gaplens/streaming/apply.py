"""A fitted imputation over a stream.

Applying fitted values needs no state: literals are projections, group medians a
stream-static join. Filling in order and nearest neighbours need other rows and are
refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.impute import Fitted


def impute_stream(stream: DataFrame, fitted: Fitted) -> DataFrame:
    """The stream with its gaps filled by statistics of the training table."""
    bad = [s.column for s in fitted.steps if s.strategy.startswith(("time_series", "knn"))]
    if bad:
        raise ValueError(f"cannot fill {', '.join(bad)} on a stream: the strategy looks at other rows")
    return fitted.transform(stream)
