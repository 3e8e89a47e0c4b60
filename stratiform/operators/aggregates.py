from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.functions.casting import mean


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def group_mean(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    name: str,
    missing_as_zero: bool = False,
) -> DataFrame:
    """Mean per key. Missing values are skipped, or counted as 0 on request; NaN is skipped.

    Partial sums are formed before the shuffle, so a hot key arrives as one row per task.
    Sort the result only to present it.
    """
    column = F.coalesce(F.col(value), F.lit(0)) if missing_as_zero else F.col(value)
    return df.groupBy(*keys).agg(mean(column).alias(name))
