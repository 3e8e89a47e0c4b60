"""Deterministic deduplication of repeated snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str], n: int) -> DataFrame:
    """The ``n`` newest rows of every key (null keys are equal).

    ``newest`` are the columns that make a row newer, most important first; every other
    column then breaks ties, so the choice does not depend on partitioning. The rank
    filter sits directly on the window, which lets Spark cut each key to ``n`` rows per
    map task before the shuffle: a hot key costs at most ``n`` rows per map task.
    """
    ties = [c for c in df.columns if c not in keys and c not in newest]
    order = [F.col(c).desc_nulls_last() for c in (*newest, *ties)]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The newest row of every key, chosen as in ``newest_per_key``.

    Written as an aggregate: it keeps one row per key and task before the shuffle, and
    does so even where the input already is partitioned by the key.
    """
    ties = [c for c in df.columns if c not in keys and c not in newest]
    row = F.max(F.struct(*newest, *ties)).alias("_newest")
    return df.groupBy(*keys).agg(row).select(*keys, "_newest.*").select(*df.columns)


def least_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The least row of every key, all other columns compared in their order; one row per key and task is shuffled."""
    row = F.min(F.struct(*(c for c in df.columns if c not in keys))).alias("_least")
    return df.groupBy(*keys).agg(row).select(*keys, "_least.*").select(*df.columns)
