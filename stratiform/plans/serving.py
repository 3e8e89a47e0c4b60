"""Gold rows to versioned serving cells.

The cells table is an append log of puts (``operators.puts``) with a folder per run and family:
writing a run again replaces that run only. Reading resolves versions, and ``compact`` replaces
the runs by one that holds no more than the retained versions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions.text import row_key
from stratiform.operators import puts
from stratiform.operators.cells import CELL, MAX_VERSIONS, newest_versions
from stratiform.plans.fixed import SERVING_FAMILIES
from stratiform.sinks import WIDE, delete_folder, new_batch, replace_folder
from stratiform.sources.envelope import list_files
from stratiform.sources.tables import read_table

# The columns that a row key is made of.
KEY_PARTS = ["flight_icao", "departure_scheduled"]
RUN = "run_id"
CELLS = "row_key STRING, family STRING, qualifier STRING, value STRING, version_ts TIMESTAMP"


def keyed(
    gold: DataFrame,
    families: Mapping[str, Sequence[str]] = SERVING_FAMILIES,
    key_parts: Sequence[str] = KEY_PARTS,
    version: str = "timestamp",
) -> DataFrame:
    """The family columns with their row key and version."""
    return gold.select(
        row_key(*key_parts).alias("row_key"),
        *(c for columns in families.values() for c in columns),
        F.col(version).alias("version_ts"),
    )


def write_puts(table: DataFrame, path: str, run_id: str, fresh: bool = False) -> None:
    """Add one run to the table; a run of this name is replaced, others stay unless ``fresh``."""
    others = _others(table.sparkSession, path, run_id, fresh)
    table.write.partitionBy("family").option("partitionOverwriteMode", "static").mode("overwrite").parquet(
        f"{path}/{RUN}={run_id}"
    )
    _drop(table.sparkSession, path, others)


def write_wide(wide: DataFrame, families: Mapping[str, Sequence[str]], path: str, run_id: str, fresh: bool = False) -> None:
    """``write_puts`` of wide rows that are read from a table, family by family: nothing is sorted or spilled for the folders.

    The run is written aside and put in place when it is whole.
    """
    spark = wide.sparkSession
    others, aside = _others(spark, path, run_id, fresh), f"{path}/_{RUN}-{new_batch()}"
    try:
        for family, columns in families.items():
            rows = puts.wide_to_puts(wide, {family: columns}).drop("family")
            rows.write.options(**WIDE).parquet(f"{aside}/family={family}")
        replace_folder(spark, f"{path}/{RUN}={run_id}", aside)
    finally:
        delete_folder(spark, aside)
    _drop(spark, path, others)


def _others(spark: SparkSession, path: str, run_id: str, fresh: bool) -> list[str]:
    return [run for run in _runs(spark, path) if run != run_id] if fresh else []


def _drop(spark: SparkSession, path: str, runs: Sequence[str]) -> None:
    for run in runs:
        delete_folder(spark, f"{path}/{RUN}={run}")


def write_cells(cells: DataFrame, path: str, run_id: str, fresh: bool = False) -> None:
    """``write_puts`` of single cells (row_key, family, qualifier, value, version_ts)."""
    write_puts(puts.cells_to_puts(cells), path, run_id, fresh)


def _runs(spark: SparkSession, path: str) -> list[str]:
    """Names of the runs, from the folders."""
    files = list_files(spark, f"{path}/{RUN}=*/*/*.parquet")
    names = files.select(F.regexp_extract("path", f"{RUN}=([^/]+)/", 1).alias("run")).distinct().collect()
    return [row["run"] for row in names]


def read_cells(spark: SparkSession, path: str, versions: int = MAX_VERSIONS) -> DataFrame:
    """Retained versions of every cell. Versions of one time are one version."""
    table = read_table(spark, path)
    if table is None:
        return spark.createDataFrame([], CELLS)
    by_time = puts.puts_to_cells(table).groupBy(*CELL, "version_ts").agg(F.max("value").alias("value"))
    return newest_versions(by_time.select(*CELL, "value", "version_ts"), versions)


def scan(
    spark: SparkSession,
    path: str,
    families: Mapping[str, Sequence[str]] = SERVING_FAMILIES,
    limit: int | None = None,
    where: tuple[str, str] | None = None,
    keep_missing: bool = True,
) -> DataFrame:
    """Newest values, one row per key; with ``limit`` the first keys in key order.

    ``where`` is a column and the value that its newest cell has to have; rows that lack the
    cell are kept unless ``keep_missing`` is false. Give one of ``limit`` and ``where``.
    """
    table = read_table(spark, path)
    table = spark.createDataFrame([], puts.PUTS) if table is None else table
    if where is not None:
        column, value = where
        family = next(f for f, columns in SERVING_FAMILIES.items() if column in columns)
        return puts.view_where(table, families, (family, column), value, keep_missing)
    return puts.view(table, families) if limit is None else puts.view_first(table, families, limit)


def compact(spark: SparkSession, path: str, target: str | None = None, versions: int = MAX_VERSIONS) -> None:
    """Replace the runs of the table by one with the retained versions, or write that to ``target``.

    The new run is written before the old ones are deleted. A cell that stands in both for a
    while, or after a failure, is one version still. Runs added meanwhile are not touched. A
    run that is part of a compacted one can no longer be replaced by its name.
    """
    runs = _runs(spark, path)
    if target is not None:
        write_puts(puts.gathered(read_cells(spark, path, versions)), target, "compacted", fresh=True)
    elif runs:
        write_puts(puts.gathered(read_cells(spark, path, versions)), path, f"compacted-{new_batch()}")
        for run_id in runs:
            delete_folder(spark, f"{path}/{RUN}={run_id}")


def run(
    spark: SparkSession,
    gold: str,
    path: str,
    run_id: str | None = None,
    since: dt.date | None = None,
    fresh: bool = False,
) -> int:
    """Publish gold, or its departures from ``since`` on; returns the rows whose key had a missing part.

    Every publication is a run of its own unless ``run_id`` names one to replace.
    """
    table = spark.read.parquet(gold)
    if since is not None:
        # The year prunes folders, the time row groups: rows are sorted by it.
        table = table.where(F.col("departure_year") >= since.year)
        table = table.where(F.col("departure_scheduled") >= F.lit(since).cast("timestamp"))
    write_wide(keyed(table), SERVING_FAMILIES, path, run_id or new_batch(), fresh)
    return table.where(~reduce(and_, (F.col(c).isNotNull() for c in KEY_PARTS))).count()
