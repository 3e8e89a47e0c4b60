"""Parquet sinks: plain append, forms that can be rerun, and the record of what was ingested."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.snapshots import BATCH
from stratiform.sources.tables import read_table


# Settings for wide tables. A column's dictionary is given up after 16 KB of values: most text differs in every row
# there, and by default a file's columns would each look up and keep a megabyte of values before that.
WIDE = {"compression": "zstd", "parquet.dictionary.page.size": str(16 * 1024)}


def laid_out(df: DataFrame, partition_by: Sequence[str], sort_by: Sequence[str] = ()) -> DataFrame:
    """Group rows by partition value for the write, and sort them within files.

    Without this every task writes a file into every partition it meets. Rebalancing lets
    AQE merge small partitions and split a hot one into several files of advisory size.
    """
    grouped = df.hint("rebalance", *partition_by) if partition_by else df
    return grouped.sortWithinPartitions(*partition_by, *sort_by) if sort_by else grouped


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    laid_out(df, partition_by).write.partitionBy(*partition_by).mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Replace the whole table."""
    (
        laid_out(df, partition_by, sort_by)
        .write.partitionBy(*partition_by)
        .option("partitionOverwriteMode", "static")
        .mode("overwrite")
        .parquet(path)
    )


def add_laid_out(
    df: DataFrame, path: str, partition_by: Sequence[str], sort_by: Sequence[str] = (), dealt: bool = False
) -> None:
    """Add rows to a table that is not in place yet (``replace_folder``); ``dealt`` ones are not shuffled by partition again."""
    rows = df.sortWithinPartitions(*partition_by, *sort_by) if dealt else laid_out(df, partition_by, sort_by)
    rows.write.partitionBy(*partition_by).options(**WIDE).mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str], sort_by: Sequence[str] = ()) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    (
        laid_out(df, partition_by, sort_by)
        .write.partitionBy(*partition_by)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def write_batch(df: DataFrame, path: str, batch: str, partition_by: Sequence[str] = ()) -> None:
    """The rows of one ingest batch: a folder of its own, which a rerun of the batch replaces."""
    overwrite(df, f"{path}/{BATCH}={batch}", partition_by)


def new_batch() -> str:
    return f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"


class Manifest:
    """Which delivered files a table holds, beside the table.

    A batch is planned with its files before any row is written and finished after a snapshot
    lists it; readers of snapshots see its rows from then on. A batch that was planned but not
    listed is written again, as a whole, by the next run. So every file's rows are in the
    table once. A file is known by path, modification time and length. One job at a time
    writes a table.
    """

    def __init__(self, spark: SparkSession, table: str) -> None:
        self.spark = spark
        self.planned, self.done = f"{table}/_manifest/planned", f"{table}/_manifest/finished"

    def _read(self, path: str, schema: str) -> DataFrame:
        table = read_table(self.spark, path)
        return self.spark.createDataFrame([], schema) if table is None else table

    def unfinished(self) -> dict[str, list[str]]:
        """Paths of every batch that was planned but not finished."""
        planned = self._read(self.planned, "batch string, path string, source_id string")
        rows = planned.join(self._read(self.done, "batch string"), "batch", "left_anti").orderBy("batch", "path").collect()
        out: dict[str, list[str]] = {}
        for row in rows:
            out.setdefault(row["batch"], []).append(row["path"])
        return out

    def without_known(self, files: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows whose ``source_id`` no batch, or none other than ``batch``, has."""
        known = self._read(self.planned, "batch string, path string, source_id string")
        if batch is not None:
            known = known.where(F.col("batch") != batch)
        return files.join(known.select("source_id"), "source_id", "left_anti")

    def plan(self, files: DataFrame) -> tuple[str, list[str]]:
        """A new batch of the files (path, source_id) that no batch has yet, and their paths."""
        batch = new_batch()
        new = self.without_known(files).select("path", "source_id").distinct().orderBy("path").collect()
        if new:
            self._add(self.planned, [(batch, row["path"], row["source_id"]) for row in new], "batch string, path string, source_id string")
        return batch, [row["path"] for row in new]

    def note(self, batch: str, files: DataFrame) -> None:
        """Record a batch that has been written already, by what is left of its files (source_id)."""
        self.finish(batch)
        noted = files.select(F.lit(batch).alias("batch"), F.lit(None).cast("string").alias("path"), "source_id").distinct()
        noted.coalesce(1).write.mode("append").parquet(self.planned)

    def _add(self, path: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def finish(self, batch: str) -> None:
        self._add(self.done, [(batch,)], "batch string")


def archive(spark: SparkSession, paths: Sequence[str], target: str) -> None:
    """Move files, after their batch is finished, into a folder; a file of that name there is numbered."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(target)
    system = folder.getFileSystem(conf)
    system.mkdirs(folder)
    for path in paths:
        source = jvm.org.apache.hadoop.fs.Path(path)
        if not system.exists(source):
            continue
        place, number = jvm.org.apache.hadoop.fs.Path(folder, source.getName()), 0
        while system.exists(place):
            number += 1
            place = jvm.org.apache.hadoop.fs.Path(folder, f"{source.getName()}.{number}")
        if not system.rename(source, place):
            raise OSError(f"cannot move {path} to {target}")


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def replace_folder(spark: SparkSession, path: str, by: str) -> None:
    """Put a folder that was written aside in the place of another, which goes."""
    target, source = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place) for place in (path, by))
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(target, True)
    if not (system.mkdirs(target.getParent()) and system.rename(source, target)):
        raise OSError(f"cannot move {by} to {path}")
