"""Staged files to a silver table and the quarantine, in batches that a rerun completes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform import sinks
from stratiform.snapshots import Snapshots, batch_folder
from stratiform.sources.envelope import list_files, quarantined
from stratiform.sources.tables import read_table

DATASET = "dataset"


def ingest_files(
    spark: SparkSession,
    globs: Sequence[str],
    table: str,
    write: Callable[[list[str], str], None],
    archive: str | None = None,
) -> None:
    """Write the staged files that ``table`` does not have, batch by batch.

    ``write`` gets paths and the name of their batch and must replace what it wrote for that
    batch before. Batches that an earlier run planned but did not finish come first, with
    exactly their files. A batch becomes visible to ``read_committed`` when the table's next
    snapshot lists it; one that is listed is not written again. With ``archive`` the files of a
    batch are moved there afterwards.
    """
    manifest = sinks.Manifest(spark, table)
    batches = list(manifest.unfinished().items())
    files = list_files(spark, globs[0])
    for glob in globs[1:]:
        files = files.unionByName(list_files(spark, glob))
    batches.append(manifest.plan(files))
    if not any(paths for _, paths in batches) and read_table(spark, table) is None:
        write([], batches[-1][0])  # a table without rows
        Snapshots(spark, table).commit([batch_folder(batches[-1][0])])
    snapshots = Snapshots(spark, table)
    for batch, paths in batches:
        if paths:
            if batch_folder(batch) not in snapshots.folders():
                write(paths, batch)
                snapshots.commit([batch_folder(batch)])
            manifest.finish(batch)
            if archive is not None:
                sinks.archive(spark, paths, archive)


def write_parsed(
    parsed: DataFrame,
    rows: Callable[[DataFrame], DataFrame],
    dataset: str,
    silver: str,
    quarantine: str,
    batch: str,
    partition_by: Sequence[str] = (),
) -> None:
    """Good records to the batch's part of silver, bad ones to its part of the quarantine.

    The parsed records are used twice, so they are kept on the executors' disks, the text
    only of the bad ones; a lost executor's share is parsed again.
    """
    only_bad = F.when(F.col("_problem").isNotNull(), F.col("value"))
    kept = parsed.withColumn("value", only_bad).persist(StorageLevel.DISK_ONLY)
    try:
        sinks.write_batch(rows(kept), silver, batch, partition_by)
        write_bad(quarantined(kept), dataset, quarantine, batch)
    finally:
        kept.unpersist()


def write_bad(bad: DataFrame, dataset: str, quarantine: str, batch: str) -> None:
    """source_file, value and problem of what was rejected, under dataset and batch."""
    rows = bad.select("source_file", "value", "problem")
    sinks.write_batch(rows, f"{quarantine}/{DATASET}={dataset}", batch)
