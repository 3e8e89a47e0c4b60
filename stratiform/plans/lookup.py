"""Rows by the value of a cell, without reading the files that cannot hold it.

For chosen cells an index keeps (name, value, row_key) of every run of a tiered table, dealt by
ranges of all three and sorted, so a file holds a narrow range and even a value that most rows have is
spread over files. A list beside the rows gives each file's first and last entry: a lookup opens only
the files whose range includes the value, and then only the puts of the row keys found there.

Entries are never corrected: a key whose cell has another value by now is found and then left out,
as the newest value is compared before the row is returned.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.operators import puts
from stratiform.plans.tiers import Tiers
from stratiform.session import broadcast_within, scratch, stage
from stratiform.snapshots import Snapshots

ENTRY = ["name", "value", "row_key"]


class ValueIndex:
    """Index of some cells (family, qualifier) of a tiered table, in a folder of its own."""

    def __init__(self, tiers: Tiers, path: str, cells: Sequence[tuple[str, str]], file_rows: int = 1_000_000) -> None:
        self.tiers, self.cells, self.file_rows = tiers, list(cells), file_rows
        self.spark: SparkSession = tiers.spark
        self.parts = Snapshots(self.spark, path)

    def _entries(self, table: DataFrame) -> DataFrame:
        pairs = puts.puts_to_cells(table.where(F.col("family").isin(*(family for family, _ in self.cells))))
        name = F.concat_ws(":", "family", "qualifier")
        listed = pairs.select(name.alias("name"), "value", "row_key")
        return listed.where(F.col("name").isin(*(f"{family}:{column}" for family, column in self.cells))).distinct()

    def update(self) -> None:
        """Index the runs of the table's newest snapshot that were not indexed yet.

        Call it before a merge, or the merged run is read again; that costs time, not rows.
        """
        done = set(self._indexed())
        runs = [run for run in self.tiers.runs() if run not in done]
        if not runs:
            return
        folder = f"part={uuid.uuid4().hex}"
        path = f"{self.parts.table}/{folder}"
        with scratch(self.spark):
            entries = stage(self._entries(self.tiers.table_of(runs)), "entries")
            files = max(1, -(-entries.count() // self.file_rows))
            dealt = entries.repartitionByRange(files, *ENTRY).sortWithinPartitions(*ENTRY)
            dealt.write.parquet(f"{path}/rows")
        entry = F.struct("name", "value")
        written = self.spark.read.parquet(f"{path}/rows").groupBy(F.input_file_name().alias("file"))
        written.agg(F.min(entry).alias("low"), F.max(entry).alias("high")).write.parquet(f"{path}/files")
        self.spark.createDataFrame(runs, "level int, run string").coalesce(1).write.parquet(f"{path}/runs")
        self.parts.commit([folder])

    def _indexed(self) -> list[tuple[int, str]]:
        folders = self._folders()
        return [tuple(row) for row in self.spark.read.parquet(*(f"{f}/runs" for f in folders)).collect()] if folders else []

    def _folders(self) -> list[str]:
        return [f"{self.parts.table}/{name}" for name in self.parts.folders()]

    def files(self, cell: tuple[str, str], value: str) -> list[str]:
        """The files whose range includes a value of a cell."""
        folders = self._folders()
        if not folders:
            return []
        ranges = self.spark.read.parquet(*(f"{folder}/files" for folder in folders))
        wanted = F.struct(F.lit(":".join(cell)).alias("name"), F.lit(value).alias("value"))
        return [row["file"] for row in ranges.where((F.col("low") <= wanted) & (F.col("high") >= wanted)).select("file").collect()]

    def keys(self, cell: tuple[str, str], value: str) -> DataFrame:
        """Row keys whose cell has, or once had, the value."""
        files = self.files(cell, value)
        if not files:
            return self.spark.createDataFrame([], "row_key string")
        rows = self.spark.read.parquet(*files)
        return rows.where((F.col("name") == ":".join(cell)) & (F.col("value") == value)).select("row_key").distinct()

    def find(self, families: Mapping[str, Sequence[str]], cell: tuple[str, str], value: str) -> DataFrame:
        """The view's rows whose newest value of an indexed cell is ``value``."""
        if tuple(cell) not in {tuple(c) for c in self.cells}:
            raise ValueError(f"{cell} is not indexed")
        here = self.tiers.read().join(broadcast_within(self.keys(cell, value)), "row_key", "left_semi")
        return puts.view_where(here, families, cell, value, keep_missing=False)
