"""Serving cells in tiers: runs bucketed by row key, merged level by level, read without an exchange.

Every run holds puts (``operators.puts``) in the same number of buckets by row key, one sorted
file per bucket. Spark reads the files of a bucket in one task, from however many runs they are, so
newest values per key, and merged runs, are made where the files are read. What a publication adds
is shuffled once, when it is written, after each task has cut every cell to the retained versions; a
key that most rows have is therefore a few rows of its bucket.

A merge takes all runs of a level once there are ``fan`` of them and writes one run of the next
level, so a cell is written again once per level and a scan meets few runs. Which runs make up the
table is told by its newest snapshot: a run is seen when it is whole, and merged ones vanish in the
step that shows their merger.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.operators import puts
from stratiform.operators.cells import CELL, MAX_VERSIONS, newest_versions
from stratiform.snapshots import Snapshots

BUCKETS = 64
FAN = 4
BUCKET_ROWS = 200_000
_RUN = re.compile(r"level=(\d+)/run=([^/]+)$")


def buckets_for(rows: int, least: int = BUCKETS) -> int:
    """Buckets of a table that is to hold so many rows: a bucket is sorted by one task, so their number follows the rows."""
    return max(least, -(-rows // BUCKET_ROWS))


class Tiers:
    """A tiered cells table; ``buckets`` belongs to the table and must not change."""

    def __init__(
        self, spark: SparkSession, path: str, buckets: int = BUCKETS, fan: int = FAN, versions: int = MAX_VERSIONS
    ) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.fan, self.versions = buckets, fan, versions
        self.snapshots = Snapshots(spark, self.path)

    def runs(self, number: int | None = None) -> list[tuple[int, str]]:
        """Level and name of every run of a snapshot, the newest by default."""
        found = [_RUN.match(name).groups() for name in self.snapshots.folders(number)]
        return [(int(level), run) for level, run in found]

    def _retained(self, table: DataFrame) -> DataFrame:
        """The newest versions of every cell, as a put per key, family and version."""
        cells = puts.puts_to_cells(table).groupBy(*CELL, "version_ts").agg(F.max("value").alias("value"))
        return puts.gathered(newest_versions(cells, self.versions))

    def _write(self, table: DataFrame, level: int) -> str:
        """A run of bucketed files, which nobody sees yet; its folder."""
        folder, name = f"level={level}/run={uuid.uuid4().hex}", f"tier_run_{uuid.uuid4().hex}"
        writer = table.select("row_key", "family", "version_ts", "cells").write.bucketBy(self.buckets, "row_key").sortBy("row_key")
        try:
            writer.option("path", f"{self.path}/{folder}").saveAsTable(name)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the catalog's entry; the files stay
        return folder

    def add(self, table: DataFrame) -> int:
        """Publish puts as a run of level 0; the number of the snapshot that shows it."""
        retained = self._retained(table).repartition(self.buckets, "row_key")
        return self.snapshots.commit([self._write(retained, 0)])

    def merge(self) -> None:
        """Merge every level that has ``fan`` runs or more into one run of the next, lowest level first."""
        while True:
            runs = self.runs()
            full = [level for level in sorted({level for level, _ in runs}) if sum(at == level for at, _ in runs) >= self.fan]
            if not full:
                return
            self._merge([run for run in runs if run[0] == full[0]], full[0] + 1)

    def compact(self) -> None:
        """Merge all runs into one, whatever their levels."""
        runs = self.runs()
        if len(runs) > 1:
            self._merge(runs, max(level for level, _ in runs) + 1)

    def _merge(self, runs: Sequence[tuple[int, str]], level: int) -> None:
        merged = self._write(self._retained(self.table_of(runs)), level)
        self.snapshots.commit([merged], remove=[f"level={at}/run={run}" for at, run in runs])

    def table_of(self, runs: Sequence[tuple[int, str]]) -> DataFrame:
        """Puts of some runs, known to the planner as buckets by row key."""
        label = hashlib.sha256("\n".join([self.path, *(f"{level}/{run}" for level, run in sorted(runs))]).encode()).hexdigest()
        name = f"tier_view_{label[:32]}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} (row_key STRING, family STRING, version_ts TIMESTAMP, cells MAP<STRING, STRING>, run STRING) "
                f"USING parquet OPTIONS (path '{self.path}') PARTITIONED BY (run) "
                f"CLUSTERED BY (row_key) SORTED BY (row_key) INTO {self.buckets} BUCKETS"
            )
            for level, run in runs:
                place = f"{self.path}/level={level}/run={run}"
                self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (run = '{run}') LOCATION '{place}'")
        return self.spark.table(name).drop("run")

    def read(self, number: int | None = None) -> DataFrame:
        """The puts of a snapshot, the newest by default."""
        runs = self.runs(number)
        return self.table_of(runs) if runs else self.spark.createDataFrame([], puts.PUTS)

    def scan(self, families: Mapping[str, Sequence[str]]) -> DataFrame:
        """Newest values, one row per key."""
        return puts.view(self.read(), families)

    def cells(self) -> DataFrame:
        """Retained versions of every cell."""
        return puts.puts_to_cells(self._retained(self.read()))

    def expire(self, keep: int = 1) -> None:
        """Drop old snapshots and the runs that were merged; readers of those must be done."""
        self.snapshots.expire(keep)
