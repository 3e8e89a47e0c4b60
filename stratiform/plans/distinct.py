"""Numbers of different values per group, kept as sketches that are added up without reading rows again.

Every batch of a table adds a row per group with a HyperLogLog sketch of each counted column. A
count over any of the groups' columns is the union of their sketches, so what a value stands in
twice counts once, over days and over batches. The size of a sketch does not grow with what it has seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform import sinks
from stratiform.snapshots import Snapshots, batch_folder


class DistinctCounts:
    """Sketches of ``values`` by ``by`` in a table at ``path``; 2 ** ``precision`` buckets to a sketch (4 to 21)."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], values: Sequence[str], precision: int = 14) -> None:
        if not 4 <= precision <= 21:
            raise ValueError(f"precision {precision} is not between 4 and 21")
        self.snapshots, self.path = Snapshots(spark, path), path
        self.by, self.values, self.precision = list(by), list(values), precision

    @property
    def error(self) -> float:
        """Standard error of a count, as a share of it."""
        return 1.04 / 2 ** (self.precision / 2)

    def _sketch(self, value: str) -> Column:
        # A hash stands for every value, also for an empty text, which a sketch would pass over; null is none.
        seen = F.when(F.col(value).isNotNull(), F.xxhash64(value))
        return F.hll_sketch_agg(seen, F.lit(self.precision)).alias(value)

    def add(self, rows: DataFrame, batch: str) -> None:
        """Take in the rows of a batch, once: a batch that is in the table already is passed over."""
        if batch_folder(batch) in self.snapshots.folders():
            return
        sinks.write_batch(rows.groupBy(*self.by).agg(*(self._sketch(v) for v in self.values)), self.path, batch)
        self.snapshots.commit([batch_folder(batch)])

    def compact(self, batch: str) -> None:
        """Put one row per group in the place of all batches, as one more batch.

        Counts may move within their error, as unions of unions are estimated in another order. The batches that it replaces are not known any more, so only what is never added again may be compacted.
        """
        old = self.snapshots.folders()
        if batch_folder(batch) in old:
            return
        merged = [F.hll_union_agg(v).alias(v) for v in self.values]
        sinks.write_batch(self.snapshots.read().groupBy(*self.by).agg(*merged), self.path, batch)
        self.snapshots.commit([batch_folder(batch)], remove=old)

    def counts(self, *by: str) -> DataFrame | None:
        """How many different values rows have by some of the groups' columns, by none over all; None if there is no batch."""
        table = self.snapshots.read()
        if table is None:
            return None
        found = [F.hll_sketch_estimate(F.hll_union_agg(v)).alias(v) for v in self.values]
        return table.groupBy(*by).agg(*found)

    def by_level(self, *levels: Sequence[str]) -> DataFrame | None:
        """Counts at several levels from one pass: the columns of ``by``, null where a level adds them up, and ``level``.

        ``level`` names the columns of a level, joined by commas.
        """
        table = self.snapshots.read()
        if table is None:
            return None
        sets = [[F.col(c) for c in level] for level in levels]
        found = [F.hll_sketch_estimate(F.hll_union_agg(v)).alias(v) for v in self.values]
        name = F.concat_ws(",", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in self.by))
        return table.groupingSets(sets, *(F.col(c) for c in self.by)).agg(name.alias("level"), *found)
