"""Means per group that follow the serving table: sums and counts, corrected when cells change.

The state holds a sum and a count per group, for one snapshot of a tiered cells table. An update
looks at the row keys of the runs that were added since: what their rows counted for before is
taken back, and what they count for now is added, so rows whose group or value was corrected, and
keys that are new, come out as in a full run. Runs that were merged meanwhile change nothing, as
they hold the same cells. If the old snapshot has expired everything is counted anew.

Sums are exact decimals of nine places, so that what is taken back cancels what was added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.operators import puts
from stratiform.plans.tiers import Tiers
from stratiform.snapshots import Snapshots

EXACT = "decimal(38,9)"


class Means:
    """State of the mean of one cell by the value of another, in a folder of its own.

    ``group`` and ``value`` are (family, qualifier). A missing group is the text 0 and, unless
    ``missing_as_zero`` is false, a missing or unreadable value counts as 0.
    """

    def __init__(
        self, tiers: Tiers, path: str, group: tuple[str, str], value: tuple[str, str], missing_as_zero: bool = True
    ) -> None:
        self.tiers, self.group, self.value, self.missing_as_zero = tiers, group, value, missing_as_zero
        self.spark: SparkSession = tiers.spark
        self.states = Snapshots(self.spark, path)

    def _folder(self, table: int) -> str:
        return f"of={table}"

    def table(self) -> int:
        """Number of the cells table's snapshot that the state is for; 0 if there is no state."""
        return max((int(name.removeprefix("of=")) for name in self.states.folders()), default=0)

    def state(self) -> DataFrame:
        """group_key, total, n."""
        found = self.states.read()
        empty = self.spark.createDataFrame([], f"group_key string, total {EXACT}, n long")
        return empty if found is None else found.select(*empty.columns)

    def _counted(self, table: DataFrame, sign: int) -> DataFrame:
        """What the rows of some puts count for, times ``sign``."""
        families: dict[str, Sequence[str]] = {}
        for family, column in (self.group, self.value):
            families[family] = [*families.get(family, []), column]
        wide = puts.view(table, families)
        number = F.col(self.value[1]).try_cast("double")
        number = F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number).cast(EXACT)
        number = F.coalesce(number, F.lit(0).cast(EXACT)) if self.missing_as_zero else number
        n = F.when(number.isNotNull(), F.lit(sign)).otherwise(0).cast("long")
        total: Column = F.coalesce(number, F.lit(0).cast(EXACT)) * sign
        key = F.coalesce(F.col(self.group[1]), F.lit("0"))
        # A group stays as long as any row has it, also if none of its values counts.
        return wide.select(key.alias("group_key"), total.cast(EXACT).alias("total"), n.alias("n"), F.lit(sign).cast("long").alias("rows"))

    def update(self) -> None:
        """Bring the state to the newest snapshot of the table."""
        now, then = self.tiers.snapshots.newest(), self.table()
        if now == then:
            return
        new = self.tiers.read(now)
        came = self._added(then, now)
        if came is None:
            parts = self._counted(new, 1)
        else:
            touched = self.tiers.table_of(came).select("row_key").distinct()
            old, new = (table.join(touched, "row_key", "left_semi") for table in (self.tiers.read(then), new))
            parts = self._rows().unionByName(self._counted(old, -1)).unionByName(self._counted(new, 1))
        sums = [F.sum("total").cast(EXACT).alias("total"), F.sum("n").alias("n"), F.sum("rows").alias("rows")]
        state = parts.groupBy("group_key").agg(*sums).where("rows > 0")
        folder = self._folder(now)
        state.write.mode("overwrite").parquet(f"{self.states.table}/{folder}")
        self.states.commit([folder], remove=self.states.folders())

    def _added(self, then: int, now: int) -> list[tuple[int, str]] | None:
        """Runs that were published after one snapshot, up to another; None if that cannot be told."""
        numbers = self.tiers.snapshots.numbers()
        if then not in numbers:
            return None
        since = {run for number in numbers if then < number <= now for run in self.tiers.runs(number)}
        return sorted(run for run in since - set(self.tiers.runs(then)) if run[0] == 0)

    def _rows(self) -> DataFrame:
        return self.states.read().select("group_key", "total", "n", "rows")

    def means(self, group: str, value: str) -> DataFrame:
        """The mean per group; null where nothing counts."""
        mean = (F.col("total").cast("double") / F.nullif(F.col("n"), F.lit(0)).cast("double")).alias(value)
        return self.state().select(F.col("group_key").alias(group), mean)
