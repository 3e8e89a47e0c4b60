"""Enrichment of one stream by another: what was observed in the time before a row, with state that is bounded.

Both sides wait in state until the watermark, the lesser of the two sides' newest times less ``delay``, has
passed whatever could still match them; rows of the left without a match are written then. Time is
cut into bins as long as the range, and the bin is part of the join's key: a hot key is spread
over its bins, and a row of the right stands in the two bins that its range touches.

Rows of the left that cannot match, as a key or the time is null, are written at once and never wait.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratiform import sinks
from stratiform.snapshots import Snapshots, batch_folder
from stratiform.streaming.ingest import query_id

_MICROS = dt.timedelta(microseconds=1)


class Range(NamedTuple):
    """Rows match on ``on`` if ``right_time <= left_time < right_time + within``."""

    on: Sequence[str]
    left_time: str
    right_time: str
    within: dt.timedelta

    def bin_of(self, time: str) -> Column:
        """The beginning of the bin that a time is in, never null."""
        micros = F.unix_micros(time)
        return F.coalesce(micros - F.pmod(micros, F.lit(self.within // _MICROS)), F.lit(0).cast("long"))

    def can_match(self, time: str) -> Column:
        return reduce(and_, (F.col(c).isNotNull() for c in (*self.on, time)))

    def _time(self, time: str) -> Column:
        # Never null, as the filter sees to it, but said so here: the state's schema has to be the same for
        # every batch, while what the optimizer infers of nulls depends on which side has rows.
        return F.coalesce(F.col(time).cast("timestamp"), F.timestamp_seconds(F.lit(0)))

    def left_side(self, left: DataFrame) -> DataFrame:
        timed = left.where(self.can_match(self.left_time)).withColumn("_at", self._time(self.left_time))
        return timed.withColumn("_bin", self.bin_of("_at"))

    def right_side(self, right: DataFrame) -> DataFrame:
        timed = right.where(self.can_match(self.right_time)).withColumn("_from", self._time(self.right_time))
        renamed = timed.withColumnsRenamed({c: f"_{c}" for c in self.on})
        first = self.bin_of("_from")
        return renamed.withColumn("_of_bin", F.explode(F.array(first, first + F.lit(self.within // _MICROS))))

    def condition(self) -> Column:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.on] + [F.col("_bin") == F.col("_of_bin")]
        inside = [F.col("_at") >= F.col("_from"), F.col("_at") < F.col("_from") + F.lit(self.within)]
        return reduce(and_, same + inside)


def enriched(left: DataFrame, right: DataFrame, match: Range, delay: dt.timedelta) -> DataFrame:
    """Every row of ``left`` with each row of ``right`` that matches, or nulls; on streams or tables.

    Columns are those of ``left``, then those of ``right`` without ``match.on``. ``delay`` bounds by how much a
    stream's rows may be out of order; rows later than that are dropped and counted (``late_rows``).
    """
    taken = [c for c in right.columns if c not in match.on]
    clash = sorted(set(taken) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides: {', '.join(clash)}")
    late = f"{delay // _MICROS} microseconds"
    waiting = match.left_side(left).withWatermark("_at", late)
    joined = waiting.join(match.right_side(right).withWatermark("_from", late), match.condition(), "left_outer")
    types = {f.name: f.dataType for f in right.schema.fields}
    apart = left.where(~match.can_match(match.left_time)).select("*", *(F.lit(None).cast(types[c]).alias(c) for c in taken))
    return joined.select(*left.columns, *taken).union(apart)


def enrich(left: DataFrame, right: DataFrame, match: Range, delay: dt.timedelta, path: str, checkpoint: str) -> StreamingQuery:
    """Write what ``enriched`` gives of two streams; a batch is put in place by a snapshot, and a repeated one is not written again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        snapshots = Snapshots(spark, path)
        name = f"{query_id(spark, checkpoint)}-{batch_id}"
        if batch_folder(name) in snapshots.folders():
            batch.write.format("noop").mode("overwrite").save()  # the state has to be brought to this batch all the same
            return
        sinks.write_batch(batch, path, name)
        snapshots.commit([batch_folder(name)])

    out = enriched(left, right, match, delay).writeStream.foreachBatch(write)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def undecided(spark: SparkSession, checkpoint: str, match: Range) -> DataFrame:
    """Rows of the left that wait in the state for a match, as the last batch left them.

    A row whose match was written waits for further ones, and so does what it matched: the state of both
    sides tells the two kinds apart.
    """
    left, right = (
        spark.read.format("statestore").option("joinSide", side).load(checkpoint).select("value.*") for side in ("left", "right")
    )
    return left.join(right, match.condition(), "left_anti")


def read_enriched(spark: SparkSession, path: str, checkpoint: str, match: Range) -> DataFrame | None:
    """What ``enrich`` has written, and the rows that still wait, without a match; None before the first batch.

    For use between runs of the job: a row that waits may be matched by the next one.
    """
    table = Snapshots(spark, path).read()
    if table is None:
        return None
    written = table.drop(sinks.BATCH)
    waiting = undecided(spark, checkpoint, match)
    return written.unionByName(waiting.select(*(c for c in waiting.columns if c in written.columns)), allowMissingColumns=True)


def late_rows(query: StreamingQuery) -> int:
    """Rows that were later than the delay allows and were dropped, over the batches that the engine remembers."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])
