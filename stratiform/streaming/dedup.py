"""Deduplication of re-polled snapshots on a stream: the first copy in state or in a log, or the newest in a log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratiform import sinks
from stratiform.operators.dedup import latest_per_key, least_per_key
from stratiform.session import scratch, stage
from stratiform.snapshots import Snapshots, batch_folder
from stratiform.sources.tables import read_table
from stratiform.streaming.ingest import query_id

# Fixed class name of Spark's disk-backed state store, for state larger than the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = "event_day"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def deduplicated(
    stream: DataFrame,
    keys: Sequence[str],
    event_time: str,
    horizon: str,
    spread_by: Sequence[str] = (),
    spread: int = 64,
) -> DataFrame:
    """The first row of every key, forgetting a key after ``horizon``.

    Rows that arrive later than ``horizon`` behind the newest time seen are dropped by the
    engine, so this is for sources that deliver in order of time; ``keep_first`` keeps them.
    ``horizon`` bounds the state and must cover the time between copies. ``spread_by``
    are columns that differ between copies, such as the source file: a first stage then
    deduplicates per key and spread bucket, so a hot key is shared by ``spread`` tasks and
    the task that owns it sees at most one row per bucket.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, horizon)
    if spread_by:
        bucket = F.pmod(F.xxhash64(*spread_by), F.lit(spread))
        timed = (
            timed.withColumn("_bucket", bucket)
            .dropDuplicatesWithinWatermark([*keys, "_bucket"])
            .drop("_bucket")
        )
    return timed.dropDuplicatesWithinWatermark(list(keys))


def keep_first(
    stream: DataFrame,
    keys: Sequence[str],
    event_time: str,
    horizon: dt.timedelta,
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Write the first row of every key, in whatever order of time rows arrive; ``read_first`` reads them.

    There is no watermark and no state, so no row is late. What was written is the record of the
    keys that were seen: it lies by day of the event, and a batch is compared with the days that
    it touches only, widened by ``horizon``, the most that the times of a key's copies differ. Days
    that nothing arrives for are never read. Rows whose time is null are compared with those.

    Of copies in one batch the least row stays. A batch is put in place by a snapshot; a repeated one
    that is listed already is passed over, and otherwise replaces what it left.
    """
    apart = dt.timedelta(days=-(-horizon // dt.timedelta(days=1)))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        snapshots = Snapshots(spark, path)
        name = f"{query_id(spark, checkpoint)}-{batch_id}"
        if batch_folder(name) in snapshots.folders():
            return
        with scratch(spark):
            rows = stage(least_per_key(batch, keys).withColumn(DAY, F.to_date(event_time)), "first")
            known = snapshots.read()
            if known is not None:
                low, high = rows.agg(F.min(DAY), F.max(DAY)).first()
                there = F.col(DAY).isNull() & F.lit(rows.where(F.col(DAY).isNull()).count() > 0)
                if low is not None:
                    there |= F.col(DAY).between(F.lit(low - apart), F.lit(high + apart))
                seen = known.where(there).select(*(F.col(k).alias(f"_{k}") for k in keys))
                same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
                rows = rows.join(seen, same, "left_anti")
            sinks.write_batch(rows, path, name, [DAY])
        snapshots.commit([batch_folder(name)])

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_first(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``keep_first`` has written, or None if there is nothing yet."""
    table = Snapshots(spark, path).read()
    return None if table is None else table.drop(DAY, sinks.BATCH)


def keep_newest(
    stream: DataFrame, keys: Sequence[str], newest: Sequence[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Log the newest row per key of every batch; ``read_newest`` gives the newest of all.

    No state is held between batches, so there is no horizon: a copy may arrive at any time,
    and a correction replaces what came before. A repeated batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = latest_per_key(batch, keys, newest)
        sinks.write_batch(rows, path, f"{query_id(batch.sparkSession, checkpoint)}-{batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_newest(spark: SparkSession, path: str, keys: Sequence[str], newest: Sequence[str]) -> DataFrame | None:
    """The newest row per key that ``keep_newest`` has logged, or None if there is no log yet."""
    log = read_table(spark, path)
    return None if log is None else latest_per_key(log.drop(sinks.BATCH), keys, newest)
