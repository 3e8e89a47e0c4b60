"""Streams against their batch counterparts, over several batches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from stratiform.plans import flights, serving
from stratiform.streaming import deduplicated, envelope_stream, ingest_flights, keep_first, read_first, upsert_cells
from stratiform.streaming.dedup import ROCKSDB, STATE_STORE

FILES = [f"flights_2023-12-0{k}-00-00-00.json" for k in (1, 2, 3)]


@pytest.fixture
def staged(write, envelope, flight):
    for k, name in enumerate(FILES):
        folder = write(name, envelope(flight(f"F{k}")) + "{broken\n")
    return folder


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_flights_arrive_once_in_bounded_batches(spark, staged, tmp_path):
    silver, quarantine, state = (str(tmp_path / name) for name in ("silver", "quarantine", "state"))
    for _ in range(2):
        stream = envelope_stream(spark, staged, files_per_batch=1, pattern="flights*")
        query = ingest_flights(stream, silver, quarantine, state)
        finish(query)
        rows = spark.read.parquet(silver)
        assert sorted(row.flight_icao for row in rows.collect()) == ["F0", "F1", "F2"]
        assert spark.read.parquet(quarantine).count() == 3
    batch_silver = str(tmp_path / "batch")
    flights.run(spark, staged, batch_silver, str(tmp_path / "batch-quarantine"))
    same, rows = (df.drop("ingest_batch") for df in (spark.read.parquet(batch_silver), rows))
    assert rows.exceptAll(same).count() == 0 and same.exceptAll(rows).count() == 0


def test_repeated_batch_adds_nothing(spark, staged, tmp_path):
    silver, quarantine = str(tmp_path / "silver"), str(tmp_path / "quarantine")
    for attempt in range(2):
        stream = envelope_stream(spark, staged)
        finish(ingest_flights(stream, silver, quarantine, str(tmp_path / f"state-{attempt}")))
        assert spark.read.parquet(silver).count() == 3
        assert spark.read.parquet(quarantine).count() == 3


def test_files_are_archived_after_their_batch(spark, staged, tmp_path, write, envelope, flight):
    archive = str(tmp_path / "archive")
    paths = [str(tmp_path / name) for name in ("silver", "quarantine", "state")]

    def run():
        stream = envelope_stream(spark, staged, files_per_batch=1, archive=archive)
        finish(ingest_flights(stream, *paths))

    run()
    write("flights_2023-12-04-00-00-00.json", envelope(flight("F4")))
    run()
    kept = {name for _, _, names in os.walk(staged) for name in names}
    moved = {name for _, _, names in os.walk(archive) for name in names}
    assert moved and not moved & kept
    assert "flights_2023-12-04-00-00-00.json" in kept
    assert spark.read.parquet(paths[0]).count() == 4


@pytest.mark.parametrize("spread_by", [(), ("poll",)])
def test_dedup_across_batches(spark, tmp_path, spread_by):
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    start = dt.datetime(2024, 1, 1)
    for poll in range(3):
        rows = [(key, start + dt.timedelta(minutes=key), poll) for key in range(20)]
        spark.createDataFrame(rows, "key int, ts timestamp, poll int").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key int, ts timestamp, poll int").option("maxFilesPerTrigger", 1).parquet(source)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        clean = deduplicated(stream, ["key"], "ts", "1 hour", spread_by=spread_by, spread=4)
        query = clean.writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
        finish(query.trigger(availableNow=True).start(out))
    finally:
        spark.conf.unset(STATE_STORE)
    assert sorted(row.key for row in spark.read.parquet(out).collect()) == list(range(20))


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
@pytest.mark.parametrize("files", [1, 1000])
def test_no_row_is_late_for_the_log(spark, tmp_path, order, files):
    """The same rows by any number of files a batch and in any order of time."""
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    start = dt.datetime(2024, 1, 1, 23, 30)
    polls = [[(key, start + dt.timedelta(hours=17 * key, minutes=50 * poll), poll) for key in range(40)] for poll in range(2)]
    rows = [row for poll in polls for row in poll] + [(None, start, 0), (None, None, 0), (None, None, 1)]
    rows.sort(key=lambda r: str(r[1]), reverse=order == "backward")
    if order == "mixed":
        random.Random(4).shuffle(rows)
    schema = "key int, ts timestamp, poll int"
    for low in range(0, len(rows), 17):
        spark.createDataFrame(rows[low : low + 17], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    finish(keep_first(stream, ["key"], "ts", dt.timedelta(hours=1), out, f"{out}-state"))
    assert sorted(row.key for row in read_first(spark, out).where("key IS NOT NULL").collect()) == list(range(40))


def test_a_repeated_batch_of_the_log_changes_nothing(spark, tmp_path):
    source, out = str(tmp_path / "source"), str(tmp_path / "out")
    schema = "key int, ts timestamp"
    for day in (1, 2):
        spark.createDataFrame([(day, dt.datetime(2024, 1, day))], schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    finish(keep_first(stream(), ["key"], "ts", dt.timedelta(days=1), out, f"{out}-state"))
    for name in ("1", ".1.crc"):  # the engine did not learn that its last batch was done
        os.remove(f"{out}-state/commits/{name}")
    finish(keep_first(stream(), ["key"], "ts", dt.timedelta(days=1), out, f"{out}-state"))
    assert sorted(row.key for row in read_first(spark, out).collect()) == [1, 2]


def test_upsert_merges_batches(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "cells")
    families = {"f": ["a", "b"]}
    schema = "row_key string, a string, b string, version_ts timestamp"
    for row in (("r1", "1", "x", dt.datetime(2024, 1, 1)), ("r1", "2", None, dt.datetime(2024, 1, 2))):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    finish(upsert_cells(stream, families, path, f"{path}-state"))
    assert [tuple(row) for row in serving.scan(spark, path, families).collect()] == [("r1", "2", "x")]
    assert spark.read.parquet(path).select(F.countDistinct("run_id")).first()[0] == 2
