"""A stream enriched by another, against the same join of tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stratiform.registry import streams as streams_queries
from stratiform.registry.streams import _stream_in_order
from stratiform.session import new_path
from stratiform.streaming import Range, enrich, enriched, late_rows, read_enriched

START = dt.datetime(2024, 1, 1)
MATCH = Range(["code"], "flown", "observed", dt.timedelta(hours=3))
LEFT, RIGHT = "id int, code string, flown timestamp", "code string, observed timestamp, rain double"


def at(hours):
    return START + dt.timedelta(hours=hours)


def append(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def streams(spark, tmp_path):
    return [
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        for schema, name in ((LEFT, "left"), (RIGHT, "right"))
    ]


def run(spark, tmp_path, delay=1):
    out = str(tmp_path / "out")
    query = enrich(*streams(spark, tmp_path), MATCH, dt.timedelta(hours=delay), out, f"{out}-state")
    query.awaitTermination()
    assert query.exception() is None
    rows = read_enriched(spark, out, f"{out}-state", MATCH)
    return sorted((tuple(r) for r in rows.collect()), key=str), query


def table(spark, tmp_path):
    sides = [spark.read.parquet(str(tmp_path / name)) for name in ("left", "right")]
    return sorted((tuple(r) for r in enriched(*sides, MATCH, dt.timedelta(hours=1)).collect()), key=str)


def test_rows_with_one_two_and_no_match_between_runs(spark, tmp_path):
    hot = [(100 + k, "H", at(k / 10)) for k in range(60)]
    left = [(1, "A", at(3)), (2, "A", at(2.999)), (3, "A", at(0)), (4, "B", at(5)), (5, None, at(1)), (6, "A", None), (7, "B", at(20))]
    right = [("A", at(0), 1.0), ("A", at(2), 2.0), ("A", at(0), 3.0), (None, at(1), 9.0), ("B", None, 9.0), ("B", at(4), None), ("H", at(1), 4.0)]
    left, right = sorted(hot + left, key=lambda r: str(r[2])), sorted(right, key=lambda r: str(r[1]))
    for low in range(0, len(left), 20):
        append(spark, left[low : low + 20], LEFT, str(tmp_path / "left"))
    for low in range(0, len(right), 3):
        append(spark, right[low : low + 3], RIGHT, str(tmp_path / "right"))
    rows, query = run(spark, tmp_path)
    assert late_rows(query) == 0
    assert rows == table(spark, tmp_path)
    by_id = {}
    for row in rows:
        by_id.setdefault(row[0], []).append(row[4])
    assert by_id[1] == [2.0] and sorted(by_id[2]) == [1.0, 2.0, 3.0] and sorted(by_id[3]) == [1.0, 3.0]
    assert by_id[4] == by_id[5] == by_id[6] == by_id[7] == [None]
    # The row of hour 20 waited for a match, and the next run brings it.
    append(spark, [("B", at(19), 7.0)], RIGHT, str(tmp_path / "right"))
    rows, _ = run(spark, tmp_path)
    assert rows == table(spark, tmp_path) and [r[4] for r in rows if r[0] == 7] == [7.0]


def test_state_does_not_grow_with_time(spark, tmp_path):
    for day in range(8):
        append(spark, [(100 * day + k, "A", at(24 * day + k)) for k in range(20)], LEFT, str(tmp_path / "left"))
        append(spark, [("A", at(24 * day + k), float(k)) for k in range(20)], RIGHT, str(tmp_path / "right"))
    rows, query = run(spark, tmp_path)
    assert rows == table(spark, tmp_path)
    held = [state["numRowsTotal"] for progress in query.recentProgress for state in progress["stateOperators"]]
    assert max(held) <= 2 * (20 + 40) + 20  # of 480 rows, those of a day or two


def test_late_rows_are_counted(spark, tmp_path):
    for hour in (0, 100, 200):
        append(spark, [(hour, "A", at(hour))], LEFT, str(tmp_path / "left"))
        append(spark, [("A", at(hour), 1.0)], RIGHT, str(tmp_path / "right"))
    assert len(run(spark, tmp_path)[0]) == 3
    append(spark, [(7, "A", at(1))], LEFT, str(tmp_path / "left"))
    assert late_rows(run(spark, tmp_path)[1]) == 1


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    append(spark, [(1, "A", at(1)), (2, "A", None)], LEFT, str(tmp_path / "left"))
    append(spark, [("A", at(0), 1.0)], RIGHT, str(tmp_path / "right"))
    first, _ = run(spark, tmp_path)
    commits = sorted(name for name in os.listdir(tmp_path / "out-state" / "commits") if name.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(tmp_path / "out-state" / "commits" / name)
    assert run(spark, tmp_path)[0] == first == table(spark, tmp_path)


def test_clashing_columns_are_refused(spark):
    left = spark.createDataFrame([(1, "A", at(1), 2.0)], f"{LEFT}, rain double")
    right = spark.createDataFrame([("A", at(0), 1.0)], RIGHT)
    with pytest.raises(ValueError, match="rain"):
        enriched(left, right, MATCH, dt.timedelta(hours=1))


def test_empty_tables(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    some = spark.createDataFrame([(1, "A", at(1))], LEFT)
    assert enriched(left, right, MATCH, dt.timedelta(hours=1)).count() == 0
    assert [tuple(r) for r in enriched(some, right, MATCH, dt.timedelta(hours=1)).select("id", F.col("rain")).collect()] == [(1, None)]


def test_batches_in_order_are_as_many_as_rows_need(spark):
    """More batches and files for more rows; times that most rows have leave parts without rows."""
    at = "timestamp_seconds(CASE WHEN id < 600 THEN 1000 ELSE id END)"
    df = spark.sql(f"SELECT id, CASE WHEN id % 100 > 0 THEN {at} END AS at FROM range(2000)")
    stream = _stream_in_order(spark, df, "at", "in-order", 2, file_rows=50, batch_rows=200)
    files, batches = [], []

    def note(batch, _):
        found = batch.withColumn("file", F.input_file_name()).cache()
        files.append({row.file for row in found.select("file").distinct().collect()})
        batches.append([(row.id, row.at) for row in found.collect()])

    state = new_path(spark, "in-order-state")
    query = stream.writeStream.foreachBatch(note).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None
    assert sorted(id for batch in batches for id, _ in batch) == list(range(2000))
    assert len(batches) == 10 and max(map(len, files)) == 4
    times = [[at for _, at in batch if at is not None] for batch in batches]
    times = [batch for batch in times if batch]
    assert all(max(one) <= min(next_one) for one, next_one in zip(times, times[1:], strict=False))


def test_batches_in_order_are_made_in_one_pass(spark, monkeypatch):
    """The time of a row is read for the cuts and for its batch, however many batches there are."""
    read = spark.sparkContext.accumulator(0)

    def noted(time):
        read.add(1)
        return time

    staged = streams_queries.stage
    counting = F.udf(noted, "timestamp").asNondeterministic()
    monkeypatch.setattr(streams_queries, "stage", lambda df, label: staged(df, label).withColumn("at", counting("at")))
    df = spark.sql("SELECT id, timestamp_seconds(id) AS at FROM range(400)")
    stream = _stream_in_order(spark, df, "at", "one-pass", 2, batch_rows=20)
    assert read.value <= 3 * 400
    state, found = new_path(spark, "one-pass-state"), []
    write = stream.writeStream.foreachBatch(lambda batch, _: found.append(sorted(row.id for row in batch.collect())))
    write.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert len(found) == 20 and sum(found, []) == list(range(400))
