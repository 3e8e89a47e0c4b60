"""Streaming jobs run to completion on files, equal to their batch counterparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions.casting import bind_by_name
from stratiform.operators import wide_view
from stratiform.plans import serving
from stratiform.registry.inputs import (
    EVENT_FAMILIES,
    EVENT_RECORD,
    EVENT_TYPES,
    STATION_DAYS_SQL,
    TRIPS_SQL,
    WIDE_VIEW_SQL,
    event_json,
    events_wide,
    nation_code,
    station_days,
    table,
    trips,
)
from stratiform.session import new_path, scratch, stage
from stratiform.sinks import delete_folder
from stratiform.sources.envelope import list_files
from stratiform.streaming import (
    Range,
    enrich,
    envelope_stream,
    ingest_records,
    keep_first,
    keep_newest,
    late_rows,
    read_enriched,
    read_first,
    read_newest,
    upsert_cells,
)


def _stream(spark: SparkSession, df: DataFrame, label: str, files_per_trigger: int = 1000) -> DataFrame:
    """The rows of ``df`` as a file stream."""
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_ingest_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged, landed = new_path(spark, "staged-events"), new_path(spark, "landed-events")
    table(spark, sf_dir, "events").select(event_json().alias("value")).write.text(staged)
    ingest_records(envelope_stream(spark, staged), EVENT_RECORD, landed, f"{landed}-state").awaitTermination()
    return bind_by_name(spark.read.parquet(landed), EVENT_TYPES)


def stream_dedup_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event polled twice, in six batches that are in no order of time."""
    events = table(spark, sf_dir, "events")
    polled = events.withColumn("poll", F.explode(F.array(F.lit(1), F.lit(2))))
    shuffled = polled.repartition(6, F.xxhash64("event_id", "poll"))
    out = new_path(spark, "clean-events")
    stream = _stream(spark, shuffled, "polled-events", files_per_trigger=1)
    keep_first(stream, ["event_id"], "ts", dt.timedelta(days=1), out, f"{out}-state").awaitTermination()
    return bind_by_name(read_first(spark, out), EVENT_TYPES)


def stream_newest_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three polls that differ, in several batches: the newest copy of every event."""
    events = table(spark, sf_dir, "events")
    polled = events.withColumn("poll", F.explode(F.sequence(F.lit(1), F.lit(3))))
    polled = polled.withColumn("value", F.col("value") - F.col("poll"))  # a newer copy is a lesser row
    path = new_path(spark, "newest-events")
    stream = _stream(spark, polled.repartition(6), "polled-events", files_per_trigger=2)
    keep_newest(stream, ["event_id"], ["poll"], path, f"{path}-state").awaitTermination()
    return read_newest(spark, path, ["event_id"], ["poll"])


def stream_upsert_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "cells")
    wide = events_wide(spark, sf_dir).withColumn("version_ts", F.col("version_ts").cast("timestamp"))
    stream = _stream(spark, wide, "wide-events")
    upsert_cells(stream, EVENT_FAMILIES, path, f"{path}-state").awaitTermination()
    return serving.scan(spark, path, EVENT_FAMILIES)


FILE_ROWS = 250_000
BATCH_ROWS = 6_000_000


def _stream_in_order(
    spark: SparkSession,
    df: DataFrame,
    time: str,
    label: str,
    parts: int,
    file_rows: int = FILE_ROWS,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """The rows of ``df`` as a stream of ``parts`` batches, each later than the one before; rows without a time come first.

    There are more batches if they would have more than ``batch_rows`` rows, as a batch waits in state as a whole.
    Every batch has the same number of files, as many as its rows need; files without rows fill up short ones.
    The rows are dealt into folders by batch in one pass, so a batch is written without reading the others.
    """
    path, apart = new_path(spark, label), new_path(spark, label)
    with scratch(spark):
        df = stage(df, label)
        count = df.count()
        parts = max(parts, -(-count // batch_rows))
        seconds = F.unix_seconds(F.col(time).cast("timestamp"))
        cuts = df.select(seconds.alias("s")).approxQuantile("s", [k / parts for k in range(1, parts)], min(0.01, 0.1 / parts))
        part = sum((F.when(seconds >= F.lit(cut), 1).otherwise(0) for cut in cuts), F.lit(0))
        numbered = df.withColumn("_part", part)
        numbered.write.partitionBy("_part").parquet(apart)
    dealt = spark.read.schema(numbered.schema).parquet(apart)
    files = max(1, -(-count // (parts * file_rows)))
    nothing = spark.createDataFrame([], df.schema).coalesce(1)
    for k in range(parts):
        rows = dealt.where(F.col("_part") == k).drop("_part")
        (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(path)
        delete_folder(spark, f"{apart}/_part={k}")
        for _ in range((k + 1) * files - list_files(spark, f"{path}/*.parquet").count()):
            nothing.write.mode("append").parquet(path)
    delete_folder(spark, apart)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_enrich_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with what their arrival's station saw in the 36 hours before; every third day is missing."""
    flown = trips(spark, sf_dir).select("trip_id", "snapshot", "arrival_code", "arrival_scheduled")
    day = F.make_timestamp_ntz("year", "month", "day", F.lit(0), F.lit(0), F.lit(0)).alias("observed")
    days = station_days(spark, sf_dir).where(F.col("day") % 3 != 0).select(nation_code("station_code").alias("arrival_code"), day, "rain")
    match = Range(["arrival_code"], "arrival_scheduled", "observed", dt.timedelta(hours=36))
    path = new_path(spark, "enriched-trips")
    left = _stream_in_order(spark, flown, "arrival_scheduled", "flown", 4)
    right = _stream_in_order(spark, days, "observed", "observed", 3)
    query = enrich(left, right, match, dt.timedelta(days=1), path, f"{path}-state")
    query.awaitTermination()
    if late_rows(query):
        raise ValueError(f"{late_rows(query)} rows were late")
    return read_enriched(spark, path, f"{path}-state", match)


QUERIES = {
    "stream_ingest_parity": stream_ingest_parity,
    "stream_dedup_parity": stream_dedup_parity,
    "stream_newest_parity": stream_newest_parity,
    "stream_upsert_parity": stream_upsert_parity,
    "stream_enrich_parity": stream_enrich_parity,
}

ORACLE = {
    "stream_ingest_parity": "SELECT * FROM events",
    "stream_dedup_parity": "SELECT * FROM events",
    "stream_newest_parity": """
        SELECT event_id, ts, user_id, event_type, value - 3 AS value, props, CAST(3 AS INTEGER) AS poll FROM events
    """,
    "stream_upsert_parity": f"{WIDE_VIEW_SQL} SELECT * FROM wide",
    "stream_enrich_parity": f"""
        WITH days AS (
            SELECT 'N' || lpad(CAST(station_code AS VARCHAR), 2, '0') AS code, make_timestamp(year, month, day, 0, 0, 0) AS observed, rain
            FROM ({STATION_DAYS_SQL}) WHERE day % 3 <> 0
        )
        SELECT trip_id, snapshot, arrival_code, arrival_scheduled, observed, rain
        FROM ({TRIPS_SQL}) t LEFT JOIN days d
        ON t.arrival_code = d.code AND observed <= arrival_scheduled AND arrival_scheduled < observed + INTERVAL 36 HOUR
    """,
}
