"""Tables over time: snapshots, tiers, versions of dimensions, and the ingest jobs end to end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform import sinks
from stratiform.functions.casting import bind_by_name
from stratiform.operators import puts
from stratiform.operators.ordered import as_of, valid_at, validity
from stratiform.plans import dimensions, weather
from stratiform.plans.fixed import DIMENSIONS
from stratiform.plans.ingest import ingest_files, write_parsed
from stratiform.plans.lookup import ValueIndex
from stratiform.plans.means import Means
from stratiform.plans.tiers import Tiers, buckets_for
from stratiform.registry.inputs import (
    EVENT_FAMILIES,
    EVENT_RECORD,
    EVENT_TYPES,
    STATION_DAYS_SQL,
    TRIPS_SQL,
    WIDE_VIEW_SQL,
    event_json,
    events_wide,
    station_days,
    table,
    trips,
)
from stratiform.session import new_path
from stratiform.snapshots import Snapshots, batch_folder, read_committed
from stratiform.sources.envelope import list_files, parse_envelopes, read_envelopes, records
from stratiform.sources.tables import read_table


def _events_ingest(spark: SparkSession, staged: str, silver: str, archive: str | None = None, fail: bool = False) -> None:
    """The ingest of staged event envelopes; with ``fail`` it ends after the rows are written."""
    bad = f"{silver}-quarantine"

    def write(paths: list[str], batch: str) -> None:
        parsed = parse_envelopes(read_envelopes(spark, paths), EVENT_RECORD)
        write_parsed(parsed, lambda kept: bind_by_name(records(kept), EVENT_TYPES), "events", silver, bad, batch)
        if fail:
            raise InterruptedError(batch)

    ingest_files(spark, [f"{staged}/*/*.txt"], silver, write, archive)


def _stage_events(spark: SparkSession, sf_dir: str, staged: str, part: int) -> None:
    half = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == part)
    half.select(event_json().alias("value")).write.text(f"{staged}/{part}")


def snapshot_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see while a batch is written but not committed, after a commit that broke off, and after the rerun."""
    staged, silver = new_path(spark, "staged"), new_path(spark, "silver")
    _stage_events(spark, sf_dir, staged, 0)
    _events_ingest(spark, staged, silver)
    _stage_events(spark, sf_dir, staged, 1)
    seen = []

    def look(moment: str) -> None:
        rows = read_committed(spark, silver).select(F.lit(moment).alias("moment"), "event_id", "value")
        seen.append(rows)

    try:
        _events_ingest(spark, staged, silver, fail=True)
    except InterruptedError as unfinished:
        look("unfinished")
        snapshots = Snapshots(spark, silver)
        snapshots.prepare([*snapshots.folders(), batch_folder(str(unfinished))])  # the list is there, but not in place
        look("broken off")
    _events_ingest(spark, staged, silver)
    look("complete")
    return seen[0].union(seen[1]).union(seen[2])


def append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in three parts to a table by event type."""
    path = new_path(spark, "appended")
    for part in range(3):
        sinks.append(table(spark, sf_dir, "events").where(F.col("event_id") % 3 == part), path, ["event_type"])
    return read_table(spark, path)


def ingest_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after an ingest that moves its files away, with the numbers of files left and moved."""
    staged, silver, archive = (new_path(spark, label) for label in ("staged", "silver", "archive"))
    for part in range(2):
        _stage_events(spark, sf_dir, staged, part)
        _events_ingest(spark, staged, silver, archive)
    left, moved = (list_files(spark, glob).count() for glob in (f"{staged}/*/*.txt", f"{archive}/*"))
    counts = (F.lit(left).cast("long").alias("files_left"), F.lit(moved > 1).alias("files_moved"))
    return read_committed(spark, silver).select("event_id", "ts", "value", *counts)


def _name_files(spark: SparkSession, folder: str, target: str, name: str) -> None:
    """Give the files that Spark wrote into ``folder`` the names ``name.format(k)`` in ``target``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(conf)
    system.mkdirs(path(target))
    parts = [status.getPath() for status in system.listStatus(path(folder)) if status.getPath().getName().startswith("part-")]
    for k, part in enumerate(sorted(parts, key=lambda p: p.getName())):
        system.rename(part, path(f"{target}/{name.format(k)}"))


def dimension_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airlines from envelope files, by the job: fields it knows are taken by name, others are dropped."""
    work, staged, silver = (new_path(spark, label) for label in ("airlines", "staged", "silver"))
    name = F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit("Linie Ł"), F.col("s_suppkey").cast("string")))
    record = F.struct(
        F.col("s_nationkey").alias("country_iso2"), F.col("s_suppkey").alias("id"), name.alias("airline_name"),
        F.col("s_acctbal").cast("decimal(12,2)").cast("string").alias("fleet_size"), F.lit("dropped").alias("unknown"),
    )
    rows = table(spark, sf_dir, "supplier").select(F.to_json(F.struct(F.array(record).alias("data"))).alias("value"))
    rows.repartition(3).write.text(work)
    _name_files(spark, work, staged, "airlines_{}.json")
    for _ in range(2):
        dimensions.run(spark, "airlines", staged, silver, f"{silver}-quarantine")
    return read_committed(spark, silver).select(*DIMENSIONS["airlines"])


def weather_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station days from files of both families, by the job; one family arrives later than the other."""
    staged, silver = new_path(spark, "staged"), new_path(spark, "silver")
    days = station_days(spark, sf_dir)
    front = [F.col("station_code").cast("string"), F.concat(F.lit('"'), "station_name", F.lit('"'))]
    front += [F.col(part).cast("string") for part in ("year", "month", "day")]
    rain, snow = (F.col(c).cast("decimal(6,2)").cast("string") for c in ("rain", "snow"))
    empty = F.lit("")
    term = [snow, F.lit("8"), rain, empty, rain, empty, snow, empty]
    day = [rain, empty, snow, F.lit("9"), snow, empty, rain, F.lit("8"), rain, F.lit("9"), F.lit("W"), snow, empty]
    for values, name in ((term, "k_d_t_{}.csv"), (day, "k_d_{}.csv")):
        work = new_path(spark, "lines")
        days.select(F.concat_ws(",", *front, *values).alias("value")).repartition(2).write.text(work)
        _name_files(spark, work, staged, name)
        weather.run(spark, staged, silver)
    columns = ["station_code", "station_name", "year", "month", "day", "humidity_avg", "rain", "rain_status", "snow_height"]
    return weather.newest(read_committed(spark, silver)).select(*columns)


def _tiers(spark: SparkSession, sf_dir: str) -> Tiers:
    return Tiers(spark, new_path(spark, "tiers"), buckets=buckets_for(table(spark, sf_dir, "events").count(), 8), fan=3)


def serving_tiered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events published in seven runs that are merged by level on the way, read without an exchange."""
    tiers = _tiers(spark, sf_dir)
    wide = events_wide(spark, sf_dir).withColumn("version_ts", F.col("version_ts").cast("timestamp"))
    part = F.pmod(F.xxhash64("row_key", "version_ts", "k"), F.lit(7))
    for run in range(7):
        tiers.add(puts.wide_to_puts(wide.where(part == run), EVENT_FAMILIES))
        tiers.merge()
    return tiers.scan(EVENT_FAMILIES)


def incremental_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean amount by kind, brought up to date after each of four runs that correct each other's rows."""
    tiers = _tiers(spark, sf_dir)
    means = Means(tiers, new_path(spark, "means"), ("event", "kind"), ("measure", "amount"))
    wide = events_wide(spark, sf_dir).withColumn("version_ts", F.col("version_ts").cast("timestamp"))
    part = F.pmod(F.xxhash64("row_key", "version_ts", "k"), F.lit(4))
    for run in range(4):
        tiers.add(puts.wide_to_puts(wide.where(part == run), EVENT_FAMILIES))
        means.update()
        tiers.merge()
    return means.means("kind", "amount").withColumn("amount", F.round("amount", 6))


def serving_value_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose newest source is web3, by an index that follows three runs which correct each other."""
    tiers = _tiers(spark, sf_dir)
    index = ValueIndex(tiers, new_path(spark, "index"), [("event", "source")], file_rows=2000)
    wide = events_wide(spark, sf_dir).withColumn("version_ts", F.col("version_ts").cast("timestamp"))
    part = F.pmod(F.xxhash64("row_key", "version_ts", "k"), F.lit(3))
    for run in range(3):
        tiers.add(puts.wide_to_puts(wide.where(part == run), EVENT_FAMILIES))
        index.update()
        tiers.merge()
    return index.find(EVENT_FAMILIES, ("event", "source"), "web3")


def _carrier_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier looked like in every month that it shipped in."""
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("delivered")
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("carrier"), month)
    return grouped.agg(F.max("l_returnflag").alias("flag"), (F.count("*") % 3).cast("int").alias("tier"))


def dimension_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of suppliers that are delivered again month by month."""
    return validity(_carrier_deliveries(spark, sf_dir), ["carrier"], ["flag", "tier"], "delivered")


def dimension_valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with the version of their carrier that held at departure."""
    flown = trips(spark, sf_dir).select("trip_id", "snapshot", "carrier", "departure_scheduled")
    versions = validity(_carrier_deliveries(spark, sf_dir), ["carrier"], ["flag", "tier"], "delivered")
    return valid_at(flown, versions, ["carrier"], "departure_scheduled", dt.timedelta(days=90))


def _code() -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col("station_code").cast("string"), 2, "0")).alias("arrival_code")


def nearest_station_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with the latest station day at or before their arrival, at most ten days old; every third day is missing."""
    flown = trips(spark, sf_dir).select("trip_id", "snapshot", "arrival_code", "arrival_scheduled")
    day = F.make_timestamp_ntz("year", "month", "day", F.lit(0), F.lit(0), F.lit(0)).alias("observed")
    days = station_days(spark, sf_dir).where(F.col("day") % 3 != 0).select(_code(), day, "rain", "snow")
    return as_of(flown, days, ["arrival_code"], "arrival_scheduled", "observed", within=dt.timedelta(days=10))


QUERIES = {
    "snapshot_reads": snapshot_reads,
    "append_batches": append_batches,
    "ingest_archive": ingest_archive,
    "dimension_job": dimension_job,
    "weather_job": weather_job,
    "serving_tiered_scan": serving_tiered_scan,
    "incremental_mean": incremental_mean,
    "serving_value_lookup": serving_value_lookup,
    "dimension_history": dimension_history,
    "dimension_valid_at": dimension_valid_at,
    "nearest_station_day": nearest_station_day,
}

_AIRLINE = {
    "country_iso2": "CAST(s_nationkey AS VARCHAR)",
    "id": "CAST(s_suppkey AS VARCHAR)",
    "airline_name": "CASE WHEN s_suppkey % 7 <> 0 THEN 'Linie Ł' || CAST(s_suppkey AS VARCHAR) END",
    "fleet_size": "CAST(CAST(s_acctbal AS DECIMAL(12, 2)) AS VARCHAR)",
}
_AIRLINE_SQL = ", ".join(f"{_AIRLINE.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in DIMENSIONS["airlines"])

_VERSIONS_SQL = """
    WITH delivered AS (
        SELECT l_suppkey AS carrier, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS delivered,
               max(l_returnflag) AS flag, CAST(count(*) % 3 AS INTEGER) AS tier
        FROM lineitem GROUP BY ALL
    ),
    changes AS (
        SELECT * FROM delivered
        WINDOW w AS (PARTITION BY carrier ORDER BY delivered)
        QUALIFY row_number() OVER w = 1 OR lag(flag) OVER w IS DISTINCT FROM flag OR lag(tier) OVER w IS DISTINCT FROM tier
    ),
    versions AS (
        SELECT carrier, flag, tier, delivered AS valid_from,
               lead(delivered) OVER (PARTITION BY carrier ORDER BY delivered) AS valid_to
        FROM changes
    )
"""

ORACLE = {
    "snapshot_reads": """
        SELECT 'unfinished' AS moment, event_id, value FROM events WHERE event_id % 2 = 0
        UNION ALL SELECT 'broken off', event_id, value FROM events WHERE event_id % 2 = 0
        UNION ALL SELECT 'complete', event_id, value FROM events
    """,
    "append_batches": "SELECT * FROM events",
    "ingest_archive": "SELECT event_id, ts, value, CAST(0 AS BIGINT) AS files_left, true AS files_moved FROM events",
    "dimension_job": f"SELECT {_AIRLINE_SQL} FROM supplier",
    "weather_job": f"""
        SELECT station_code, station_name, year + 1 AS year, month, day,
               CAST(CAST(rain AS DECIMAL(6, 2)) AS DOUBLE) AS humidity_avg, CAST(CAST(rain AS DECIMAL(6, 2)) AS DOUBLE) AS rain,
               'X' AS rain_status, CAST(CAST(snow AS DECIMAL(6, 2)) AS DOUBLE) AS snow_height
        FROM ({STATION_DAYS_SQL})
    """,
    "serving_tiered_scan": f"{WIDE_VIEW_SQL} SELECT * FROM wide",
    "incremental_mean": f"""
        {WIDE_VIEW_SQL}
        SELECT coalesce(kind, '0') AS kind, round(avg(coalesce(TRY_CAST(amount AS DOUBLE), 0)), 6) AS amount
        FROM wide GROUP BY 1
    """,
    "serving_value_lookup": f"{WIDE_VIEW_SQL} SELECT * FROM wide WHERE source = 'web3'",
    "dimension_history": f"{_VERSIONS_SQL} SELECT * FROM versions",
    "dimension_valid_at": f"""
        {_VERSIONS_SQL}
        SELECT trip_id, snapshot, t.carrier, departure_scheduled, flag, tier, valid_from, valid_to
        FROM ({TRIPS_SQL}) t LEFT JOIN versions v
        ON t.carrier = v.carrier AND departure_scheduled >= valid_from AND (valid_to IS NULL OR departure_scheduled < valid_to)
    """,
    "nearest_station_day": f"""
        WITH days AS (
            SELECT 'N' || lpad(CAST(station_code AS VARCHAR), 2, '0') AS code, make_timestamp(year, month, day, 0, 0, 0) AS observed, rain, snow
            FROM ({STATION_DAYS_SQL}) WHERE day % 3 <> 0
        ),
        near AS (
            SELECT trip_id, snapshot, arrival_code, arrival_scheduled, observed, rain, snow
            FROM ({TRIPS_SQL}) t ASOF LEFT JOIN days d ON t.arrival_code = d.code AND t.arrival_scheduled >= d.observed
        )
        SELECT trip_id, snapshot, arrival_code, arrival_scheduled,
               CASE WHEN arrival_scheduled - observed <= INTERVAL 10 DAY THEN observed END AS observed,
               CASE WHEN arrival_scheduled - observed <= INTERVAL 10 DAY THEN rain END AS rain,
               CASE WHEN arrival_scheduled - observed <= INTERVAL 10 DAY THEN snow END AS snow
        FROM near
    """,
}
