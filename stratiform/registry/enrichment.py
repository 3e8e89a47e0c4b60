"""Joins, dedup and the enriched gold table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions import date_parts
from stratiform.operators import (
    any_not_null,
    either,
    inner_join,
    latest_per_key,
    left_enrich,
    lookup_left_join,
    membership_flag,
    rename_with_prefix,
    shift_year,
)
from stratiform.plans.gold import enrich_sides
from stratiform.registry.inputs import (
    CODE_OF_STATION,
    CODE_OF_STATION_SQL,
    DOMESTIC,
    DOMESTIC_SQL,
    STATION_DAYS_SQL,
    TRIPS_SQL,
    nation_code,
    station_days,
    table,
    trips,
)
from stratiform.session import stage

TRIP_KEY = ["arrival_scheduled", "departure_scheduled", "trip_id"]


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {**date_parts("arrival_scheduled", "arrival_"), **date_parts("departure_scheduled", "departure_")}
    )


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station days as a written table, which is what the gold step reads."""
    return stage(station_days(spark, sf_dir), "station-days")


def _gold(spark: SparkSession, sf_dir: str, literal: bool) -> DataFrame:
    live = trips(spark, sf_dir).where(any_not_null(["live_speed", "live_altitude"]))
    flagged = _dated(latest_per_key(live, TRIP_KEY, ["snapshot"])).withColumn(
        "domestic", membership_flag("departure_code" if literal else "arrival_code", DOMESTIC)
    )
    stations = lookup_left_join(
        _stations(spark, sf_dir), CODE_OF_STATION, "code string, station_name string", on="station_name"
    )
    return enrich_sides(flagged, stations, "domestic", "code", literal)


def gold_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir, literal=False)


def gold_enriched_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir, literal=True)


def _gold_sql(flag: str, second_half: str) -> str:
    measures = ("station_code", "station_name", "temperature", "rain", "snow")
    filled = {s: ", ".join(f"w.{m} AS {s}_{m}" for m in measures) for s in ("arrival", "departure")}
    return f"""
    WITH trips AS ({TRIPS_SQL}),
    latest AS (
        SELECT * FROM trips
        WHERE live_speed IS NOT NULL OR live_altitude IS NOT NULL
        QUALIFY row_number() OVER (
            PARTITION BY arrival_scheduled, departure_scheduled, trip_id
            ORDER BY snapshot DESC NULLS LAST, arrival_code DESC, departure_code DESC, craft DESC,
                     carrier DESC, delay DESC, live_speed DESC NULLS LAST, live_altitude DESC NULLS LAST) = 1
    ),
    flagged AS (
        SELECT *,
               CAST(year(arrival_scheduled) AS INTEGER) AS arrival_year,
               CAST(month(arrival_scheduled) AS INTEGER) AS arrival_month,
               CAST(day(arrival_scheduled) AS INTEGER) AS arrival_day,
               CAST(year(departure_scheduled) AS INTEGER) AS departure_year,
               CAST(month(departure_scheduled) AS INTEGER) AS departure_month,
               CAST(day(departure_scheduled) AS INTEGER) AS departure_day,
               coalesce({flag} IN ({DOMESTIC_SQL}), false) AS domestic
        FROM latest
    ),
    stations AS (
        SELECT s.*, l.code FROM ({STATION_DAYS_SQL}) s
        LEFT JOIN (VALUES {CODE_OF_STATION_SQL}) l(code, station_name) USING (station_name)
    )
    SELECT t.*, {filled["arrival"]} FROM flagged t LEFT JOIN stations w
        ON t.arrival_code = w.code AND t.arrival_year = w.year
        AND t.arrival_month = w.month AND t.arrival_day = w.day
    WHERE domestic
    UNION ALL BY NAME
    SELECT t.*, {filled["departure"]} FROM flagged t LEFT JOIN stations w
        ON t.departure_code = w.code AND t.departure_year = w.year
        AND t.departure_month = w.month AND t.departure_day = w.day
    WHERE {second_half}
    """


def snapshot_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])


def trip_dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(trips(spark, sf_dir), TRIP_KEY, ["snapshot"])


def membership_flag_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the split in one pass: which side a row is on decides its columns."""
    flag = membership_flag("arrival_code", DOMESTIC)
    sides = trips(spark, sf_dir).select(
        either(flag, F.lit("arrival"), F.lit("departure")).alias("side"),
        either(flag, F.col("arrival_code"), F.col("departure_code")).alias("code"),
    )
    return sides.groupBy("side", "code").agg(F.count("*").alias("n"))


def prefix_rename_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_with_prefix(station_days(spark, sf_dir), "arrival_", {"station_name": "station"})


def two_source_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.col("c_nationkey").alias("station_code"),
            *(column.alias(name) for name, column in date_parts("o_orderdate").items()),
        )
        .agg(F.max("o_totalprice").alias("top_price"), F.count("*").alias("orders"))
        .withColumn("station_name", F.lit("shared"))
    )
    return inner_join(
        station_days(spark, sf_dir), ordered, on=["station_code", "year", "month", "day"], drop=["station_name"]
    )


def lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("station_name")
    )
    return lookup_left_join(customers, CODE_OF_STATION, "airport_code string, station_name string", on="station_name")


def station_day_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = _stations(spark, sf_dir).select(
        nation_code("station_code").alias("code"), "year", "month", "day", "temperature", "rain"
    )
    joined = _dated(trips(spark, sf_dir))
    for prefix in ("arrival_", "departure_"):
        keys = [f"{prefix}{part}" for part in ("year", "month", "day", "code")]
        joined = left_enrich(joined, rename_with_prefix(stations, prefix), keys)
    return joined


def prior_year_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = (
        table(spark, sf_dir, "orders")
        .groupBy(*(column.alias(name) for name, column in date_parts("o_orderdate").items()))
        .agg(F.count("*").alias("orders"), F.max("o_totalprice").alias("top_price"))
    )
    daily = stage(daily, "daily")  # used twice; the planner knows its size from the files
    before = shift_year(daily).withColumnsRenamed({"orders": "orders_before", "top_price": "top_price_before"})
    return left_enrich(daily, before, ["year", "month", "day"], broadcast_limit=None)


_DATED_SQL = f"""
    SELECT *,
           CAST(year(arrival_scheduled) AS INTEGER) AS arrival_year,
           CAST(month(arrival_scheduled) AS INTEGER) AS arrival_month,
           CAST(day(arrival_scheduled) AS INTEGER) AS arrival_day,
           CAST(year(departure_scheduled) AS INTEGER) AS departure_year,
           CAST(month(departure_scheduled) AS INTEGER) AS departure_month,
           CAST(day(departure_scheduled) AS INTEGER) AS departure_day
    FROM ({TRIPS_SQL})
"""

_DAILY_SQL = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
           CAST(day(o_orderdate) AS INTEGER) AS day, count(*) AS orders, max(o_totalprice) AS top_price
    FROM orders GROUP BY ALL
"""

QUERIES = {
    "gold_enriched": gold_enriched,
    "gold_enriched_literal": gold_enriched_literal,
    "snapshot_dedup_latest": snapshot_dedup_latest,
    "trip_dedup_latest": trip_dedup_latest,
    "membership_flag_split": membership_flag_split,
    "prefix_rename_project": prefix_rename_project,
    "two_source_inner_join": two_source_inner_join,
    "lookup_left_join": lookup_left,
    "station_day_left_join": station_day_left_join,
    "prior_year_left_join": prior_year_left_join,
}

ORACLE = {
    "gold_enriched": _gold_sql("arrival_code", "NOT domestic"),
    "gold_enriched_literal": _gold_sql("departure_code", "domestic"),
    "snapshot_dedup_latest": """
        SELECT * FROM events
        QUALIFY row_number() OVER (
            PARTITION BY user_id, event_type
            ORDER BY ts DESC, event_id DESC, value DESC, props DESC) = 1
    """,
    "trip_dedup_latest": f"""
        SELECT * FROM ({TRIPS_SQL})
        QUALIFY row_number() OVER (
            PARTITION BY arrival_scheduled, departure_scheduled, trip_id
            ORDER BY snapshot DESC NULLS LAST, arrival_code DESC, departure_code DESC, craft DESC,
                     carrier DESC, delay DESC, live_speed DESC NULLS LAST, live_altitude DESC NULLS LAST) = 1
    """,
    "membership_flag_split": f"""
        WITH flagged AS (
            SELECT *, coalesce(arrival_code IN ({DOMESTIC_SQL}), false) AS domestic FROM ({TRIPS_SQL})
        )
        SELECT 'arrival' AS side, arrival_code AS code, count(*) AS n FROM flagged
        WHERE domestic GROUP BY arrival_code
        UNION ALL
        SELECT 'departure', departure_code, count(*) FROM flagged
        WHERE NOT domestic GROUP BY departure_code
    """,
    "prefix_rename_project": f"""
        SELECT station_name AS station, station_code AS arrival_station_code, year AS arrival_year,
               month AS arrival_month, day AS arrival_day, temperature AS arrival_temperature,
               rain AS arrival_rain, snow AS arrival_snow
        FROM ({STATION_DAYS_SQL})
    """,
    "two_source_inner_join": f"""
        SELECT * FROM ({STATION_DAYS_SQL}) JOIN (
            SELECT c_nationkey AS station_code, CAST(year(o_orderdate) AS INTEGER) AS year,
                   CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day,
                   max(o_totalprice) AS top_price, count(*) AS orders
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
        ) USING (station_code, year, month, day)
    """,
    "lookup_left_join": f"""
        SELECT c_custkey, station_name, code AS airport_code
        FROM (SELECT c_custkey, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS station_name FROM customer)
        LEFT JOIN (VALUES {CODE_OF_STATION_SQL}) l(code, station_name) USING (station_name)
    """,
    "station_day_left_join": f"""
        WITH stations AS (
            SELECT 'N' || lpad(CAST(station_code AS VARCHAR), 2, '0') AS code, year, month, day, temperature, rain
            FROM ({STATION_DAYS_SQL})
        )
        SELECT t.*, a.temperature AS arrival_temperature, a.rain AS arrival_rain,
               d.temperature AS departure_temperature, d.rain AS departure_rain
        FROM ({_DATED_SQL}) t
        LEFT JOIN stations a ON arrival_code = a.code AND arrival_year = a.year
            AND arrival_month = a.month AND arrival_day = a.day
        LEFT JOIN stations d ON departure_code = d.code AND departure_year = d.year
            AND departure_month = d.month AND departure_day = d.day
    """,
    "prior_year_left_join": f"""
        WITH daily AS ({_DAILY_SQL})
        SELECT n.*, p.orders AS orders_before, p.top_price AS top_price_before
        FROM daily n LEFT JOIN daily p
            ON n.year = p.year + 1 AND n.month = p.month AND n.day = p.day
    """,
}
