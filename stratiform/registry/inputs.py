"""The test tables seen as trips, station days, events and envelopes.

A trip is a line item: it departs from the supplier's nation on the order date and
arrives at the customer's nation on the ship date. A station day is what a nation's
suppliers shipped on a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions import date_parts, mean
from stratiform.session import configure

DOMESTIC = [f"N{k:02d}" for k in range(10)]
CODE_OF_STATION = [(f"N{k:02d}", f"NATION_{k}") for k in range(10)]

DOMESTIC_SQL = ", ".join(f"'{code}'" for code in DOMESTIC)
CODE_OF_STATION_SQL = ", ".join(f"('{code}', '{station}')" for code, station in CODE_OF_STATION)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def nation_code(key: str) -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col(key).cast("string"), 2, "0"))


def nullif(column: str, value) -> Column:
    return F.nullif(F.col(column), F.lit(value))


TRIPS_SQL = """
    SELECT l_orderkey AS trip_id,
           l_shipdate AS arrival_scheduled,
           o_orderdate AS departure_scheduled,
           'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS arrival_code,
           'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS departure_code,
           l_linenumber AS snapshot,
           l_partkey AS craft,
           l_suppkey AS carrier,
           CAST(l_quantity AS INTEGER) AS delay,
           nullif(l_discount, 0) AS live_speed,
           nullif(l_tax, 0) AS live_altitude
    FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey
    JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey
"""


TASK_ROWS = 100_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Tasks of about ``rows`` rows of a table: as many as there are cores for small ones, down to a fifth of that size."""
    counted, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-counted // rows), min(cores, counted * 5 // rows))


def trips(spark: SparkSession, sf_dir: str, evenly: bool = False) -> DataFrame:
    """Orders meet their customers first, so line items shuffle by order key last.

    That partitioning then also serves a grouping that includes the trip id. ``evenly`` sizes its tasks by
    rows (``tasks_for``), where rows grow after the shuffle, which AQE does not know of.
    """
    bookings = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "o_orderdate", nation_code("c_nationkey").alias("arrival_code"))
    )
    legs = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    if evenly:
        legs = legs.repartition(tasks_for(table(spark, sf_dir, "lineitem")), "l_orderkey")
    return legs.join(bookings, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("trip_id"),
        F.col("l_shipdate").alias("arrival_scheduled"),
        F.col("o_orderdate").alias("departure_scheduled"),
        "arrival_code",
        nation_code("s_nationkey").alias("departure_code"),
        F.col("l_linenumber").alias("snapshot"),
        F.col("l_partkey").alias("craft"),
        F.col("l_suppkey").alias("carrier"),
        F.col("l_quantity").cast("int").alias("delay"),
        nullif("l_discount", 0.0).alias("live_speed"),
        nullif("l_tax", 0.0).alias("live_altitude"),
    )


STATION_DAYS_SQL = """
    SELECT s_nationkey AS station_code,
           'NATION_' || CAST(s_nationkey AS VARCHAR) AS station_name,
           CAST(year(l_shipdate) AS INTEGER) AS year,
           CAST(month(l_shipdate) AS INTEGER) AS month,
           CAST(day(l_shipdate) AS INTEGER) AS day,
           round(avg(l_quantity), 6) AS temperature,
           max(l_discount) AS rain,
           min(l_tax) AS snow
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    GROUP BY ALL
"""


def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    )
    day = [column.alias(name) for name, column in date_parts("l_shipdate").items()]
    return (
        shipped.groupBy(F.col("s_nationkey").alias("station_code"), *day)
        .agg(
            F.round(mean("l_quantity"), 6).alias("temperature"),
            F.max("l_discount").alias("rain"),
            F.min("l_tax").alias("snow"),
        )
        .withColumn("station_name", F.concat(F.lit("NATION_"), F.col("station_code").cast("string")))
    )


EVENT_RECORD = "event_id STRING, ts STRING, user_id STRING, event_type STRING, value STRING, props STRING"
EVENT_TYPES = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)


def event_json(records: int = 1) -> Column:
    """An envelope that holds this event ``records`` times, its leaves as text or numbers."""
    record = F.struct(
        "event_id", F.col("ts").cast("string").alias("ts"), "user_id", "event_type", "value", "props"
    )
    return F.to_json(F.struct(F.array(*[record] * records).alias("data")))


EVENT_FAMILIES = {"event": ["kind", "source"], "measure": ["amount", "k"]}

EVENTS_WIDE_SQL = """
    SELECT 'row' || CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') AS row_key,
           CASE WHEN event_id % 6 <> 0 THEN event_type END AS kind,
           CASE WHEN event_type <> 'error' THEN 'web' || CAST(event_id % 10 AS VARCHAR) END AS source,
           CASE WHEN event_type <> 'view' THEN CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR) END AS amount,
           CASE WHEN event_id % 4 = 0 THEN 'n/a'
                WHEN event_type <> 'click' THEN regexp_extract(props, '[0-9]+') END AS k,
           ts AS version_ts
    FROM events
"""


def events_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a sparse table: some cells are missing, some are unreadable."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat_ws("_", F.concat(F.lit("row"), F.col("user_id").cast("string")), F.date_format("ts", "yyyy-MM-dd"))
        .alias("row_key"),
        F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("kind"),
        F.when(
            F.col("event_type") != "error", F.concat(F.lit("web"), (F.col("event_id") % 10).cast("string"))
        ).alias("source"),
        F.when(F.col("event_type") != "view", F.col("value").cast("decimal(12,2)").cast("string")).alias("amount"),
        F.when(F.col("event_id") % 4 == 0, "n/a")
        .when(F.col("event_type") != "click", F.get_json_object("props", "$.k"))
        .alias("k"),
        F.col("ts").alias("version_ts"),
    )


def newest_sql(column: str, source: str) -> str:
    """Newest value of a column per row key; equal versions fall back to the greater value."""
    return f"""
        SELECT row_key, {column} FROM {source} WHERE {column} IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY row_key ORDER BY version_ts DESC, {column} DESC) = 1
    """


WIDE_VIEW_SQL = f"""
    WITH events_wide AS ({EVENTS_WIDE_SQL}),
    present AS (
        SELECT DISTINCT row_key FROM events_wide
        WHERE kind IS NOT NULL OR source IS NOT NULL OR amount IS NOT NULL OR k IS NOT NULL
    ),
    wide AS (
        SELECT * FROM present
        LEFT JOIN ({newest_sql("kind", "events_wide")}) USING (row_key)
        LEFT JOIN ({newest_sql("source", "events_wide")}) USING (row_key)
        LEFT JOIN ({newest_sql("amount", "events_wide")}) USING (row_key)
        LEFT JOIN ({newest_sql("k", "events_wide")}) USING (row_key)
    )
"""
