"""What an ingest keeps beside the rows: fields that no schema names, and counts of different values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions.casting import bind_by_name
from stratiform.plans.distinct import DistinctCounts
from stratiform.plans.ingest import write_parsed
from stratiform.registry.inputs import table
from stratiform.session import new_path
from stratiform.snapshots import Snapshots, batch_folder, read_committed
from stratiform.sources import drift
from stratiform.sources.envelope import parse_envelopes, read_envelopes, records

_RECORD = "event_id STRING, ts STRING, user STRUCT<id: STRING>"
_SILVER = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT"


def _drifting_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver of events whose envelopes have more fields than the schema, some in an object that it names."""
    staged, silver = new_path(spark, "staged"), new_path(spark, "silver")
    user = F.struct(F.col("user_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Wyspa "), "event_type")).alias("home"))
    gate = F.when(F.col("event_id") % 4 != 0, F.struct((F.col("event_id") % 7).alias("no"), F.array("event_type").alias("tags")))
    record = F.struct("event_id", F.col("ts").cast("string").alias("ts"), user.alias("user"), gate.alias("gate"), F.col("event_type").alias("kind"))
    table(spark, sf_dir, "events").select(F.to_json(F.struct(F.array(record).alias("data"))).alias("value")).write.text(staged)
    parsed = drift.with_unknown(parse_envelopes(read_envelopes(spark, staged), _RECORD), _RECORD)

    def rows(kept: DataFrame) -> DataFrame:
        flat = records(kept).withColumn("user_id", F.col("user.id"))
        return bind_by_name(flat, f"{_SILVER}, {drift.UNKNOWN} {drift.KEPT}")

    write_parsed(parsed, rows, "events", silver, f"{silver}-quarantine", "first")
    Snapshots(spark, silver).commit([batch_folder("first")])
    return read_committed(spark, silver)


def unknown_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the schema did not have, found again after silver with types of their own."""
    return _drifting_silver(spark, sf_dir).select(
        "event_id", "ts", "user_id", drift.field("kind", "string").alias("kind"), drift.field("user.home", "string").alias("home"),
        drift.field("gate", "bigint", "$.no").alias("gate_no"), drift.field("gate", "string", "$.tags[0]").alias("tag"),
    )


def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that the schema does not have, how often they stand, and what fits all their values."""
    return drift.drift(_drifting_silver(spark, sf_dir)).drop("nulls")


def distinct_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day and kind, by either and over all: sketches of three batches against exact counts."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("kind"))
    counts = DistinctCounts(spark, new_path(spark, "sketches"), ["day", "kind"], ["user_id"])
    for batch in (0, 1, 2, 0):  # the first is delivered again
        counts.add(events.where(F.col("event_id") % 3 == batch), str(batch))
    levels = (["day", "kind"], ["day"], ["kind"], [])
    sets = [[F.col(c) for c in level] for level in levels]
    exact = events.groupingSets(sets, "day", "kind").agg(F.countDistinct("user_id").alias("users"))
    estimated = counts.by_level(*levels).withColumnsRenamed({"day": "_day", "kind": "_kind"})
    same = F.col("day").eqNullSafe(F.col("_day")) & F.col("kind").eqNullSafe(F.col("_kind"))
    close = F.abs(F.col("user_id") - F.col("users")) <= 4 * counts.error * F.col("users")
    return exact.join(estimated, same).select("level", "day", "kind", "users", close.alias("within"))


QUERIES = {"unknown_fields": unknown_fields, "schema_drift": schema_drift, "distinct_rollup": distinct_rollup}

ORACLE = {
    "unknown_fields": """
        SELECT event_id, ts, user_id, event_type AS kind,
               CASE WHEN event_id % 3 = 0 THEN 'Wyspa ' || event_type END AS home,
               CASE WHEN event_id % 4 <> 0 THEN event_id % 7 END AS gate_no,
               CASE WHEN event_id % 4 <> 0 THEN event_type END AS tag
        FROM events
    """,
    "schema_drift": """
        SELECT 'kind' AS field, count(*) AS n, 'STRING' AS type FROM events
        UNION ALL SELECT 'user.home', count(*), 'STRING' FROM events WHERE event_id % 3 = 0
        UNION ALL SELECT 'gate', count(*), 'OBJECT<no: BIGINT, tags: ARRAY<STRING>>' FROM events WHERE event_id % 4 <> 0
    """,
    "distinct_rollup": """
        SELECT concat_ws(',', CASE WHEN grouping(day) = 0 THEN 'day' END, CASE WHEN grouping(kind) = 0 THEN 'kind' END) AS level,
               day, kind, count(DISTINCT user_id) AS users, true AS within
        FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS kind FROM events)
        GROUP BY GROUPING SETS ((day, kind), (day), (kind), ())
    """,
}
