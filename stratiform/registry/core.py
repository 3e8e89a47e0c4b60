"""Sources, projections, casts, functions and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform import sinks
from stratiform.functions import (
    base_name,
    cast_all_to_string,
    date_parts,
    row_key,
    snapshot_time,
    status_to_boolean,
    status_to_text,
    typed,
)
from stratiform.functions.casting import bind_by_name
from stratiform.operators import (
    any_not_null,
    distinct_values,
    flatten,
    group_mean,
    project_families,
    union_all,
    union_by_name,
)
from stratiform.plans.ingest import ingest_files, write_parsed
from stratiform.registry.inputs import EVENT_RECORD, EVENT_TYPES, event_json, nullif, table
from stratiform.session import new_path
from stratiform.sources import (
    list_files,
    parse_envelopes,
    quarantined,
    read_envelopes,
    read_positional_csv,
    read_table,
    records,
)
from stratiform.sources.delimited import parse_positional

ORDER_FAMILIES = {
    "order": ["o_orderkey", "o_orderdate", "o_orderpriority"],
    "party": ["o_custkey", "o_totalprice"],
}


def json_envelope_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event in an envelope, some twice, next to envelopes without records."""
    empty = F.when(F.col("event_id") % 2 == 0, '{"data":[]}').otherwise('{"data":null}')
    full = F.when(F.col("event_id") % 5 == 0, event_json(2)).otherwise(event_json())
    lines = table(spark, sf_dir, "events").select(F.explode(F.array(full, empty)).alias("value"))
    return bind_by_name(records(parse_envelopes(lines, EVENT_RECORD)), EVENT_TYPES)


def quarantine_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines: the records of the good ones and the problems of the bad ones."""
    whole = event_json()
    line = (
        F.when(F.col("event_id") % 97 == 0, F.expr("substring(value, 1, length(value) - 2)"))
        .when(F.col("event_id") % 89 == 0, '{"error":"limit reached"}')
        .otherwise(F.col("value"))
    )
    lines = (
        table(spark, sf_dir, "events")
        .select(F.col("event_id").alias("line"), F.col("event_id"), whole.alias("value"))
        .select("line", line.alias("value"))
    )
    parsed = parse_envelopes(lines, EVENT_RECORD)
    good = bind_by_name(records(parsed), "line BIGINT, event_id BIGINT, user_id BIGINT")
    return union_by_name(good, quarantined(parsed).select("line", "problem"))


def quarantine_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of several records, some with text for an object or null: the neighbours stay."""
    good = F.to_json(F.struct("event_id", F.struct(F.col("user_id").alias("id")).alias("person")))
    bad = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"person":"n/a"}'))
    listed = F.concat_ws(
        ",", good, F.when(F.col("event_id") % 10 == 0, bad), F.when(F.col("event_id") % 7 == 0, "null"), good
    )
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit('{"data":['), listed, F.lit("]}")).alias("value"))
    parsed = parse_envelopes(lines, "event_id STRING, person STRUCT<id: STRING>")
    kept = records(parsed).select(F.col("event_id").cast("long"), F.col("person.id").cast("long").alias("user_id"))
    return union_by_name(kept, quarantined(parsed).select("value", "problem"))


def ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files ingested when they arrive, and not again by further runs."""
    staged, silver, bad = (new_path(spark, label) for label in ("staged", "silver", "quarantine"))

    def write(paths: list[str], batch: str) -> None:
        parsed = parse_envelopes(read_envelopes(spark, paths), EVENT_RECORD)
        write_parsed(parsed, lambda kept: bind_by_name(records(kept), EVENT_TYPES), "events", silver, bad, batch)

    for part in range(2):
        half = table(spark, sf_dir, "events").where(F.col("event_id") % 2 == part)
        half.select(event_json().alias("value")).write.text(f"{staged}/{part}")
        for _ in range(2):
            ingest_files(spark, [f"{staged}/*/*.txt"], silver, write)
    return read_table(spark, silver).drop(sinks.BATCH)


def struct_flatten_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 5 != 0, F.struct(F.col("event_type").alias("name"), "value"))
    person = F.when(F.col("user_id") % 7 != 0, F.struct(F.col("user_id").alias("id"), kind.alias("kind")))
    nested = table(spark, sf_dir, "events").select("event_id", person.alias("person"))
    return flatten(nested, {"label": "person.kind.name", "never": None})


def typed_try_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    def broken(column: str, every: int):
        return F.when(F.col("event_id") % every == 0, "n/a").otherwise(F.col(column).cast("string")).alias(column)

    text = table(spark, sf_dir, "events").select(
        "event_id",
        broken("user_id", 10),
        broken("value", 11),
        broken("ts", 13),
        F.when(F.col("event_type") == "view", "true")
        .when(F.col("event_type") == "error", "x")
        .otherwise("false")
        .alias("seen"),
    )
    return typed(text, {"user_id": "int", "value": "double", "ts": "timestamp_ntz", "seen": "boolean"})


def cast_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cast_all_to_string(
        table(spark, sf_dir, "orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_totalprice"
        )
    )


ORDER_LINE = "order_key BIGINT, cust_key INT, status STRING, price DOUBLE, priority STRING"


def csv_positional_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with bad numbers and with missing last fields."""
    customer = F.when(F.col("o_orderkey") % 10 == 3, "bad").otherwise(F.col("o_custkey").cast("string"))
    front = F.concat_ws(",", F.col("o_orderkey").cast("string"), customer, "o_orderstatus")
    back = F.concat_ws(",", F.col("o_totalprice").cast("string"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))
    line = F.when(F.col("o_orderkey") % 7 == 5, front).otherwise(F.concat_ws(",", front, back))
    lines = table(spark, sf_dir, "orders").select(line.alias("line"))
    return lines.select(parse_positional("line", ORDER_LINE).alias("row")).select("row.*")


def csv_positional_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through cp1250 files, with letters outside ASCII."""
    path = new_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 == 3, "bad").otherwise(F.col("o_custkey").cast("string")),
        nullif("o_orderstatus", "F"),
        "o_totalprice",
        F.concat(F.lit("Łódź, "), "o_orderpriority"),
    ).write.option("encoding", "cp1250").csv(path)
    return read_positional_csv(spark, path, ORDER_LINE)


def filename_timestamp_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 50 == 0, "latest").otherwise(F.date_format("ts", "yyyy-MM-dd-HH-mm-ss"))
    path = F.concat(F.lit("/stage/flights/flights_"), stamp, F.lit(".json"))
    named = table(spark, sf_dir, "events").select("event_id", base_name(path).alias("source_file"))
    return named.withColumn("taken", snapshot_time("source_file").cast("timestamp_ntz"))


def order_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").withColumns(date_parts("o_orderdate"))


def partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by day twice, to show that the second write replaces the first."""
    path = new_path(spark, "events-by-day")
    events = table(spark, sf_dir, "events").withColumns(date_parts("ts"))
    for _ in range(2):
        sinks.overwrite_partitions(events, path, ["year", "month", "day"])
    return read_table(spark, path)


def source_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days for which a partitioned table has files, from their paths alone."""
    path = new_path(spark, "events-listed")
    sinks.overwrite_partitions(table(spark, sf_dir, "events").withColumns(date_parts("ts")), path, ["year", "month", "day"])
    parts = [F.regexp_extract("path", f"{part}=([0-9]+)", 1).cast("int").alias(part) for part in ("year", "month", "day")]
    return list_files(spark, f"{path}/*/*/*/*.parquet").select(*parts).distinct()


def column_family_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_families(table(spark, sf_dir, "orders"), ORDER_FAMILIES)


def any_not_null_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        nullif("event_type", "error").alias("a"),
        F.when(F.col("value") >= 20, F.col("value")).alias("b"),
        F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("c"),
    )
    return events.where(any_not_null(["a", "b", "c"]))


def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_values(table(spark, sf_dir, "events"), "user_id", "event_type")


def union_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(
        table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")),
        table(spark, sf_dir, "supplier").select("s_name", "s_nationkey"),
    )


def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_by_name(
        table(spark, sf_dir, "customer").select(
            F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
        ),
        table(spark, sf_dir, "supplier").select(
            F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")
        ),
    )


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(F.lit(None), F.lit("8"), F.lit("9"), F.lit("x")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", code.alias("status"))


def status_flag_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).select(
        "event_id",
        status_to_boolean("status").alias("measured"),
        status_to_boolean("status", literal=True).alias("measured_literal"),
    )


def status_flag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).select("event_id", status_to_text("status").alias("measured"))


def serving_row_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        nullif("event_type", "error").alias("kind"),
        F.when(F.col("event_id") % 9 != 0, F.date_trunc("second", "ts").cast("timestamp_ntz")).alias("at"),
    )
    return events.select("event_id", row_key("kind", "at").alias("row_key"))


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with many decimals, null, NaN, and a group of very large ones."""
    value = (
        F.when(F.col("event_id") % 50 == 0, 2.0**56)
        .when(F.col("event_id") % 7 == 0, F.lit("NaN").cast("double"))
        .when(F.col("event_id") % 3 != 0, F.col("value") / 1000)
    )
    kind = F.when(F.col("event_id") % 50 == 0, "large").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(kind.alias("event_type"), value.alias("value"))


def _compared(means: DataFrame) -> DataFrame:
    """The last digits of a mean of doubles depend on the order of its sum."""
    return means.withColumn("mean_value", F.round("mean_value", 6)).orderBy("event_type")


def group_mean_missing_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(group_mean(_valued(spark, sf_dir), ["event_type"], "value", "mean_value", missing_as_zero=True))


def group_mean_skip_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(group_mean(_valued(spark, sf_dir), ["event_type"], "value", "mean_value"))


QUERIES = {
    "json_envelope_explode": json_envelope_explode,
    "quarantine_malformed": quarantine_malformed,
    "quarantine_records": quarantine_records,
    "ingest_manifest": ingest_manifest,
    "struct_flatten_null_safe": struct_flatten_null_safe,
    "typed_try_cast": typed_try_cast,
    "cast_all_to_string": cast_to_string,
    "csv_positional_parse": csv_positional_parse,
    "csv_positional_scan": csv_positional_scan,
    "filename_timestamp_extract": filename_timestamp_extract,
    "date_parts": order_date_parts,
    "partitioned_roundtrip": partitioned_roundtrip,
    "source_file_listing": source_file_listing,
    "column_family_projection": column_family_projection,
    "any_not_null_filter": any_not_null_filter,
    "distinct_values": distinct_pairs,
    "union_all_sources": union_all_sources,
    "union_missing_columns": union_missing_columns,
    "status_flag_boolean": status_flag_boolean,
    "status_flag_text": status_flag_text,
    "serving_row_key": serving_row_key,
    "group_mean_missing_as_zero": group_mean_missing_as_zero,
    "group_mean_skip_missing": group_mean_skip_missing,
}

_STATUS_SQL = """
    SELECT event_id, CASE event_id % 4 WHEN 1 THEN '8' WHEN 2 THEN '9' WHEN 3 THEN 'x' END AS status FROM events
"""
_MEAN_SQL = """
    SELECT event_type, round(avg(v) FILTER (NOT isnan(v)), 6) AS mean_value
    FROM (SELECT CASE WHEN event_id % 50 = 0 THEN 'large' ELSE event_type END AS event_type, {value} AS v FROM events)
    GROUP BY 1
"""
_PRESENT = """CASE WHEN event_id % 50 = 0 THEN CAST(72057594037927936 AS DOUBLE) WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE)
    WHEN event_id % 3 <> 0 THEN value / 1000 END"""

ORACLE = {
    "quarantine_records": """
        SELECT event_id, user_id, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS problem
        FROM events, range(2)
        UNION ALL SELECT NULL, NULL, '{"event_id":' || CAST(event_id AS VARCHAR) || ',"person":"n/a"}', 'malformed_record'
        FROM events WHERE event_id % 10 = 0
        UNION ALL SELECT NULL, NULL, 'null', 'null_record' FROM events WHERE event_id % 7 = 0
    """,
    "ingest_manifest": "SELECT * FROM events",
    "json_envelope_explode": """
        SELECT e.* FROM events e, range(2) r(i) WHERE i = 0 OR event_id % 5 = 0
    """,
    "quarantine_malformed": """
        SELECT event_id AS line,
               CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 THEN event_id END AS event_id,
               CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 THEN user_id END AS user_id,
               CASE WHEN event_id % 97 = 0 THEN 'malformed_json'
                    WHEN event_id % 89 = 0 THEN 'missing_data' END AS problem
        FROM events
    """,
    "struct_flatten_null_safe": """
        SELECT event_id,
               CASE WHEN user_id % 7 <> 0 THEN user_id END AS person_id,
               CASE WHEN user_id % 7 <> 0 AND event_id % 5 <> 0 THEN event_type END AS person_kind_name,
               CASE WHEN user_id % 7 <> 0 AND event_id % 5 <> 0 THEN value END AS person_kind_value,
               CASE WHEN user_id % 7 <> 0 AND event_id % 5 <> 0 THEN event_type END AS label,
               CAST(NULL AS VARCHAR) AS never
        FROM events
    """,
    "typed_try_cast": """
        SELECT event_id,
               TRY_CAST(CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS INTEGER) AS user_id,
               TRY_CAST(CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value,
               TRY_CAST(CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS ts,
               CASE event_type WHEN 'view' THEN true WHEN 'error' THEN NULL ELSE false END AS seen
        FROM events
    """,
    "cast_all_to_string": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
               o_orderstatus, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority,
               CAST(o_totalprice AS VARCHAR) AS o_totalprice
        FROM orders
    """,
    "csv_positional_parse": """
        SELECT o_orderkey AS order_key,
               CASE WHEN o_orderkey % 10 <> 3 THEN CAST(o_custkey AS INTEGER) END AS cust_key,
               o_orderstatus AS status,
               CASE WHEN o_orderkey % 7 <> 5 THEN o_totalprice END AS price,
               CASE WHEN o_orderkey % 7 <> 5 THEN o_orderpriority END AS priority
        FROM orders
    """,
    "csv_positional_scan": """
        SELECT o_orderkey AS order_key,
               CASE WHEN o_orderkey % 10 <> 3 THEN CAST(o_custkey AS INTEGER) END AS cust_key,
               nullif(o_orderstatus, 'F') AS status,
               o_totalprice AS price,
               'Łódź, ' || o_orderpriority AS priority
        FROM orders
    """,
    "filename_timestamp_extract": """
        SELECT event_id,
               'flights_' || CASE WHEN event_id % 50 = 0 THEN 'latest'
                                  ELSE strftime(ts, '%Y-%m-%d-%H-%M-%S') END || '.json' AS source_file,
               CASE WHEN event_id % 50 <> 0 THEN date_trunc('second', ts) END AS taken
        FROM events
    """,
    "date_parts": """
        SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day
        FROM orders
    """,
    "partitioned_roundtrip": """
        SELECT *, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
               CAST(day(ts) AS INTEGER) AS day
        FROM events
    """,
    "source_file_listing": """
        SELECT DISTINCT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
               CAST(day(ts) AS INTEGER) AS day
        FROM events
    """,
    "column_family_projection": """
        SELECT o_orderkey, o_orderdate, o_orderpriority, o_custkey, o_totalprice FROM orders
    """,
    "any_not_null_filter": """
        SELECT * FROM (
            SELECT event_id, nullif(event_type, 'error') AS a,
                   CASE WHEN value >= 20 THEN value END AS b,
                   CASE WHEN user_id % 3 = 0 THEN user_id END AS c
            FROM events)
        WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL
    """,
    "distinct_values": "SELECT DISTINCT user_id, event_type FROM events",
    "union_all_sources": """
        SELECT c_name AS name, c_nationkey AS nation FROM customer
        UNION ALL SELECT s_name, s_nationkey FROM supplier
    """,
    "union_missing_columns": """
        SELECT c_custkey AS key, c_nationkey AS nation, c_mktsegment AS segment FROM customer
        UNION ALL BY NAME
        SELECT s_acctbal AS balance, s_suppkey AS key, s_nationkey AS nation FROM supplier
    """,
    "status_flag_boolean": f"""
        SELECT event_id, status IS NULL AS measured, true AS measured_literal FROM ({_STATUS_SQL})
    """,
    "status_flag_text": f"""
        SELECT event_id, CASE WHEN status IS NULL THEN 'Y' WHEN status = '8' THEN 'N' ELSE 'X' END AS measured
        FROM ({_STATUS_SQL})
    """,
    "serving_row_key": """
        SELECT event_id,
               'row' || coalesce(nullif(event_type, 'error'), 'None') || '_' ||
               coalesce(CASE WHEN event_id % 9 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END, 'None') AS row_key
        FROM events
    """,
    "group_mean_missing_as_zero": _MEAN_SQL.format(value=f"coalesce({_PRESENT}, 0)"),
    "group_mean_skip_missing": _MEAN_SQL.format(value=_PRESENT),
}
