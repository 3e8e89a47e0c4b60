"""Serving cells and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions import cell_or_default, row_key
from stratiform.operators import merge_cells, merge_wide, newest_versions, wide_first, wide_to_cells, wide_view, wide_where
from stratiform.plans import reports, serving
from stratiform.registry.inputs import (
    EVENT_FAMILIES,
    EVENTS_WIDE_SQL,
    WIDE_VIEW_SQL,
    events_wide,
    nullif,
    table,
)
from stratiform.session import new_path
from stratiform.sinks import new_batch

ORDER_FAMILIES = {"order": ["status", "priority", "placed"], "party": ["customer", "price"]}


def _orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        row_key("o_orderkey").alias("row_key"),
        nullif("o_orderstatus", "P").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderdate").alias("placed"),
        F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("customer"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.col("o_orderdate").alias("version_ts"),
    )


def _event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_to_cells(events_wide(spark, sf_dir), EVENT_FAMILIES)


def _event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_view(_event_cells(spark, sf_dir), EVENT_FAMILIES)


def serving_wide_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_to_cells(_orders_wide(spark, sf_dir), ORDER_FAMILIES)


def serving_merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key merged cell by cell; nulls never replace values."""
    events = table(spark, sf_dir, "events").select(
        row_key("user_id").alias("row_key"),
        "event_id",
        nullif("event_type", "error").alias("kind"),
        F.when(F.col("value") < 30, F.col("value")).alias("amount"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("props"),
    )
    return merge_wide(events, "row_key", ["kind", "amount", "props"], newest=["event_id"])


def serving_merge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_cells(_event_cells(spark, sf_dir))


def serving_version_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cells = events.select(
        row_key("user_id").alias("row_key"),
        F.lit("event").alias("family"),
        F.col("event_type").alias("qualifier"),
        F.col("props").alias("value"),
        F.col("ts").alias("version_ts"),
    )
    return newest_versions(cells)


def serving_publish_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells published in three runs, compacted in place, and one more run: every version up to the retained ones."""
    path = new_path(spark, "cells")
    cells = _event_cells(spark, sf_dir).withColumn("version_ts", F.col("version_ts").cast("timestamp"))
    part = F.pmod(F.xxhash64("row_key", "qualifier", "version_ts"), F.lit(4))
    for run in range(3):
        serving.write_cells(cells.where(part == run), path, new_batch())
    serving.compact(spark, path)
    serving.write_cells(cells.where(part == 3), path, new_batch())
    return serving.read_cells(spark, path).withColumn("version_ts", F.col("version_ts").cast("timestamp_ntz"))


def serving_scan_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_view(spark, sf_dir)


def serving_scan_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in key order, as a preview."""
    return wide_first(_event_cells(spark, sf_dir), EVENT_FAMILIES, 10)


def serving_filter_eq_or_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_where(_event_cells(spark, sf_dir), EVENT_FAMILIES, ("event", "source"), "web3")


def serving_filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_where(_event_cells(spark, sf_dir), EVENT_FAMILIES, ("event", "source"), "web3", keep_missing=False)


def missing_cell_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_view(spark, sf_dir).select(
        "row_key", cell_or_default("amount", "double").alias("amount"), cell_or_default("k", "int").alias("k")
    )


def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scatter(_event_view(spark, sf_dir), "kind", "purchase", x="amount", y="k")


def serving_mean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = reports.mean_delay(_event_view(spark, sf_dir), key="kind", value="amount")
    return means.withColumn("amount", F.round("amount", 6))  # the order of the sum decides later digits


QUERIES = {
    "serving_wide_to_cells": serving_wide_to_cells,
    "serving_merge_upsert": serving_merge_upsert,
    "serving_merge_cells": serving_merge_cells,
    "serving_version_retention": serving_version_retention,
    "serving_publish_versions": serving_publish_versions,
    "serving_scan_wide": serving_scan_wide,
    "serving_scan_first": serving_scan_first,
    "serving_filter_eq_or_missing": serving_filter_eq_or_missing,
    "serving_filter_eq": serving_filter_eq,
    "missing_cell_default": missing_cell_default,
    "scatter_points": scatter_points,
    "serving_mean_report": serving_mean_report,
}

_CELLS_SQL = " UNION ALL ".join(
    f"SELECT row_key, '{family}' AS family, '{c}' AS qualifier, {c} AS value, version_ts FROM ({EVENTS_WIDE_SQL}) "
    f"WHERE {c} IS NOT NULL"
    for family, columns in EVENT_FAMILIES.items()
    for c in columns
)

ORACLE = {
    "serving_wide_to_cells": """
        WITH wide AS (
            SELECT 'row' || CAST(o_orderkey AS VARCHAR) AS row_key, nullif(o_orderstatus, 'P') AS status,
                   o_orderpriority AS priority, CAST(o_orderdate AS VARCHAR) AS placed,
                   CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer,
                   CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) AS price,
                   o_orderdate AS version_ts
            FROM orders
        ),
        cells AS (
            SELECT row_key, 'order' AS family, 'status' AS qualifier, status AS value, version_ts FROM wide
            UNION ALL SELECT row_key, 'order', 'priority', priority, version_ts FROM wide
            UNION ALL SELECT row_key, 'order', 'placed', placed, version_ts FROM wide
            UNION ALL SELECT row_key, 'party', 'customer', customer, version_ts FROM wide
            UNION ALL SELECT row_key, 'party', 'price', price, version_ts FROM wide
        )
        SELECT * FROM cells WHERE value IS NOT NULL
    """,
    "serving_merge_upsert": """
        SELECT 'row' || CAST(user_id AS VARCHAR) AS row_key,
               arg_max(event_type, event_id) FILTER (event_type <> 'error') AS kind,
               arg_max(value, event_id) FILTER (value < 30) AS amount,
               arg_max(props, event_id) FILTER (event_id % 2 = 0) AS props
        FROM events GROUP BY user_id
    """,
    "serving_merge_cells": f"""
        SELECT * FROM ({_CELLS_SQL})
        QUALIFY row_number() OVER (
            PARTITION BY row_key, family, qualifier ORDER BY version_ts DESC, value DESC) = 1
    """,
    "serving_version_retention": """
        SELECT 'row' || CAST(user_id AS VARCHAR) AS row_key, 'event' AS family, event_type AS qualifier,
               props AS value, ts AS version_ts
        FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, props DESC) <= 10
    """,
    "serving_publish_versions": f"""
        SELECT * FROM (
            SELECT row_key, family, qualifier, max(value) AS value, version_ts FROM ({_CELLS_SQL})
            GROUP BY row_key, family, qualifier, version_ts
        )
        QUALIFY row_number() OVER (PARTITION BY row_key, family, qualifier ORDER BY version_ts DESC) <= 10
    """,
    "serving_scan_wide": f"{WIDE_VIEW_SQL} SELECT * FROM wide",
    "serving_scan_first": f"{WIDE_VIEW_SQL} SELECT * FROM wide ORDER BY row_key LIMIT 10",
    "serving_filter_eq_or_missing": f"{WIDE_VIEW_SQL} SELECT * FROM wide WHERE source = 'web3' OR source IS NULL",
    "serving_filter_eq": f"{WIDE_VIEW_SQL} SELECT * FROM wide WHERE source = 'web3'",
    "missing_cell_default": f"""
        {WIDE_VIEW_SQL}
        SELECT row_key, coalesce(TRY_CAST(amount AS DOUBLE), 0) AS amount, coalesce(TRY_CAST(k AS INTEGER), 0) AS k
        FROM wide
    """,
    "scatter_points": f"""
        {WIDE_VIEW_SQL}
        SELECT coalesce(TRY_CAST(k AS INTEGER), 0) AS k, coalesce(TRY_CAST(amount AS DOUBLE), 0) AS amount
        FROM wide WHERE kind = 'purchase' OR kind IS NULL
    """,
    "serving_mean_report": f"""
        {WIDE_VIEW_SQL}
        SELECT coalesce(kind, '0') AS kind,
               round(avg(coalesce(TRY_CAST(amount AS DOUBLE), 0)), 6) AS amount
        FROM wide GROUP BY 1
    """,
}
