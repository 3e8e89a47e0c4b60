"""Shape of the physical plans, and behaviour on hot keys."""

import glob
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratiform import registry, sinks
from stratiform.functions import date_parts
from stratiform.operators import (
    any_not_null,
    group_mean,
    latest_per_key,
    left_enrich,
    lookup_left_join,
    newest_per_key,
    newest_versions,
)
from stratiform.registry.inputs import EVENT_RECORD, event_json, table
from stratiform.session import broadcast_within, measured_bytes
from stratiform.sources import list_files, parse_envelopes, quarantined, read_envelopes, read_table, records

SF_DIR = "/root/testdata/sf0.001"


def plan(df, executed=True):
    execution = df._jdf.queryExecution()
    return execution.executedPlan().toString() if executed else execution.optimizedPlan().toString()


def below_exchange(text, operator):
    """Is the operator also under the (only) shuffle, on the map side?"""
    return operator in text[text.index("Exchange hashpartitioning") :]


def test_no_python_in_any_plan(spark):
    for name, query in registry.QUERIES.items():
        if not name.startswith("stream_"):
            text = plan(query(spark, SF_DIR))
            assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", text), name
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_lookup_is_broadcast(spark):
    text = plan(lookup_left_join(table(spark, SF_DIR, "customer").selectExpr("c_name AS n"), [("x", "y")], "n string, m string", "n"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_dedup_and_retention_cut_keys_before_the_shuffle(spark):
    events = table(spark, SF_DIR, "events")
    assert below_exchange(plan(latest_per_key(events, ["user_id"], ["ts"])), "partial_max")
    assert below_exchange(plan(newest_per_key(events, ["user_id"], ["ts"], 3)), "WindowGroupLimit")
    cells = events.selectExpr("event_type row_key", "'f' family", "'q' qualifier", "props value", "ts version_ts")
    assert below_exchange(plan(newest_versions(cells)), "WindowGroupLimit")
    assert below_exchange(plan(group_mean(events, ["event_type"], "value", "m")), "partial_avg")


def test_gold_reads_each_fact_once(spark):
    text = plan(entry.queries()["gold_enriched"](spark, SF_DIR))
    for name in ("lineitem", "orders"):
        assert text.count(f"{name}.parquet") == 1, name
    assert "l_extendedprice" not in text.split("ReadSchema")[0]
    assert text.count("Exchange hashpartitioning") <= 2


def test_filter_and_columns_reach_the_scan(spark):
    events = table(spark, SF_DIR, "events")
    text = plan(events.where(any_not_null(["value", "props"])).select("value"))
    assert "Or(IsNotNull(value),IsNotNull(props))" in text
    assert "ReadSchema: struct<value:double,props:string>" in text


@pytest.mark.parametrize("use", [records, quarantined])
def test_documents_are_parsed_once(spark, use, tmp_path):
    path = str(tmp_path / "lines")
    table(spark, SF_DIR, "events").select(event_json().alias("value")).write.text(path)
    df = use(parse_envelopes(read_envelopes(spark, path), EVENT_RECORD))
    assert plan(df).count("from_json") == 2  # the envelope, and each of its records on its own


def test_partition_pruning_and_few_files(spark, tmp_path):
    path = str(tmp_path / "events")
    events = table(spark, SF_DIR, "events").repartition(8).withColumns(date_parts("ts"))
    sinks.overwrite_partitions(events, path, ["year", "month", "day"])
    assert len(glob.glob(f"{path}/*/*/*/*.parquet")) <= 2 * events.select("day").distinct().count()
    day = read_table(spark, path).where("year = 2024 and month = 1 and day = 3")
    assert "day#" in plan(day).split("PartitionFilters: [")[1].split("]")[0]
    assert day.count() == events.where("day = 3").count()


def test_dynamic_overwrite_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "day int, v string"), path, ["day"])
    sinks.overwrite_partitions(spark.createDataFrame([(2, "c")], "day int, v string"), path, ["day"])
    assert sorted((r.day, r.v) for r in read_table(spark, path).collect()) == [(1, "a"), (2, "c")]
    sinks.append(spark.createDataFrame([(2, "c")], "day int, v string"), path, ["day"])
    assert read_table(spark, path).count() == 3


def test_no_table_yet(spark, tmp_path):
    assert read_table(spark, str(tmp_path / "none")) is None
    assert list_files(spark, str(tmp_path / "none*")).count() == 0
    assert read_envelopes(spark, str(tmp_path / "none*")).count() == 0


def test_list_files_reads_no_content(spark, write):
    write("a_1.json", "x\n")
    folder = write("a_2.json", "y\n")
    files = list_files(spark, f"{folder}/a_*")
    assert sorted(row.file_name for row in files.collect()) == ["a_1.json", "a_2.json"]
    assert "content" not in plan(files).split("ReadSchema")[1]


def test_broadcast_only_within_the_measured_size(spark):
    df = spark.range(1000).withColumn("s", F.lit("x" * 84))
    assert measured_bytes(df) == 1000 * (16 + 84 + 16)
    other = spark.range(10)
    hinted = plan(other.join(broadcast_within(df, 200_000), "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(other.join(broadcast_within(df, 200_000), "id"))
        assert "SortMergeJoin" in plan(other.join(broadcast_within(df, 100_000), "id"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in hinted


def test_hot_join_key_is_split(spark):
    """Above the broadcast limit a hot key of the left side is spread over tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        hot = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)
        left = spark.range(0, 60_000, 1, 8).select(hot.alias("k"), F.col("id").alias("v"))
        right = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        joined = left_enrich(left, right, ["k"], broadcast_limit=0)
        assert joined.where("w = 2 * k").count() == 60_000
        kept = left_enrich(left, right, ["k"], only_where=F.col("v") % 2 == 0, broadcast_limit=0)
        assert (kept.count(), kept.where("w is null").count()) == (60_000, 30_000)
        joined.collect()
        assert "skew=true" in plan(joined)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_dedup_key_after_a_join(spark):
    """A third of all rows under one key: one row per key and task is shuffled."""
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    rows = spark.range(0, 90_000, 1, 8).select(hot.alias("k"), F.col("id").alias("snapshot"))
    newest = latest_per_key(rows, ["k"], ["snapshot"])
    assert newest.count() == 60_001 and newest.where("k = 0").first().snapshot == 89_997


@pytest.mark.parametrize("name", ["prior_year_left_join", "membership_flag_split", "gold_enriched"])
def test_facts_are_scanned_at_most_once(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for fact in ("orders", "lineitem"):
        assert text.count(f"{fact}.parquet") <= 1, fact
