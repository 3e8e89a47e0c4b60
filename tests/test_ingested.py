"""Fields beyond the schema, and counts of different values from sketches."""

import json

import pytest
from pyspark.sql import functions as F

from stratiform.plans.distinct import DistinctCounts
from stratiform.plans.fixed import BRONZE_FLIGHT
from stratiform.sources import drift
from stratiform.sources.envelope import parse_envelopes, read_envelopes, records

SCHEMA = "id STRING, inner STRUCT<a: STRING, deep: STRUCT<x: STRING>>"


def unknown(spark, *texts, schema=SCHEMA):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, value string")
    kept = rows.withColumn(drift.UNKNOWN, drift.unknown_fields(F.col("value"), schema))
    as_text = F.transform(drift.UNKNOWN, lambda e: F.struct(e["field"], F.to_json(e["value"])))
    found = kept.orderBy("k").select(as_text.alias("found")).collect()
    return [None if r["found"] is None else [tuple(e) for e in r["found"]] for r in found], kept


def test_what_the_schema_does_not_name(spark):
    texts = [
        '{"id": 1, "inner": {"a": 2, "deep": {"x": 3}}}',
        '{"id": 1, "new": {"a": [1, null]}, "inner": {"b": true, "deep": {"y": "ł", "x": 1}}, "empty": null}',
        '{"inner": null, "z": 1.50}', '{"inner": 7, "z": ""}', "[1]", "null", "broken {", "", None, '{"z": 1, "z": 2}', "{}",
        json.dumps({"": 1, "it's a \"name\"": 2, "inner.a": 3}),
    ]
    found, _ = unknown(spark, *texts)
    assert found[0] == [] and found[10] == []
    assert sorted(found[1]) == [("empty", "null"), ("inner.b", "true"), ("inner.deep.y", '"ł"'), ("new", '{"a":[1,null]}')]
    assert found[2] == [("z", "1.5")] and found[3] == [("z", '""')]
    assert found[4:10] == [None] * 6
    assert sorted(found[11]) == [("", "1"), ("inner.a", "3"), ("it's a \"name\"", "2")]


def test_quoted_names_are_looked_into(spark):
    found, _ = unknown(spark, json.dumps({"it's.x": {"a": 1, "b": 2}}), schema="`it's.x` STRUCT<a: STRING>")
    assert found == [[("it's.x.b", "2")]]


def test_a_field_is_found_again_after_the_table_is_written(spark, tmp_path, write, envelope, flight):
    folder = write("flights_2023-12-01-00-00-00.json", envelope(flight("F1", gate={"no": 5, "tags": ["x"]}), flight("F2")) + "{broken\n")
    parsed = drift.with_unknown(parse_envelopes(read_envelopes(spark, folder), BRONZE_FLIGHT), BRONZE_FLIGHT)
    records(parsed).select("flight.icao", drift.UNKNOWN).write.parquet(str(tmp_path / "silver"))
    silver = spark.read.parquet(str(tmp_path / "silver"))
    found = silver.orderBy("icao").select(drift.field("gate", "int", "$.no"), drift.field("gate", "date", "$.no"), drift.field("gone", "int"))
    assert [tuple(r) for r in found.collect()] == [(5, None, None), (None, None, None)]
    assert parsed.where("_problem IS NOT NULL").select(F.col(drift.UNKNOWN).isNull()).first()[0]


def test_drift_report(spark):
    _, kept = unknown(spark, '{"a": 1, "b": 1.25}', '{"a": null, "b": {"c": 1}}', '{"a": 3, "d": 2.5}', '{"a": 4, "d": 10.125}', "{}", None)
    rows = {r["field"]: (r["n"], r["nulls"], r["type"]) for r in drift.drift(kept).collect()}
    assert rows == {"a": (4, 1, "BIGINT"), "b": (2, 0, "VARIANT"), "d": (2, 0, "DECIMAL")}
    _, nothing = unknown(spark, "{}")
    assert drift.drift(nothing).count() == 0


@pytest.fixture
def seen(spark):
    """20000 rows, a third of them of one user; an empty name and nulls."""
    user = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 != 1, F.col("id") % 7001)
    name = F.when(F.col("id") % 11 == 0, "").when(F.col("id") % 5 != 0, F.col("id").cast("string"))
    day, kind = (F.col("id") % 4).cast("int").alias("day"), F.when(F.col("id") % 6 != 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("kind")
    return spark.range(20000).select("id", day, kind, user.alias("user"), name.alias("name"))


def close(spark, counts, rows, *by):
    got = counts.counts(*by)
    exact = rows.groupBy(*by).agg(F.countDistinct("user").alias("user"), F.countDistinct("name").alias("name"))
    got, exact = ({tuple(r)[: len(by)]: tuple(r)[len(by) :] for r in df.collect()} for df in (got, exact))
    assert got.keys() == exact.keys()
    for key, values in exact.items():
        for n, estimate in zip(values, got[key], strict=True):
            assert abs(estimate - n) <= 4 * counts.error * n


def test_counts_of_batches_add_up(spark, tmp_path, seen):
    counts = DistinctCounts(spark, str(tmp_path / "sketches"), ["day", "kind"], ["user", "name"])
    assert counts.counts("day") is None and counts.by_level([]) is None
    for batch in (0, 1, 1, 2):
        counts.add(seen.where(F.col("id") % 3 == batch), str(batch))
    counts.add(seen.where("false"), "empty")
    for by in ((), ("day",), ("kind",), ("day", "kind")):
        close(spark, counts, seen, *by)
    levels = counts.by_level(["day", "kind"], ["day"], []).collect()
    assert sorted({r["level"] for r in levels}) == ["", "day", "day,kind"]
    assert len([r for r in levels if r["level"] == "day,kind"]) == counts.counts("day", "kind").count()
    counts.compact("all")
    counts.compact("all")
    assert counts.snapshots.folders() == ["ingest_batch=all"]
    for by in ((), ("day",), ("day", "kind")):
        close(spark, counts, seen, *by)


def test_small_counts_are_exact_and_precision_is_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, ""), (1, None), (1, "a"), (1, "a"), (2, None)], "day int, name string")
    counts = DistinctCounts(spark, str(tmp_path / "sketches"), ["day"], ["name"], precision=10)
    counts.add(rows, "b")
    assert sorted(tuple(r) for r in counts.counts("day").collect()) == [(1, 2), (2, 0)]
    with pytest.raises(ValueError):
        DistinctCounts(spark, "x", [], [], precision=22)


def test_no_row_is_read_again(spark, tmp_path, seen):
    counts = DistinctCounts(spark, str(tmp_path / "sketches"), ["day", "kind"], ["user"])
    counts.add(seen, "b")
    assert counts.snapshots.read().count() == seen.select("day", "kind").distinct().count()
