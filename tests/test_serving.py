"""Cells: publishing, versions, scans and reports."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from stratiform.functions.casting import bind_by_name, parsed_text
from stratiform.operators import filter_wide, merge_cells, puts, wide_to_cells, wide_view
from stratiform.plans import reports, serving
from stratiform.plans.fixed import SERVING_FAMILIES

T1, T2 = dt.datetime(2023, 12, 1), dt.datetime(2023, 12, 2)
FAMILIES = {"f": ["a", "b"], "w": ["c"]}
WIDE = "row_key string, a string, b string, c string, version_ts timestamp"


def cells(spark, *rows):
    return wide_to_cells(spark.createDataFrame(list(rows), WIDE), FAMILIES)


def view(df):
    return {row.row_key: tuple(row)[1:] for row in df.collect()}


def gold_row(spark, tmp_path, *rows):
    """Gold rows of (flight_icao, departure_scheduled, arrival_delay, departure_rain, departure_iata, timestamp)."""
    df = spark.createDataFrame(
        list(rows),
        "flight_icao string, departure_scheduled timestamp, arrival_delay int, departure_rain double,"
        "departure_iata string, timestamp timestamp",
    )
    names = [c for members in SERVING_FAMILIES.values() for c in members if c not in df.columns]
    full = df.withColumns({c: F.lit(None).cast("string") for c in names})
    path = str(tmp_path / "gold")
    full.write.mode("overwrite").parquet(path)
    return path


def test_families():
    assert {family: len(columns) for family, columns in SERVING_FAMILIES.items()} == {"flight": 43, "weather": 43}
    assert len({c for columns in SERVING_FAMILIES.values() for c in columns}) == 86


def test_nulls_are_no_cells_and_never_erase(spark):
    table = cells(spark, ("r1", "old", "x", None, T1), ("r1", "new", None, None, T2), ("r2", None, None, None, T1))
    assert table.count() == 3
    assert view(wide_view(table, FAMILIES)) == {"r1": ("new", "x", None)}


def test_cells_return_the_wide_rows(spark):
    rows = [("r1", "1", None, "3", T1), ("r2", None, "2", None, T1)]
    assert view(wide_view(cells(spark, *rows), FAMILIES)) == {r[0]: r[1:4] for r in rows}


def test_view_keeps_rows_that_lack_the_listed_cells(spark):
    table = cells(spark, ("r1", "1", None, None, T1), ("r2", None, None, "3", T1))
    assert view(wide_view(table, {"w": ["c"]})) == {"r1": (None,), "r2": ("3",)}


def test_two_copies_of_a_row_merge(spark):
    table = cells(spark, ("r1", "1", None, "arrival", T1), ("r1", "1", "departure", None, T1))
    assert view(wide_view(table, FAMILIES)) == {"r1": ("1", "departure", "arrival")}
    assert merge_cells(table).count() == 3


def test_retention_keeps_ten_of_eleven_versions(spark, tmp_path):
    path, compacted = str(tmp_path / "cells"), str(tmp_path / "compacted")
    versions = [("r1", str(k), None, None, T1 + dt.timedelta(days=k)) for k in range(11)]
    serving.write_cells(cells(spark, *versions), path, "one")
    kept = serving.read_cells(spark, path)
    assert sorted(int(row.value) for row in kept.collect()) == list(range(1, 11))
    serving.compact(spark, path, compacted)
    assert spark.read.parquet(compacted).count() == 10
    assert view(serving.scan(spark, compacted, FAMILIES)) == {"r1": ("10", None, None)}


def test_writing_a_run_again_changes_nothing_and_fresh_drops_the_rest(spark, tmp_path):
    path = str(tmp_path / "cells")
    serving.write_cells(cells(spark, ("r1", "1", None, None, T1)), path, "one")
    for _ in range(2):
        serving.write_cells(cells(spark, ("r1", None, "2", None, T2)), path, "two")
        assert view(serving.scan(spark, path, FAMILIES)) == {"r1": ("1", "2", None)}
        assert spark.read.parquet(path).count() == 2
    serving.write_cells(cells(spark, ("r3", "3", None, None, T2)), path, "three", fresh=True)
    assert view(serving.scan(spark, path, FAMILIES)) == {"r3": ("3", None, None)}


def test_scan_limit_takes_the_first_keys(spark, tmp_path):
    path = str(tmp_path / "cells")
    assert serving.scan(spark, path, FAMILIES).count() == 0
    serving.write_cells(cells(spark, *((f"r{k}", "1", None, None, T1) for k in range(5))), path, "one")
    assert [row.row_key for row in serving.scan(spark, path, FAMILIES, limit=2).collect()] == ["r0", "r1"]


def test_filter_modes(spark):
    wide = spark.createDataFrame([("r1", "x"), ("r2", "y"), ("r3", None)], "row_key string, a string")
    keys = lambda df: [row.row_key for row in df.orderBy("row_key").collect()]
    assert keys(filter_wide(wide, "a", "x")) == ["r1", "r3"]
    assert keys(filter_wide(wide, "a", "x", keep_missing=False)) == ["r1"]
    assert keys(filter_wide(wide, "a")) == ["r1", "r2", "r3"]


@pytest.fixture
def published(spark, tmp_path):
    gold = gold_row(
        spark, tmp_path,
        ("A", T1, 10, 0.5, "WAW", T1), ("B", T1, 20, None, "WAW", T1), ("C", T1, None, 1.0, "KRK", T1),
        (None, None, 7, 2.0, None, T1),
    )
    path = str(tmp_path / "cells")
    assert serving.run(spark, gold, path) == 1
    return path


def test_run_spells_keys(spark, published):
    keys = {row.row_key for row in serving.scan(spark, published).collect()}
    assert keys == {f"row{icao}_2023-12-01 00:00:00" for icao in "ABC"} | {"rowNone_None"}


def test_run_can_be_repeated(spark, published, tmp_path):
    before = sorted(map(str, spark.read.parquet(published).collect()))
    run_id = spark.read.parquet(published).first().run_id
    serving.run(spark, str(tmp_path / "gold"), published, run_id)
    assert sorted(map(str, spark.read.parquet(published).collect())) == before


def test_rain_against_delay(spark, published):
    wide = serving.scan(spark, published)
    points = lambda **options: sorted(tuple(row) for row in reports.rain_against_delay(wide, "WAW", **options).collect())
    assert points() == [(7, 2.0), (10, 0.5), (20, 0.0)]
    assert points(keep_missing=False) == [(10, 0.5), (20, 0.0)]


def test_mean_delay(spark, published):
    wide = serving.scan(spark, published)
    assert [tuple(row) for row in reports.mean_delay(wide).collect()] == [("0", 7.0), ("KRK", 0.0), ("WAW", 15.0)]
    skipping = reports.mean_delay(wide, missing_as_zero=False).collect()
    assert [tuple(row) for row in skipping] == [("0", 7.0), ("KRK", None), ("WAW", 15.0)]


def test_a_report_exchanges_the_cells_it_lists(spark, published):
    listed = reports.families("departure_iata", "departure_rain", "arrival_delay")
    chosen = serving.scan(spark, published, listed, where=("departure_iata", "WAW"))
    plan = chosen._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joined = next(k for k, line in enumerate(plan) if "Join LeftAnti" in line)
    assert re.search(r"Project \[row_key#\d+, version_ts#\d+, CASE", plan[joined + 1])
    assert view(chosen) == {
        f"row{k}_2023-12-01 00:00:00": v for k, v in {"A": ("10", "WAW", "0.5"), "B": ("20", "WAW", None)}.items()
    } | {"rowNone_None": ("7", None, "2.0")}


def test_puts_have_no_nulls_and_their_names_in_order(spark):
    wide = spark.createDataFrame([("r1", "1", None, "", T1), ("r2", None, None, None, T1), ("r3", None, "b", None, T1)], WIDE)
    made = sorted((r.row_key, r.family, list(r.cells.items())) for r in puts.wide_to_puts(wide, {**FAMILIES, "none": []}).collect())
    assert made == [("r1", "f", [("a", "1")]), ("r1", "w", [("c", "")]), ("r3", "f", [("b", "b")])]


def test_cells_are_text(spark, published):
    assert dict(serving.read_cells(spark, published).dtypes)["value"] == "string"
    assert dict(spark.read.parquet(published).dtypes)["cells"] == "map<string,string>"
    assert bind_by_name(spark.createDataFrame([(1,)], "x int"), "x string, y int").first() == ("1", None)


def test_text_to_numbers(spark):
    texts = ["1", " 2 ", "+3", "-4", "5.0", "1e3", "NaN", "Infinity", "-inf", "n/a", "", "x1", "99999999999", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for data_type in ("int", "bigint", "double"):
        rows = df.select(parsed_text(F.col("t"), data_type).alias("ours"), F.col("t").try_cast(data_type).alias("cast"))
        assert [str(row.ours) for row in rows.collect()] == [str(row.cast) for row in rows.collect()]
