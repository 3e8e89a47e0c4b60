"""Files are ingested once each, whatever happens between runs; cells and corrections are never lost."""

import os
import time

import pytest

from stratiform import sinks
from stratiform.operators import wide_to_cells
from stratiform.plans import dimensions, serving, weather
from stratiform.plans.fixed import WEATHER_TERM
from stratiform.registry.inputs import EVENT_FAMILIES
from stratiform.streaming import upsert_cells

TERM = '{code},"{name}",{year},{month},{day},{value},,81.0,8,2.1,,6.0,\n'
DAY = '{code},"{name}",{year},{month},{day},5.0,,1.0,9,3.5,,-1.0,,0.0,9,W,0.0,8\n'


def ids(spark, path):
    return sorted(row.id for row in spark.read.parquet(path).collect())


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "silver"), str(tmp_path / "quarantine")


def test_a_refreshed_file_is_another_delivery(spark, write, envelope, paths):
    folder = write("airlines.json", envelope({"id": 1}))
    dimensions.run(spark, "airlines", folder, *paths)
    write("airlines.json", envelope({"id": 2}, {"id": 3}))
    for _ in range(2):
        dimensions.run(spark, "airlines", folder, *paths)
        assert ids(spark, paths[0]) == ["1", "2", "3"]


def test_files_of_one_name_in_two_folders(spark, write, envelope, paths):
    one = write("airlines.json", envelope({"id": 1}), "one")
    two = write("airlines.json", envelope({"id": 2}), "two")
    for folder in (one, two, one):
        dimensions.run(spark, "airlines", folder, *paths)
    assert ids(spark, paths[0]) == ["1", "2"]


def test_a_run_that_failed_half_way_is_completed(spark, write, envelope, paths, monkeypatch):
    folder = write("airlines.json", envelope({"id": 1}) + "{broken\n")
    finish = sinks.Manifest.finish

    def fail(self, batch):
        raise OSError("lost")

    monkeypatch.setattr(sinks.Manifest, "finish", fail)
    with pytest.raises(OSError):
        dimensions.run(spark, "airlines", folder, *paths)
    monkeypatch.setattr(sinks.Manifest, "finish", finish)
    write("airlines_2.json", envelope({"id": 2}))
    for _ in range(2):
        dimensions.run(spark, "airlines", folder, *paths)
        assert ids(spark, paths[0]) == ["1", "2"]
        assert spark.read.parquet(paths[1]).count() == 1


def test_files_are_archived_after_their_batch(spark, write, envelope, paths, tmp_path):
    archive = str(tmp_path / "archive")
    for k in range(2):
        folder = write("airlines.json", envelope({"id": k}))
        dimensions.run(spark, "airlines", folder, *paths, archive=archive)
        assert not os.path.exists(f"{folder}/airlines.json")
    assert sorted(name for name in os.listdir(archive) if not name.startswith(".")) == ["airlines.json", "airlines.json.1"]
    assert ids(spark, paths[0]) == ["0", "1"]


def test_good_records_stay_next_to_bad_ones(spark, write, paths):
    folder = write("airlines.json", '{"data":[{"id":"1"},null,"text",{"id":"2"},[3]]}\n')
    dimensions.run(spark, "airlines", folder, *paths)
    assert ids(spark, paths[0]) == ["1", "2"]
    bad = spark.read.parquet(paths[1]).collect()
    assert sorted(row.problem for row in bad) == ["malformed_record", "malformed_record", "null_record"]


def station(value="3.5", month=12, day=1):
    return {"code": 100000001, "name": "GOLENIÓW", "year": 2022, "month": month, "day": day, "value": value}


def test_weather_keeps_what_arrived_last_and_reports_the_rest(spark, write, tmp_path):
    path, bad = str(tmp_path / "silver"), str(tmp_path / "bad")
    folder = write("k_d_t_1.csv", TERM.format(**station("9.0")) + TERM.format(**station(month="x")), encoding="cp1250")
    write("k_d_1.csv", DAY.format(**station()), encoding="cp1250")
    weather.run(spark, folder, path, quarantine=bad)
    time.sleep(0.01)
    write("k_d_t_2.csv", TERM.format(**station("3.0")), encoding="cp1250")  # corrected, lower
    for _ in range(2):
        weather.run(spark, folder, path, quarantine=bad)
        rows = weather.newest(spark.read.parquet(path)).collect()
        assert [row.temperature_avg for row in rows] == [3.0]
        rejected = spark.read.parquet(bad).collect()
        assert [(row.source_file, row.problem, row.dataset) for row in rejected] == [
            ("k_d_t_1.csv", "unreadable_station_day", "weather")
        ]
        assert ",x," in rejected[0].value


def test_weather_families_may_arrive_in_different_runs(spark, write, tmp_path):
    path = str(tmp_path / "silver")
    folder = write("k_d_t_1.csv", TERM.format(**station()), encoding="cp1250")
    weather.run(spark, folder, path)
    write("k_d_1.csv", DAY.format(**station()), encoding="cp1250")
    weather.run(spark, folder, path, archive=str(tmp_path / "archive"))
    assert weather.newest(spark.read.parquet(path)).count() == 1
    assert sorted(os.listdir(folder)) == ["k_d_t_1.csv"] or ".k_d_1.csv.crc" in os.listdir(folder)


def test_both_ways_to_read_a_line_agree(spark, write):
    folder = write("k_d_t_1.csv", TERM.format(**station()), encoding="cp1250")
    assert weather.bad_lines(weather.read_family(spark, [f"{folder}/k_d_t_1.csv"], WEATHER_TERM), WEATHER_TERM).count() == 0


def test_streams_with_other_checkpoints_add_versions(spark, tmp_path):
    path = str(tmp_path / "cells")
    schema = "row_key string, kind string, source string, amount string, k string, version_ts timestamp"
    for day in (1, 2):
        source = str(tmp_path / f"source-{day}")
        rows = spark.sql(f"SELECT 'r1' row_key, 'v{day}' kind, '' source, '' amount, '' k, timestamp '2024-01-0{day}' version_ts")
        rows.write.parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        upsert_cells(stream, EVENT_FAMILIES, path, f"{path}-state-{day}").awaitTermination()
    versions = serving.read_cells(spark, path).where("qualifier = 'kind'").collect()
    assert sorted(row.value for row in versions) == ["v1", "v2"]


def test_publications_are_runs_of_their_own_and_survive_compaction(spark, tmp_path):
    path = str(tmp_path / "cells")
    frame = "SELECT 'r{k}' row_key, 'v{k}' kind, '' source, '' amount, '' k, timestamp '2024-01-0{k}' version_ts"
    for k in (1, 2, 3):
        serving.write_cells(wide_to_cells(spark.sql(frame.format(k=k)), EVENT_FAMILIES), path, sinks.new_batch())
    for _ in range(2):
        serving.compact(spark, path)
        assert sorted(row.row_key for row in serving.scan(spark, path, EVENT_FAMILIES).collect()) == ["r1", "r2", "r3"]
        assert spark.read.parquet(path).select("run_id").distinct().count() == 1


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_serving_reads_gather_once_and_only_what_is_asked_for(spark, tmp_path):
    path = str(tmp_path / "cells")
    frame = "SELECT concat('r', id) row_key, concat('v', id % 3) kind, 's' source, '' amount, '' k, timestamp '2024-01-01' version_ts"
    serving.write_cells(wide_to_cells(spark.sql(f"{frame} FROM range(100)"), EVENT_FAMILIES), path, "one")
    assert exchanges(serving.scan(spark, path, EVENT_FAMILIES)) == 1
    assert exchanges(serving.scan(spark, path)) == 1  # all 86 columns
    first = serving.scan(spark, path, EVENT_FAMILIES, limit=3)
    text = first._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "LeftSemi" in text  # keys are cut before the cells are gathered
    assert first.count() == 3
