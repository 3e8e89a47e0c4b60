"""Tiered cells: scans and merges without an exchange, equal to the plain log."""

import datetime as dt
import os

import pytest

from stratiform.operators import puts
from stratiform.operators.cells import wide_to_cells
from stratiform.plans import serving
from stratiform.plans import tiers as tiers_module
from stratiform.plans.tiers import Tiers
from stratiform.registry import history

FAMILIES = {"f": ["a", "b"], "w": ["c"]}
WIDE = "row_key string, a string, b string, c string, version_ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def wide(spark, run, rows=40):
    """Rows of one publication: keys that other ones have as well, and a key that a third of the rows has."""
    made = []
    for k in range(rows):
        key = "hot" if k % 3 == 0 else f"r{(k * 7 + run) % 25}"
        made.append((key, f"a{run}-{k}", None if k % 4 else f"b{run}-{k}", f"c{run}" if k % 5 else None, T0 + dt.timedelta(minutes=97 * k % 60 + 60 * run)))
    return spark.createDataFrame(made, WIDE)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def both(spark, tmp_path):
    """The same seven publications in tiers and in the plain log."""
    tiers, log = Tiers(spark, str(tmp_path / "tiers"), buckets=5, fan=3), str(tmp_path / "log")
    for run in range(7):
        tiers.add(puts.wide_to_puts(wide(spark, run), FAMILIES))
        serving.write_cells(wide_to_cells(wide(spark, run), FAMILIES), log, f"run{run}")
    return tiers, log


def test_scan_equals_the_log_and_has_no_exchange(spark, both):
    tiers, log = both
    for step in (lambda: None, tiers.merge, tiers.compact):
        step()
        scan = tiers.scan(FAMILIES)
        assert "Exchange" not in plan(scan) and "Bucketed: true" in plan(scan)
        assert rows(scan) == rows(serving.scan(spark, log, FAMILIES))
        assert rows(tiers.cells()) == rows(serving.read_cells(spark, log).select("row_key", "family", "qualifier", "value", "version_ts"))


def test_merges_go_level_by_level(spark, both):
    tiers, _ = both
    tiers.merge()
    assert sorted(level for level, _ in tiers.runs()) == [1]  # seven of level 0 at once
    for run in range(7, 9):
        tiers.add(puts.wide_to_puts(wide(spark, run), FAMILIES))
    tiers.merge()
    assert sorted(level for level, _ in tiers.runs()) == [0, 0, 1]
    tiers.add(puts.wide_to_puts(wide(spark, 9), FAMILIES))
    tiers.merge()
    assert sorted(level for level, _ in tiers.runs()) == [1, 1]


def test_merging_needs_no_exchange(both):
    tiers, _ = both
    assert "Exchange" not in plan(tiers._retained(tiers.read()))


def test_a_run_is_one_file_per_bucket_and_a_hot_key_is_cut(spark, tmp_path):
    tiers = Tiers(spark, str(tmp_path / "tiers"), buckets=4, versions=3)
    tiers.add(puts.wide_to_puts(wide(spark, 0, rows=300), FAMILIES))
    (level, run), = tiers.runs()
    files = [f for f in os.listdir(f"{tiers.path}/level={level}/run={run}") if f.endswith(".parquet")]
    assert len(files) <= 4
    hot = tiers.read().where("row_key = 'hot' AND family = 'f'").selectExpr("explode(map_keys(cells)) AS q").groupBy("q").count()
    assert {r["q"]: r["count"] for r in hot.collect()} == {"a": 3, "b": 3}


def test_readers_keep_their_snapshot(spark, both):
    tiers, _ = both
    before = tiers.read()
    old = rows(before.select("row_key", "family", "version_ts"))
    tiers.compact()
    assert rows(before.select("row_key", "family", "version_ts")) == old
    tiers.expire()
    assert len(tiers.runs()) == 1 and rows(tiers.scan(FAMILIES))


def test_an_unfinished_merge_is_not_seen(spark, both, monkeypatch):
    tiers, log = both

    def fail(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(tiers.snapshots, "commit", fail)
        with pytest.raises(OSError):
            tiers.merge()
    assert len(tiers.runs()) == 7
    assert rows(tiers.scan(FAMILIES)) == rows(serving.scan(spark, log, FAMILIES))


def test_an_empty_table(spark, tmp_path):
    tiers = Tiers(spark, str(tmp_path / "tiers"))
    tiers.merge()
    tiers.compact()
    assert tiers.scan(FAMILIES).count() == 0 and tiers.cells().count() == 0


def test_buckets_follow_the_rows(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert tiers_module.buckets_for(events, 8) == history._tiers(spark, sf_dir).buckets
    assert [tiers_module.buckets_for(rows, 8) for rows in (0, 1_600_000, 1_600_001, 36_000_000)] == [8, 8, 9, 180]
    monkeypatch.setattr(tiers_module, "BUCKET_ROWS", events // 20)
    assert history._tiers(spark, sf_dir).buckets >= 20
    found = history.serving_value_lookup(spark, sf_dir)
    monkeypatch.undo()
    assert sorted(map(str, found.collect())) == sorted(map(str, history.serving_value_lookup(spark, sf_dir).collect()))
