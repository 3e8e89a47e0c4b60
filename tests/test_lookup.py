"""Value lookups open few files and return what a full scan returns; means follow corrections."""

import datetime as dt

import pytest

from stratiform.operators import puts
from stratiform.plans import reports
from stratiform.plans.lookup import ValueIndex
from stratiform.plans.means import Means
from stratiform.plans.tiers import Tiers

FAMILIES = {"f": ["kind"], "m": ["amount"]}
WIDE = "row_key string, kind string, amount string, version_ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def run_of(spark, number, rows=60):
    """Rows that correct those of earlier runs: another kind, another amount, or one that cannot be read."""
    made = []
    for k in range(rows):
        kind = None if k % 7 == 0 else f"k{(k + number) % 5}"
        amount = "n/a" if k % 11 == 0 else None if k % 13 == 0 else f"{k / 8 + number}"
        made.append((f"r{k * (number + 1) % 50}", kind, amount, T0 + dt.timedelta(minutes=number * 100 + k)))
    return puts.wide_to_puts(spark.createDataFrame(made, WIDE), FAMILIES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def tiers(spark, tmp_path):
    return Tiers(spark, str(tmp_path / "tiers"), buckets=4, fan=3)


def test_a_lookup_opens_the_files_of_its_range_only(spark, tiers, tmp_path):
    index = ValueIndex(tiers, str(tmp_path / "index"), [("f", "kind")], file_rows=10)
    for number in range(4):
        tiers.add(run_of(spark, number))
        index.update()
        tiers.merge()
        for value in ("k0", "k3", "none"):
            found = index.find(FAMILIES, ("f", "kind"), value)
            assert rows(found) == rows(puts.view_where(tiers.read(), FAMILIES, ("f", "kind"), value, keep_missing=False))
    index.update()
    everything = spark.read.parquet(*(f"{f}/files" for f in index._folders())).count()
    opened = index.files(("f", "kind"), "k2")
    assert 0 < len(opened) < everything / 2
    assert set(index.keys(("f", "kind"), "k2").inputFiles()) == set(opened)
    assert index.files(("f", "kind"), "zzz") == [] and index.find(FAMILIES, ("f", "kind"), "zzz").count() == 0


def test_a_value_of_most_rows_is_spread_over_files(spark, tiers, tmp_path):
    wide = spark.createDataFrame([(f"r{k}", "same" if k % 10 else f"x{k}", "1", T0) for k in range(200)], WIDE)
    tiers.add(puts.wide_to_puts(wide, FAMILIES))
    index = ValueIndex(tiers, str(tmp_path / "index"), [("f", "kind")], file_rows=20)
    index.update()
    assert len(index.files(("f", "kind"), "same")) > 4
    assert index.find(FAMILIES, ("f", "kind"), "same").count() == 180
    with pytest.raises(ValueError):
        index.find(FAMILIES, ("m", "amount"), "1")


def test_an_index_of_nothing(spark, tiers, tmp_path):
    index = ValueIndex(tiers, str(tmp_path / "index"), [("f", "kind")])
    index.update()
    assert index.find(FAMILIES, ("f", "kind"), "k1").count() == 0


@pytest.mark.parametrize("missing_as_zero", [True, False])
@pytest.mark.parametrize("late", [False, True])
def test_incremental_means_equal_full_ones(spark, tiers, tmp_path, missing_as_zero, late):
    """After every run, or with several runs and a merge between two updates; a repeated update changes nothing."""
    means = Means(tiers, str(tmp_path / "means"), ("f", "kind"), ("m", "amount"), missing_as_zero)
    for number in range(5):
        tiers.add(run_of(spark, number))
        if late and number % 2:
            tiers.merge()
            continue
        for _ in range(2):
            means.update()
        full = reports.mean_delay(tiers.scan(FAMILIES), "kind", "amount", missing_as_zero)
        found = {r["kind"]: r["amount"] for r in means.means("kind", "amount").collect()}
        assert found == {r["kind"]: pytest.approx(r["amount"]) for r in full.collect()}


def test_means_are_counted_anew_where_the_old_snapshot_expired(spark, tiers, tmp_path):
    means = Means(tiers, str(tmp_path / "means"), ("f", "kind"), ("m", "amount"))
    tiers.add(run_of(spark, 0))
    means.update()
    tiers.add(run_of(spark, 1))
    tiers.compact()
    tiers.expire()
    means.update()
    full = reports.mean_delay(tiers.scan(FAMILIES), "kind", "amount")
    assert {r["kind"]: r["amount"] for r in means.means("kind", "amount").collect()} == {
        r["kind"]: pytest.approx(r["amount"]) for r in full.collect()
    }
