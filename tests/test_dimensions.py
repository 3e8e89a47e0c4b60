"""Dimension envelopes to silver."""

import pytest

from stratiform.plans import dimensions
from stratiform.plans.fixed import DIMENSIONS


def test_widths():
    assert {name: len(fields) for name, fields in DIMENSIONS.items()} == {
        "airlines": 15, "airports": 14, "airplanes": 26, "aircraft_types": 4,
    }


@pytest.mark.parametrize("name", sorted(DIMENSIONS))
def test_run(spark, write, envelope, tmp_path, name):
    fields = DIMENSIONS[name]
    full = {field: f"{field}-1" for field in reversed(fields)}
    partial = {fields[0]: 7, "unknown": "dropped"}
    write(f"{name}_1.json", envelope(full, partial) + envelope(full))
    folder = write(f"{name}_2.json", envelope({fields[1]: None, fields[0]: "9"}) + "{broken\n")
    silver, quarantine = str(tmp_path / "silver"), str(tmp_path / "quarantine")
    for _ in range(2):
        dimensions.run(spark, name, folder, silver, quarantine)
        table = spark.read.parquet(silver).drop("ingest_batch")
        assert table.columns == [*fields, "source_file"]
        rows = table.collect()
        assert len(rows) == 4
        assert sorted(row[fields[0]] for row in rows) == sorted(["7", "9", full[fields[0]], full[fields[0]]])
        assert [row[fields[1]] for row in rows if row[fields[0]] == "7"] == [None]
        assert [row[f] for row in rows if row[fields[0]] == full[fields[0]] for f in fields] == 2 * [full[f] for f in fields]
        bad = spark.read.parquet(quarantine).collect()
        assert [(row.source_file, row.problem, row.dataset) for row in bad] == [(f"{name}_2.json", "malformed_json", name)]
