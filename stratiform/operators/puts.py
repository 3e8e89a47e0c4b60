"""Serving puts: (row_key, family, version_ts, cells), the cells of one row, family and version as a map.

A put holds what ``cells`` holds in one row per value, so a table of puts has a row where a table
of cells has one per column. Everything that reads it first reduces the puts of a task to the
newest value per key and column, then exchanges one row per key and task, by key: a key with
any number of versions is never gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW_COLUMNS = 8
PUTS = "row_key STRING, family STRING, version_ts TIMESTAMP, cells MAP<STRING, STRING>"


def wide_to_puts(
    wide: DataFrame,
    families: Mapping[str, Sequence[str]],
    row_key: str = "row_key",
    version: str = "version_ts",
) -> DataFrame:
    """One put per row and family with any value; values are text, nulls are left out.

    The texts of a row are made before its maps, which are then made from positions: no name is compared.
    """
    listed = [(family, columns) for family, columns in families.items() if columns]
    texts = [F.array(*(F.col(f"`{c}`").cast("string") for c in columns)).alias(f"_{k}") for k, (_, columns) in enumerate(listed)]
    row = wide.select(F.col(row_key).alias("row_key"), F.col(version).alias("version_ts"), *texts)

    def cells(k: int, columns: Sequence[str]) -> Column:
        named = F.transform_values(_places(columns), lambda _, place: F.col(f"_{k}")[place])
        return F.map_filter(named, lambda _, text: text.isNotNull())

    made = [F.struct(F.lit(family).alias("family"), cells(k, columns).alias("cells")) for k, (family, columns) in enumerate(listed)]
    put = row.select("row_key", "version_ts", F.explode(F.array(*made)).alias("_put"))
    return put.select("row_key", "_put.family", "version_ts", "_put.cells").where(F.size("cells") > 0)


def _places(columns: Sequence[str]) -> Column:
    """Position by name, a constant."""
    return F.create_map(*(F.lit(part) for k, c in enumerate(columns) for part in (c, k)))


def cells_to_puts(cells: DataFrame) -> DataFrame:
    """A put per cell, without any exchange; compaction puts those of a version together."""
    return cells.select("row_key", "family", "version_ts", F.create_map("qualifier", "value").alias("cells"))


def gathered(cells: DataFrame) -> DataFrame:
    """A put per row key, family and version; of several values of one cell and version the greatest counts."""
    newest = cells.groupBy("row_key", "family", "version_ts", "qualifier").agg(F.max("value").alias("value"))
    entries = F.map_from_entries(F.collect_list(F.struct("qualifier", "value")))  # as many as a family has columns
    return newest.groupBy("row_key", "family", "version_ts").agg(entries.alias("cells"))


def puts_to_cells(puts: DataFrame) -> DataFrame:
    listed = puts.select("row_key", "family", F.explode("cells").alias("qualifier", "value"), "version_ts")
    return listed.select("row_key", "family", "qualifier", "value", "version_ts")


def _is_few(families: Mapping[str, Sequence[str]]) -> bool:
    return sum(len(columns) for columns in families.values()) <= FEW_COLUMNS


def _taken(puts: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """``puts`` with the listed cells as columns (``_0_0``), if they are few: what a task sorts, spills and exchanges holds no others."""
    if not _is_few(families):
        return puts
    texts = [
        F.when(F.col("family") == family, F.col("cells")[c]).alias(f"_{k}_{n}")
        for k, (family, columns) in enumerate(families.items())
        for n, c in enumerate(columns)
    ]
    return puts.select("row_key", "version_ts", *texts)


def _gathered(taken: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """The view of what ``_taken`` gives."""
    few = _is_few(families)

    def newest(family: str, column: str, text: Column) -> Column:
        here = text.isNotNull() if few else (F.col("family") == family) & text.isNotNull()
        return F.max(F.when(here, F.struct("version_ts", text.alias("value")))).alias(column)

    columns = [
        newest(family, c, F.col(f"_{k}_{n}") if few else F.col("cells")[c])
        for k, (family, names) in enumerate(families.items())
        for n, c in enumerate(names)
    ]
    names = [c for listed in families.values() for c in listed]
    return taken.groupBy("row_key").agg(*columns).select("row_key", *(F.col(f"`{c}`.value").alias(c) for c in names))


def view(puts: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per row key with the newest value of each listed cell; null where missing.

    Every row key of ``puts`` is kept, also one that has none of the listed cells.
    """
    if not any(families.values()):
        return puts.select("row_key").distinct()
    return _gathered(_taken(puts, families), families)


def view_first(puts: DataFrame, families: Mapping[str, Sequence[str]], n: int) -> DataFrame:
    """The first ``n`` rows of the view in key order; the puts of other keys are not gathered."""
    first = puts.select("row_key").distinct().orderBy("row_key").limit(n)
    return view(puts.join(F.broadcast(first), "row_key", "left_semi"), families).orderBy("row_key")


def newest_of(puts: DataFrame, cell: tuple[str, str]) -> DataFrame:
    """row_key and the newest value of one cell (family, qualifier), of the keys that have it."""
    family, qualifier = cell
    here = puts.where(F.col("family") == family).select("row_key", "version_ts", F.col("cells")[qualifier].alias("value"))
    here = here.where(F.col("value").isNotNull())
    return here.groupBy("row_key").agg(F.max(F.struct("version_ts", "value"))["value"].alias("value"))


def view_where(
    puts: DataFrame,
    families: Mapping[str, Sequence[str]],
    cell: tuple[str, str],
    value: str = "",
    keep_missing: bool = True,
) -> DataFrame:
    """The view's rows whose newest value of a cell is ``value``, as ``cells.wide_where``."""
    if value == "":
        return view(puts, families)
    newest, listed = newest_of(puts, cell), any(families.values())
    taken = _taken(puts, families) if listed else puts.select("row_key")
    if keep_missing:
        kept = taken.join(newest.where(F.col("value") != value).select("row_key"), "row_key", "left_anti")
    else:
        kept = taken.join(newest.where(F.col("value") == value).select("row_key"), "row_key", "left_semi")
    return _gathered(kept, families) if listed else kept.distinct()
