"""Serving cells: (row_key, family, qualifier, value, version_ts), all values text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.operators.dedup import newest_per_key

CELL = ["row_key", "family", "qualifier"]
MAX_VERSIONS = 10
FEW_COLUMNS = 8


def wide_to_cells(
    wide: DataFrame,
    families: Mapping[str, Sequence[str]],
    row_key: str = "row_key",
    version: str = "version_ts",
) -> DataFrame:
    """One row per non-null value of a family column, written as text."""
    triples = [
        f"'{family}', '{c}', CAST(`{c}` AS STRING)" for family, columns in families.items() for c in columns
    ]
    return (
        wide.selectExpr(
            f"`{row_key}` AS row_key",
            f"stack({len(triples)}, {', '.join(triples)}) AS (family, qualifier, value)",
            f"`{version}` AS version_ts",
        )
        .where(F.col("value").isNotNull())
        .select(*CELL, "value", "version_ts")
    )


def newest_versions(cells: DataFrame, n: int = MAX_VERSIONS) -> DataFrame:
    """Retention: the ``n`` newest versions of every cell."""
    return newest_per_key(cells, CELL, ["version_ts"], n)


def merge_cells(cells: DataFrame) -> DataFrame:
    """The newest value of every cell."""
    newest = F.max(F.struct("version_ts", "value"))
    return (
        cells.groupBy(*CELL)
        .agg(newest.alias("newest"))
        .select(*CELL, "newest.value", "newest.version_ts")
    )


def merge_wide(df: DataFrame, key: str, columns: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key, each column holding its newest non-null value.

    ``newest`` orders the rows of a key, most important first; equal rows fall back to
    the greater value. A null never replaces a value.
    """

    def latest(c: str) -> Column:
        order = F.struct(*newest, F.col(c).alias("_value"))
        return F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)

    return df.groupBy(key).agg(*(latest(c) for c in columns))


def wide_view(cells: DataFrame, families: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per row key with the newest value of each listed cell; null where missing.

    Every row key of ``cells`` is kept, also one that has none of the listed cells. Each task
    first reduces its cells to the newest per key and column, however many versions a key holds.
    For few columns one exchange by row key follows; for more than ``FEW_COLUMNS`` a test per
    column and cell would cost more than a second exchange. A table of puts (``puts.view``) needs
    one exchange for any number of columns.
    """

    def newest(family: str, column: str) -> Column:
        here = (F.col("family") == family) & (F.col("qualifier") == column)
        return F.max(F.when(here, F.struct("version_ts", "value"))).alias(column)

    listed = [(family, column) for family, columns in families.items() for column in columns]
    if not listed:
        return cells.select("row_key").distinct()
    if len(listed) > FEW_COLUMNS:
        return _many_columns(cells, listed)
    gathered = cells.groupBy("row_key").agg(*(newest(family, column) for family, column in listed))
    return gathered.select("row_key", *(F.col(f"`{column}`.value").alias(column) for _, column in listed))


def _many_columns(cells: DataFrame, listed: Sequence[tuple[str, str]]) -> DataFrame:
    name = F.concat_ws(":", "family", "qualifier")
    is_listed = name.isin(*(f"{family}:{column}" for family, column in listed))
    named = cells.select(
        "row_key",
        F.when(is_listed, name).alias("name"),
        F.when(is_listed, F.struct("version_ts", "value")).alias("cell"),
    )
    newest = named.groupBy("row_key", "name").agg(F.max("cell")["value"].alias("value"))
    entry = F.when(F.col("name").isNotNull(), F.struct("name", "value"))
    gathered = newest.groupBy("row_key").agg(F.map_from_entries(F.collect_list(entry)).alias("row"))
    return gathered.selectExpr("row_key", *(f"row['{family}:{column}'] AS `{column}`" for family, column in listed))


def wide_first(cells: DataFrame, families: Mapping[str, Sequence[str]], n: int) -> DataFrame:
    """The first ``n`` rows of the view in key order; the cells of other keys are not gathered."""
    first = cells.select("row_key").distinct().orderBy("row_key").limit(n)
    return wide_view(cells.join(F.broadcast(first), "row_key", "left_semi"), families).orderBy("row_key")


def wide_where(
    cells: DataFrame,
    families: Mapping[str, Sequence[str]],
    cell: tuple[str, str],
    value: str = "",
    keep_missing: bool = True,
) -> DataFrame:
    """The view's rows whose newest value of a cell (family, qualifier) is ``value``; all for an empty one.

    Keys are chosen from that cell alone, by a filter that reaches the scan, before the others
    are gathered. A column filter on a sparse store also returns the rows that lack the cell,
    which is the default here; ``keep_missing=False`` is strict equality.
    """
    if value == "":
        return wide_view(cells, families)
    here = cells.where((F.col("family") == cell[0]) & (F.col("qualifier") == cell[1]))
    newest = here.groupBy("row_key").agg(F.max(F.struct("version_ts", "value"))["value"].alias("value"))
    if keep_missing:
        kept = cells.join(newest.where(F.col("value") != value).select("row_key"), "row_key", "left_anti")
    else:
        kept = cells.join(newest.where(F.col("value") == value).select("row_key"), "row_key", "left_semi")
    return wide_view(kept, families)


def filter_wide(wide: DataFrame, column: str, value: str = "", keep_missing: bool = True) -> DataFrame:
    """The same choice on rows that are gathered already."""
    if value == "":
        return wide
    matches = F.col(column) == value
    return wide.where(matches | F.col(column).isNull() if keep_missing else matches)
