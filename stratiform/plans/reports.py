"""The two analyses on the serving view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.functions.casting import cell_or_default
from stratiform.operators.aggregates import group_mean
from stratiform.operators.cells import filter_wide
from stratiform.plans import serving
from stratiform.plans.fixed import SERVING_FAMILIES


def families(*columns: str) -> dict[str, list[str]]:
    """The serving families cut to some columns, so that a scan gathers only their cells."""
    return {family: [c for c in members if c in columns] for family, members in SERVING_FAMILIES.items()}


def scatter(
    wide: DataFrame,
    key: str,
    value: str,
    x: str,
    y: str,
    keep_missing: bool = True,
) -> DataFrame:
    """(y, x) of the rows whose ``key`` cell is ``value``; a missing number is 0."""
    kept = filter_wide(wide, key, value, keep_missing)
    return kept.select(cell_or_default(y, "int").alias(y), cell_or_default(x, "double").alias(x))


def rain_against_delay(wide: DataFrame, airport: str = "WAW", keep_missing: bool = True) -> DataFrame:
    return scatter(wide, "departure_iata", airport, "departure_rain", "arrival_delay", keep_missing)


def mean_delay(
    wide: DataFrame,
    key: str = "departure_iata",
    value: str = "arrival_delay",
    missing_as_zero: bool = True,
) -> DataFrame:
    """Mean per key in key order. A missing key is grouped as the text 0, as a missing cell."""
    numbers = wide.select(
        F.coalesce(F.col(key), F.lit("0")).alias(key),
        F.col(value).try_cast("double").alias(value),
    )
    return group_mean(numbers, [key], value, value, missing_as_zero).orderBy(key)


def rain_report(spark: SparkSession, cells: str, airport: str = "WAW", keep_missing: bool = True) -> DataFrame:
    """``rain_against_delay`` from the cells table: keys are chosen before their cells are gathered."""
    listed = families("departure_iata", "departure_rain", "arrival_delay")
    wide = serving.scan(spark, cells, listed, where=("departure_iata", airport), keep_missing=keep_missing)
    return rain_against_delay(wide, airport, keep_missing)


def delay_report(spark: SparkSession, cells: str, missing_as_zero: bool = True) -> DataFrame:
    """``mean_delay`` by departure airport from the cells table."""
    wide = serving.scan(spark, cells, families("departure_iata", "arrival_delay"))
    return mean_delay(wide, missing_as_zero=missing_as_zero)
