"""Dimension tables: airlines, airports, airplanes, aircraft_types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratiform.plans.fixed import DIMENSIONS
from stratiform.plans.ingest import ingest_files, write_parsed
from stratiform.sources.envelope import parse_envelopes, read_envelopes, records


def record_schema(name: str) -> str:
    return ", ".join(f"{column} STRING" for column in DIMENSIONS[name])


def parse(lines: DataFrame, name: str) -> DataFrame:
    return parse_envelopes(lines, record_schema(name))


def rows(parsed: DataFrame, name: str) -> DataFrame:
    """Every record of every envelope, fields bound by name, and the file it came from."""
    return records(parsed).select(*DIMENSIONS[name], "source_file")


def run(
    spark: SparkSession,
    name: str,
    staged: str,
    silver: str,
    quarantine: str,
    whole_file: bool = False,
    archive: str | None = None,
) -> None:
    """Append the staged files that the silver table does not have yet.

    A file that arrives again with other content is another delivery; its rows are added.
    """

    def write(paths: list[str], batch: str) -> None:
        parsed = parse(read_envelopes(spark, paths, whole_file), name)
        write_parsed(parsed, lambda kept: rows(kept, name), name, silver, quarantine, batch)

    ingest_files(spark, [f"{staged}/{name}*"], silver, write, archive)
