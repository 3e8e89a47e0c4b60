"""Run one job: ``spark-submit stratiform/__main__.py <job> …`` or ``python -m stratiform <job> …``."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame

from stratiform.plans import dimensions, flights, gold, reports, serving, weather
from stratiform.plans.fixed import DIMENSIONS, SERVING_FAMILIES
from stratiform.session import session
from stratiform.streaming import envelope_stream, ingest_flights


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="stratiform")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str, literal: bool = False) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        if literal:
            sub.add_argument("--literal", action="store_true", help="repeat the original field mix-ups")
        return sub

    dimension = job("dimension", "staged", "silver", "quarantine")
    dimension.add_argument("name", choices=sorted(DIMENSIONS))
    ingests = [dimension, job("flights", "staged", "silver", "quarantine", literal=True)]
    for sub in ingests:
        sub.add_argument("--whole-file", action="store_true", help="documents span lines")
    ingests.append(job("flights-stream", "staged", "silver", "quarantine", "checkpoint", literal=True))
    ingests.append(job("weather", "staged", "silver", literal=True))
    ingests[-1].add_argument("--quarantine", help="inside the silver table's folder by default")
    ingests[-1].add_argument("--year-shift", type=int, default=1)
    for sub in ingests:
        sub.add_argument("--archive", help="move ingested files to this folder")
    day = dt.date.fromisoformat
    build = job("gold", "flights", "weather", "gold", literal=True)
    build.add_argument("--since", type=day, help="first departure day to rebuild")
    build.add_argument("--polled-since", type=day, help="first snapshot day to read")
    publish = job("serving", "gold", "cells")
    publish.add_argument("--run-id", help="name of the run to write or replace; a new one by default")
    publish.add_argument("--since", type=day, help="first departure day to publish")
    publish.add_argument("--fresh", action="store_true", help="drop what the cells table holds")
    job("compact", "cells").add_argument("--target", help="write the result there instead of in place")
    view = job("scan", "cells", "output")
    view.add_argument("--columns", help="comma-separated; all by default")
    view.add_argument("--limit", type=int, help="first row keys only")
    find = job("find", "cells", "output", "column", "value")
    find.add_argument("--columns", help="comma-separated; all by default")
    rain = job("rain-against-delay", "cells", "output")
    rain.add_argument("--airport", default="WAW")
    for sub in (find, rain):
        sub.add_argument("--strict", action="store_true", help="leave out rows that lack the cell")
    job("mean-delay", "cells", "output").add_argument("--skip-missing", action="store_true")
    return parser


def _families(columns: str | None) -> dict[str, list[str]]:
    return reports.families(*columns.split(",")) if columns else SERVING_FAMILIES


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = session(f"stratiform-{args.job}")
    match args.job:
        case "dimension":
            dimensions.run(spark, args.name, args.staged, args.silver, args.quarantine, args.whole_file, args.archive)
        case "flights":
            flights.run(spark, args.staged, args.silver, args.quarantine, args.literal, args.whole_file, args.archive)
        case "flights-stream":
            lines = envelope_stream(spark, args.staged, archive=args.archive, pattern="flights*")
            ingest_flights(lines, args.silver, args.quarantine, args.checkpoint, args.literal).awaitTermination()
        case "weather":
            weather.run(
                spark, args.staged, args.silver, args.year_shift, args.literal, args.quarantine, args.archive
            )
        case "gold":
            gold.run(spark, args.flights, args.weather, args.gold, args.literal, args.since, args.polled_since)
        case "serving":
            missing = serving.run(spark, args.gold, args.cells, args.run_id, args.since, args.fresh)
            print(f"rows with a missing key part: {missing}")
        case "compact":
            serving.compact(spark, args.cells, args.target)
        case "scan":
            _save(serving.scan(spark, args.cells, _families(args.columns), args.limit), args.output)
        case "find":
            where = (args.column, args.value)
            _save(serving.scan(spark, args.cells, _families(args.columns), None, where, not args.strict), args.output)
        case "mean-delay":
            _save(reports.delay_report(spark, args.cells, not args.skip_missing), args.output)
        case "rain-against-delay":
            _save(reports.rain_report(spark, args.cells, args.airport, not args.strict), args.output)


def _save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


if __name__ == "__main__":
    main()
