"""Incremental file ingest: every staged file once, in bounded batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stratiform.plans import flights
from stratiform.sinks import Manifest
from stratiform.snapshots import Snapshots, batch_folder
from stratiform.sources.envelope import parse_envelopes, records, with_source

FILES_PER_BATCH = 1000


def envelope_stream(
    spark: SparkSession,
    staged: str,
    files_per_batch: int = FILES_PER_BATCH,
    archive: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """(value, source_file) of new files.

    With ``archive``, a file is moved there once a later batch shows that its own batch
    was committed; the files of the last batch stay until the next one.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return with_source(reader.text(staged))


def ingest_records(
    lines: DataFrame, record: T.StructType | str, path: str, checkpoint: str
) -> StreamingQuery:
    """Write the records of good envelopes with the exactly-once file sink."""
    rows = records(parse_envelopes(lines, record))
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint; another checkpoint has another one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]


def ingest_flights(
    lines: DataFrame, silver: str, quarantine: str, checkpoint: str, literal: bool = False
) -> StreamingQuery:
    """Flights to silver and quarantine.

    A batch of the stream is a batch of the tables, named after the query, so a repeated one
    replaces itself, or is left alone if a snapshot lists it already. Files that a batch job has ingested already are left out.
    """

    def write(lines: DataFrame, batch_id: int) -> None:
        manifest = Manifest(lines.sparkSession, silver)
        batch = f"{query_id(lines.sparkSession, checkpoint)}-{batch_id}"
        snapshots = Snapshots(lines.sparkSession, silver)
        if batch_folder(batch) not in snapshots.folders():
            flights.write(manifest.without_known(lines, batch), silver, quarantine, batch, literal)
            snapshots.commit([batch_folder(batch)])
        manifest.note(batch, manifest.without_known(lines, batch))

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
