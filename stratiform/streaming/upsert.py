"""Streaming upsert into the serving cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stratiform.operators.puts import wide_to_puts
from stratiform.plans.serving import write_puts
from stratiform.streaming.ingest import query_id


def upsert_cells(
    wide: DataFrame, families: Mapping[str, Sequence[str]], path: str, checkpoint: str
) -> StreamingQuery:
    """Append the puts of every batch as one run, named after the query and the batch.

    A repeated batch replaces its own run; a query with another checkpoint writes other runs.

    ``wide`` has ``row_key``, the family columns and ``version_ts``.
    """
    table = wide_to_puts(wide, families)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_puts(batch, path, f"{query_id(batch.sparkSession, checkpoint)}-{batch_id}")

    return (
        table.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
