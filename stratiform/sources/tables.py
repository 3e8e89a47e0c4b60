from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NOTHING_THERE = {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def nothing_there(error: AnalysisException) -> bool:
    return error.getCondition() in _NOTHING_THERE


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """A Parquet table with its discovered partition columns, or None if there is none yet."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if nothing_there(error):
            return None
        raise


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
