"""Casts that turn one bad field into one null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
_FLOAT_HINT = r"(?i)[0-9]|nan|inf"
_TEXT_OF_TYPE = {
    **dict.fromkeys(("tinyint", "smallint", "int", "bigint"), _INTEGER_TEXT),
    **dict.fromkeys(("float", "double"), _FLOAT_HINT),
}


def parsed_text(column: Column, data_type: T.DataType | str) -> Column:
    """Text to a value, null where it does not parse.

    A failed cast to a number is an exception inside Spark, caught row by row. Testing the
    text first, fully for integers and for a sign of a number otherwise, costs far less
    where such failures are common; what passes the test is still cast with ``try_cast``.
    """
    name = (data_type if isinstance(data_type, str) else data_type.simpleString()).lower()
    cast = column.try_cast(data_type)
    return F.when(column.rlike(_TEXT_OF_TYPE[name]), cast) if name in _TEXT_OF_TYPE else cast


def _cast(source: T.DataType, name: str, data_type: T.DataType | str) -> Column | str:
    if source == data_type:
        return name
    column = F.col(name)
    is_text = isinstance(source, T.StringType)
    return (parsed_text(column, data_type) if is_text else column.try_cast(data_type)).alias(name)


def typed(df: DataFrame, types: Mapping[str, T.DataType | str]) -> DataFrame:
    """Cast the named columns in one projection; text that does not parse becomes null."""
    return df.select(*(_cast(f.dataType, f.name, types[f.name]) if f.name in types else f.name for f in df.schema))


def bind_by_name(df: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Give ``df`` the columns, order and types of ``schema``.

    Columns are matched by name: extra ones are dropped and missing ones are null.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    present = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *(
            _cast(present[f.name], f.name, f.dataType)
            if f.name in present
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )


def cast_all_to_string(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


def cell_or_default(column: Column | str, data_type: str = "double", default=0) -> Column:
    """Parse a text cell; a missing or unreadable cell is ``default``."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(parsed_text(column, data_type), F.lit(default).cast(data_type))


def mean(column: Column | str) -> Column:
    """Mean of the values that are numbers: nulls and NaN are skipped, none gives null.

    The sum is one of doubles, so the last digits depend on the order in which partial
    sums arrive; round where results are compared.
    """
    column = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.avg(F.when(~F.isnan(column), column))
