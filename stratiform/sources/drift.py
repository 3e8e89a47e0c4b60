"""Fields of records that the fixed schema does not have: kept beside the typed columns, and reported.

A record is parsed once more into a ``VARIANT``, and what the schema names is taken out of it. The
rest is an array of (field, value) per record, so a table keeps it without knowing it, and a later
reader can take a field out with its own type.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "unknown_fields"
KEPT = "array<struct<field: string, value: variant>>"


def _levels(schema: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], list[str]]]:
    """The path of the record and of every object in it that the schema names, with the fields it has there."""
    yield path, schema.names
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            yield from _levels(field.dataType, (*path, field.name))


def _quoted(name: str) -> str:
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"a path cannot have a name with both kinds of quotes: {name}")
    return f"[{quote}{name}{quote}]"


def unknown_fields(value: Column, schema: T.StructType | str) -> Column:
    """What the JSON text of a record has beyond ``schema``: an array of field (its path, by dots) and value.

    Objects that the schema names are looked into; other objects and arrays are values as a whole.
    The array is empty if there is nothing, and null if the text is no JSON object or names a field twice.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    record = F.try_parse_json(value)
    return F.concat(*(_rest(record, path, known) for path, known in _levels(schema)))


def _rest(record: Column, path: tuple[str, ...], known: list[str]) -> Column:
    """The fields of the object at ``path`` that are not known; of an object that is not there, none."""
    fields = F.try_variant_get(record, "$" + "".join(_quoted(p) for p in path), "map<string,variant>")
    prefix = "".join(f"{p}." for p in path)
    rest = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(known))
    named = F.transform(rest, lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("field"), e["value"].alias("value")))
    return F.coalesce(named, F.array().cast(KEPT)) if path else named


def with_unknown(parsed: DataFrame, schema: T.StructType | str) -> DataFrame:
    """What ``parse_envelopes`` gives, with a column of the good records' unknown fields, which ``records`` keeps."""
    return parsed.withColumn(UNKNOWN, F.when(F.col("_problem").isNull(), unknown_fields(F.col("value"), schema)))


def field(name: str, data_type: str, path: str = "$") -> Column:
    """A kept field of a row with a type, or null if the row does not have it or it does not fit the type."""
    entries = F.filter(UNKNOWN, lambda e: e["field"] == name)
    return F.try_variant_get(F.get(entries, F.lit(0))["value"], path, data_type)


def drift(rows: DataFrame) -> DataFrame:
    """Every unknown field of a table: in how many rows it stands, in how many as a null, and the type that fits all.

    One row per field and task is shuffled. Numbers of decimals are left out of types.
    """
    each = rows.select(F.explode(UNKNOWN).alias("_kept")).select("_kept.*")
    fitting = F.regexp_replace(F.schema_of_variant_agg("value"), r"DECIMAL\([0-9]+,\s*[0-9]+\)", "DECIMAL")
    null = F.is_variant_null("value").cast("long")
    return each.groupBy("field").agg(F.count("*").alias("n"), F.sum(null).alias("nulls"), fitting.alias("type"))
