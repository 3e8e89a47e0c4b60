"""JSON envelopes: one document per line (or per file) with the records in an array field.

An envelope is split into the texts of its records first, and every record is parsed on its
own: one bad record goes to quarantine and its neighbours stay. Record leaves are read as text
and cast after flattening, so one badly typed leaf costs one value and not its record.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratiform.functions.casting import parsed_text
from stratiform.sources.tables import nothing_there

MALFORMED = "malformed_json"
MISSING = "missing_data"
BAD_RECORD = "malformed_record"
NULL_RECORD = "null_record"
LINES = "value string, source_file string, source_id string"


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Distinct paths and names of the files a glob matches, and their identities, without reading them."""
    try:
        files = spark.read.format("binaryFile").load(glob)
    except AnalysisException as error:
        if nothing_there(error):
            return spark.createDataFrame([], "path string, file_name string, source_id string")
        raise
    identity = source_id(F.col("path"), F.col("modificationTime"), F.col("length"))
    return files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), identity.alias("source_id")
    ).distinct()


def source_id(path: Column, modified: Column, length: Column) -> Column:
    """Identity of a delivered file: the same path with other content or time is another delivery.

    Spark spells a local path with one or three slashes after the scheme, depending on the reader.
    """
    return F.concat_ws("|", F.regexp_replace(path, "^file:/+", "/"), F.unix_millis(modified).cast("string"), length.cast("string"))


def read_envelopes(spark: SparkSession, paths: str | Sequence[str], whole_file: bool = False) -> DataFrame:
    """(value, source_file, source_id) per line, or per file for pretty-printed documents."""
    if not paths:
        return spark.createDataFrame([], LINES)
    try:
        lines = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=whole_file)
    except AnalysisException as error:
        if nothing_there(error):
            return spark.createDataFrame([], LINES)
        raise
    return with_source(lines)


def with_source(lines: DataFrame) -> DataFrame:
    """The text, and name and identity of its file; blank lines carry no document. Works on streams too."""
    meta = [F.col(f"_metadata.{part}") for part in ("file_path", "file_modification_time", "file_size")]
    return lines.select(
        "value", F.col("_metadata.file_name").alias("source_file"), source_id(*meta).alias("source_id")
    ).where(F.trim("value") != "")


CORRUPT = {"columnNameOfCorruptRecord": "_corrupt"}


def _retyped(schema: T.StructType, types: Mapping[str, str], parent: str = "") -> T.StructType:
    """The schema with the types that ``types`` has for leaves, by path."""
    fields = []
    for field in schema.fields:
        path, data_type = parent + field.name, field.dataType
        if isinstance(data_type, T.StructType):
            data_type = _retyped(data_type, types, f"{path}.")
        elif path in types:
            data_type = T.DataType.fromDDL(types[path])
        fields.append(T.StructField(field.name, data_type))
    return T.StructType(fields)


def _cast(record: Column, schema: T.StructType, typed: T.StructType) -> Column:
    """A record of texts with the leaves of another type cast as ``bind_by_name`` does."""
    if schema == typed:
        return record
    fields = []
    for field, wanted in zip(schema.fields, typed.fields, strict=True):
        value = record[field.name]
        if isinstance(field.dataType, T.StructType):
            value = _cast(value, field.dataType, wanted.dataType)
        elif field.dataType != wanted.dataType:
            value = parsed_text(value, wanted.dataType)
        fields.append(value.alias(field.name))
    return F.when(record.isNotNull(), F.struct(*fields))


def _texts(records: Column, schema: T.StructType) -> Iterator[Column]:
    """The values of every leaf of text in an array of records."""
    for field in schema.fields:
        if isinstance(field.dataType, T.StructType):
            yield from _texts(records[field.name], field.dataType)
        elif isinstance(field.dataType, T.StringType):
            yield records[field.name]


def _at_once(lines: DataFrame, record: T.StructType, field: str) -> DataFrame:
    """``_whole``: all records of an envelope from one parse, or null where that finds anything bad.

    It is null too where a number too great for a double is read as text, which then has quotes.
    """
    document = T.StructType().add(field, T.ArrayType(record)).add("_corrupt", T.StringType())
    options = {**CORRUPT, "allowNonNumericNumbers": "false"}
    parsed = lines.withColumn("_at_once", F.from_json("value", document, options))
    records = F.col("_at_once")[field]
    too_great = [F.array_contains(leaf, f'"{text}"') for leaf in _texts(records, record) for text in ("Infinity", "-Infinity")]
    odd = F.coalesce(reduce(or_, too_great, F.lit(False)), F.lit(False))
    return parsed.withColumn("_whole", F.when(F.col("_at_once._corrupt").isNull() & ~odd, records)).drop("_at_once")


def parse_envelopes(
    lines: DataFrame,
    record: T.StructType | str,
    field: str = "data",
    reject: dict[str, Column] | None = None,
    texts: bool = True,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per record, and one per envelope that is bad as a whole.

    Columns are those of ``lines`` with ``value`` cut to the record's text, ``_record``, and
    ``_problem``, which is null for a good record. An envelope with an empty array gives no
    row. ``reject`` names further problems of whole envelopes and when they apply.

    Without ``texts``, ``value`` may be null for good records. Then an envelope is parsed in one
    go, and split into the texts of its records only if that finds anything bad. ``types`` are
    types for leaves (path -> type) that mostly come as such numbers or booleans; with another
    value they are cast from text.

    The parsed values go through an explode: the optimizer would push a filter on them below
    the parse otherwise, and parse everything again for it.
    """
    if isinstance(record, str):
        record = T.StructType.fromDDL(record)
    document = T.StructType().add(field, T.ArrayType(T.StringType())).add("_corrupt", T.StringType())
    checked = T.StructType([*record.fields, T.StructField("_corrupt", T.StringType())])
    typed = _retyped(record, types or {})
    kept = [c for c in lines.columns if c != "value"]
    in_texts, items = F.from_json("value", document, CORRUPT), F.col("_document")[field]
    is_whole = F.lit(False)
    if not texts:
        lines, is_whole = _at_once(lines, typed, field), F.col("_whole").isNotNull()
        in_texts = F.when(~is_whole, in_texts)
        parts = F.transform(items, lambda text: F.struct(text.alias("_text"), F.lit(None).cast(typed).alias("_good")))
        whole = F.transform("_whole", lambda r: F.struct(F.lit(None).cast("string").alias("_text"), r.alias("_good")))
        items = F.when(is_whole, whole).otherwise(parts)
    problem = F.when(F.col("_document._corrupt").isNotNull(), MALFORMED).when(
        F.col("_document")[field].isNull() & ~is_whole, MISSING
    )
    for name, condition in (reject or {}).items():
        problem = problem.when(condition, name)
    split = lines.withColumn("_document", in_texts).withColumn("_envelope", problem)
    rejected = F.when(F.col("_envelope").isNotNull(), F.col("value")).alias("value")
    items = F.when(F.col("_envelope").isNull(), items)
    split = split.select(rejected, *kept, "_envelope", F.posexplode_outer(items).alias("_position", "_item"))
    split = split.where(F.col("_envelope").isNotNull() | F.col("_position").isNotNull())
    text, good = (F.col("_item"), F.lit(None)) if texts else (F.col("_item._text"), F.col("_item._good"))
    parsed = split.withColumn("_parsed", F.from_json(text, checked, CORRUPT))
    found = F.struct(
        F.when(good.isNull(), F.coalesce(text, "value", F.lit("null"))).alias("value"),
        F.coalesce(good, _cast(F.col("_parsed").dropFields("_corrupt"), record, typed)).alias("_record"),
        F.coalesce("_envelope", F.when(text.isNull() & good.isNull(), NULL_RECORD)).alias("_outer"),
        F.col("_parsed._corrupt").isNotNull().alias("_bad"),
    )
    rows = parsed.select(*kept, F.explode(F.array(found)).alias("_found"))
    bad = F.coalesce("_found._outer", F.when(F.col("_found._bad") | F.col("_found._record").isNull(), BAD_RECORD))
    return rows.select("_found.value", *kept, "_found._record", bad.alias("_problem"))


def records(parsed: DataFrame) -> DataFrame:
    """One row per good record, with the other columns of ``parsed`` kept."""
    kept = [c for c in parsed.columns if c not in ("value", "_record", "_problem")]
    return parsed.where(F.col("_problem").isNull()).select("_record.*", *kept)


def quarantined(parsed: DataFrame) -> DataFrame:
    """The rejected envelopes and records: their text and the reason."""
    kept = [c for c in parsed.columns if c not in ("_record", "_problem")]
    return parsed.where(F.col("_problem").isNotNull()).select(*kept, F.col("_problem").alias("problem"))
