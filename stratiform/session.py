"""Session settings, shared working folder, and size-checked broadcasting."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All of these can be changed on a running session.
SETTINGS = {
    # Date parts are taken from zoned timestamps, so the zone is part of the result.
    "spark.sql.session.timeZone": "UTC",
    # The positional CSV files are cp1250, a charset outside Spark's default list.
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split by AQE even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Methods longer than this are not compiled by the JVM: wide rows are faster without whole-stage code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_CONFIGURED = "stratiform.configured"

BROADCAST_LIMIT_BYTES = 128 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings, once to a session: what its user changes later stays."""
    if spark.conf.get(_CONFIGURED, None) is None:
        for key, value in {**SETTINGS, _CONFIGURED: "true"}.items():
            spark.conf.set(key, value)
    return spark


def session(app_name: str = "stratiform", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def work_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors, for staged tables and stream state."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    created = tempfile.mkdtemp(prefix="stratiform-")
    spark.conf.set("spark.checkpoint.dir", created)
    return created


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def released(spark: SparkSession):
    """Shuffle files of a write inside go with that write, instead of whenever the driver collects garbage.

    For frames that are executed once: a result that is read again must be staged.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


BATCH_BYTES = 8 * 1024 * 1024
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python end at 8 MB, if their user set no other size: 10000 rows of texts are many times that.

    The JVM holds a batch outside its heap, and every worker of a task another copy.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are removed at the end; what is made from them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in _SCRATCH.pop():
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def stage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table.

    Cuts lineage in a way that survives lost executors, and gives the planner the
    real file size, so a small result is broadcast without a hint. Inside ``scratch`` the
    table is removed at the end, otherwise by the folder's own clean-up policy.
    """
    path = new_path(df.sparkSession, label)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(field: T.StructField):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + F.lit(16)
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows, measured by one aggregate over the frame."""
    total = sum((_width(field) for field in df.schema.fields), F.lit(0)).cast("long")
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def broadcast_within(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only if the measured size is within ``limit``.

    Above it the frame comes back unhinted: the join is then a shuffled one, whose
    hot partitions AQE splits.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df
