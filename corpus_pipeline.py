"""A corpus pipeline over ``documents``: each stage calls one operator, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.llm import decontam, mixing, neardup, quality, wavelet
from stratiform.llm.queries import tokenizer_path
from stratiform.session import bounded_batches, broadcast_within, new_path, scratch, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels, F.lit(True))
    return quality.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of the least id; rows without id come last.

    Of rows of equal id and text one stays, with or without words.
    """
    row = mixing.draw().alias("_row")
    found = neardup.near_duplicates(docs.select(row.alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("component")).distinct()
    ids = docs.groupBy(row).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    rows = stage(ids.join(found, "_row"), "rows")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "_row")).alias("first"))
    kept = stage(first.select("first._row").join(rows.select("_row", "n"), "_row"), "kept")
    again = stage(kept.where("n > 1").select("_row"), "again")
    others = rows.select("_row").join(kept, "_row", "left_anti")
    single = _without(docs, others.union(again))
    if again.isEmpty():
        return single
    # Equal rows meet after each task has taken one of its own, however many there are.
    repeated = docs.join(broadcast_within(again), mixing.draw() == F.col("_row"), "left_semi")
    once = repeated.groupBy(row).agg(F.min(F.struct(*docs.columns)).alias("one"))
    return single.union(once.select("one.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    keyed = docs.select(mixing.draw().alias("doc_id"), "text")
    found = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select(F.col("doc_id").alias("_row")).distinct())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it does not take go.

    Of rows that repeat a document each is taken as often as the one that is taken most.
    """
    mixed = mixing.mix(docs).groupBy("draw").agg(F.max("copies").alias("copies")).where("copies > 0")
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_time")
    taken = mixed.select(F.col("draw").alias("_taken_draw"), times).drop("_time")
    return docs.join(taken, mixing.draw() == F.col("_taken_draw")).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' contents, read back: doc_id, start, n_tokens, ids_crc32."""
    return wavelet.read(wavelet.write(docs, tokenizer_path()))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not among ``rows``, by the hash of id and text: an id may be missing or repeated."""
    return docs.join(stage(rows, "dropped"), mixing.draw() == F.col("_row"), "left_anti")


def _bounded(stage_of):
    """A stage whose batches to Python are of bounded size."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage_of(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality", _bounded(quality_stage)),
    ("near_duplicates", _bounded(near_duplicate_stage)),
    ("decontamination", _bounded(decontamination_stage)),
    ("mixing", _bounded(mixing_stage)),
    ("tokens", _bounded(token_stage)),
]

# Learned scores are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage_of in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage writes on its way goes when its result is written
            stage_of(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
