"""Bounded samples of labelled documents for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratiform.session import stage


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts, the same on every run: doc_id, label, text.

    ``labels`` has doc_id and label; of several labels of one document the greatest counts,
    null labels and null ids do not. The documents are chosen by the hash of their ids among
    the labels, so the texts are read once and never shuffled: the chosen ids are at most
    ``rows``, which bounds the broadcast. Repeated rows of a chosen document give its least
    text, so a sample holds every id once.
    """
    chosen = (
        labels.where(learn & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("label").cast("int")).alias("label"))
        .orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return stage(found, "sample").orderBy("doc_id")


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` on division by ``folds``; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))
