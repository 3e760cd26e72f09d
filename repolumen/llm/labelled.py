"""Bounded samples of labelled documents and the held-out rule shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents no label of which is ever read: ``crc32`` of the id as text, modulo five, is 0.
    A row without id is held out as well."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``(text, label)`` of at most ``limit`` labelled documents outside the held-out fold.

    The rows are those with the smallest hash of the id, a fixed pseudo-random choice. The choice is made on the
    narrow label table; it is bounded by ``limit`` and so is what gets broadcast to the scan of the texts. Null
    labels and labels other than 0 and 1 are skipped.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("row"), "text", "label")
