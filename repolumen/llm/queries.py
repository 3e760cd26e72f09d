"""Registered queries of the ten operators: each derives the contract's columns from its operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (decontaminate, fingerprints, mixing, near_dedup, ngram_join, pii, quality, spelling, suffix_dedup,
               token_rollup, toxicity, warc, whitening)
from .oracle import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
__all__ = ["ORACLE", "QUERIES"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op2_pii(spark, sf_dir):
    return pii.personal_data(_table(spark, sf_dir, "documents"))


@query
def op3_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


@query
def op4_token_rollup(spark, sf_dir):
    """Totals after four commits: all documents are inserted; the same batch arrives again and is not counted twice;
    counts of texts with licence lines are revised to those without; all but one of equal texts are deleted."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = token_rollup.Rollup(spark, scratch_path(spark, "token-rollup"))
    counts = token_rollup.token_counts(docs)
    inserted = token_rollup.changes(counts, token_rollup.INSERT)
    rollup.commit("001", inserted)
    rollup.commit("001", inserted)
    licensed = docs.where(F.contains("text", F.lit("Licensed under")))
    plain = licensed.withColumn("text", F.regexp_replace("text", r"Licensed under[^\n]*", ""))
    before = token_rollup.token_counts(licensed).withColumnRenamed("tokens", "old_tokens")
    after = token_rollup.token_counts(plain).select("doc_id", "tokenizer", "tokens")
    revised = after.join(before, ["doc_id", "tokenizer"])
    rollup.commit("002", token_rollup.changes(revised, token_rollup.REVISE, F.col("old_tokens")))
    copies = docs.withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    first = copies.where("h is not null").groupBy("h").agg(F.min("doc_id").alias("first"))
    extra = copies.join(first, "h").where("doc_id <> first")
    gone = token_rollup.token_counts(extra.withColumn("text", F.regexp_replace("text", r"Licensed under[^\n]*", "")))
    rollup.commit("003", token_rollup.changes(gone, token_rollup.DELETE))
    return rollup.totals()


@query
def op5_near_duplicates(spark, sf_dir):
    return near_dedup.near_components(_table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")) \
        .select("doc_id", "held_out", "score", "predicted")


@query
def op7_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path))
    return captures.select(
        warc.captured_id(F.col("capture.record_id")).alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.digest").alias("payload_digest"),
        F.col("capture.kind").alias("record_type"), warc.captured_id(F.col("capture.refers_to")).alias("refers_to"))


@query
def op8_decontamination(spark, sf_dir):
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query
def op9_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


@query
def op11_ngram_join(spark, sf_dir):
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), width=5, percent=80)


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@query
def op13_spelling(spark, sf_dir):
    return spelling.variants(_table(spark, sf_dir, "documents"))
