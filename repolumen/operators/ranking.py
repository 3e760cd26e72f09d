"""Scores, top-k lists and latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, rules
from .ordering import ordinal
from .rollup import first_k


def scored(facts: DataFrame) -> DataFrame:
    return facts.withColumn("score", classify.importance_score(
        F.col("file_path"), F.col("api_count"), F.col("function_count"), F.col("is_backend")))


def top_files(facts: DataFrame, k: int = 5) -> DataFrame:
    return first_k(scored(facts), ["repo"], [F.desc("score"), "file_path"], k)


def first_n_and_more(facts: DataFrame, word: str, n: int = 3) -> DataFrame:
    """First ``n`` frontend files whose path has ``word``, each with the number left out."""
    chosen = facts.where(~F.col("is_backend") & F.lower("file_path").contains(word)).select("repo", "file_path")
    counts = chosen.groupBy("repo").agg(F.count("*").alias("total"))
    return first_k(chosen, ["repo"], ["file_path"], n).join(counts, "repo") \
        .withColumn("more", F.greatest(F.col("total") - n, F.lit(0)))


def backend_top_n(facts: DataFrame, n: int) -> DataFrame:
    return first_k(facts.where("is_backend"), ["repo"], ["file_path"], n)


def service_ports(facts: DataFrame, base: int = 5000) -> DataFrame:
    """Port by position among the repository's backend files."""
    backend = facts.where("is_backend").select("repo", "file_path", "language", "api_count")
    return ordinal(backend, ["repo"], ["file_path"], "at", "ports") \
        .withColumn("port", F.col("at") + base).drop("at")


def keep_latest(outputs: DataFrame, k: int = rules.KEEP_OUTPUTS) -> DataFrame:
    """Newest ``k`` output sets per repository by the number that ends their name."""
    stamp = F.substring_index("name", "_", -1).try_cast("long")
    dated = outputs.where(F.col("name").startswith("docs_")).withColumn("stamp", stamp)
    return first_k(dated.where(F.col("stamp").isNotNull()), ["repo"], [F.desc("stamp"), F.desc("name")], k)


def latest_status(jobs: DataFrame) -> DataFrame:
    """Current state per analysis: an aggregate, not a sort of its history."""
    last = jobs.groupBy("analysis_id").agg(F.max(F.struct("created_at", "event_id", "status")).alias("last"))
    return last.select("analysis_id", "last.status", "last.created_at",
                       (F.col("last.status") == "completed").alias("has_results"))


def retained(jobs: DataFrame, now, hours: int = rules.RETENTION_HOURS) -> DataFrame:
    return jobs.where(F.col("created_at") >= now - F.make_interval(hours=F.lit(hours)))
