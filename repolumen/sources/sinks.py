"""Sinks for results and documents, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import write_files


def write_results_json(results: DataFrame, path: str) -> None:
    """JSON lines in one folder per repository; ``results`` comes from ``result_json``."""
    results.repartitionByRange("repo", "part").sortWithinPartitions("repo", "part") \
        .select("repo", "json").write.partitionBy("repo").text(path)


def _named(documents: DataFrame):
    """Rows of a document's file. ``documents`` has sections (``sec, part``) or one row per document."""
    order = [F.col(c) for c in ("sec", "part") if c in documents.columns]
    return documents.select(F.concat_ws("/", "repo", "doc_name").alias("file"), *order, F.lit(None).cast("string").alias("member"),
                            "content")


def write_documents(documents: DataFrame, path: str) -> None:
    """One file ``repo/doc_name`` per document, its rows one after the other in ``(sec, part)`` order. Documents per
    file (``documents.file_documents``) go to ``repo/files``, and of those that share a name to a file of their path."""
    if "sharing" in documents.columns:
        own = F.when(F.col("sharing") > 1, F.concat(F.regexp_replace("file_path", "[^A-Za-z0-9.-]", "~"), F.lit(".md"))) \
            .otherwise(F.col("doc_name"))
        documents = documents.select("repo", F.concat(F.lit("files/"), own).alias("doc_name"), "content")
    write_files(_named(documents), path)


def list_documents(documents: DataFrame) -> DataFrame:
    return documents.groupBy("repo", "doc_name").agg(F.sum(F.length("content")).alias("size")) \
        .withColumn("path", F.concat_ws("/", "repo", "doc_name"))


def read_document(documents: DataFrame, repo: str, doc_name: str) -> DataFrame:
    return documents.where((F.col("repo") == repo) & (F.col("doc_name") == doc_name)) \
        .orderBy("sec", "part").select("content")


def write_bundles(documents: DataFrame, path: str, archives: int = 1) -> None:
    """Zip archives ``repo.zip`` (``repo-0.zip`` and so on if there are several), with a member per document.

    Documents are dealt to the ``archives`` of a repository by name. Members are written as they come, section by
    section, so a task holds no archive and no document.
    """
    number = F.pmod(F.xxhash64("doc_name"), F.lit(archives)).cast("string")
    name = F.col("repo") if archives == 1 else F.concat_ws("-", "repo", number)
    order = [c for c in ("sec", "part") if c in documents.columns]
    write_files(documents.select(F.concat(name, F.lit(".zip")).alias("file"), "doc_name", *order,
                                 F.col("doc_name").alias("member"), "content"), path, zipped=True)
