"""Sources and sinks as round trips: given tables are written to the shared folder as files and read back from there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import documents, facts
from ..session import materialize, scratch_path
from ..sources import corpus, sinks
from ..sources.files import write_files
from . import inputs
from .answers import addresses, answered
from .registry import query


def _members(spark, sf, file, member) -> DataFrame:
    return inputs.corpus(spark, sf).select(file.alias("file"), F.col("file_path").alias("path"), member.alias("member"), "content")


def _seen(files: DataFrame) -> DataFrame:
    return files.select("repo", "file_path", F.length("content").alias("chars"), F.sha2("content", 256).alias("sha256"))


def _texts(spark, path: str, depth: int) -> DataFrame:
    """Files below ``path`` with their names relative to it."""
    return corpus.read_texts(spark, path, ".md").select(F.substring_index("path", "/", -depth).alias("path"), "content")


@query("scan_corpus")
def _(spark, sf):
    """The corpus as a tree on disk, walked and read."""
    root = scratch_path(spark, "tree")
    write_files(_members(spark, sf, F.concat_ws("/", "repo", "file_path"), F.lit(None).cast("string")), root)
    return _seen(corpus.scan_corpus(spark, root))


@query("scan_zip")
def _(spark, sf):
    """The corpus as an archive per repository, read member by member."""
    root = scratch_path(spark, "zips")
    write_files(_members(spark, sf, F.concat("repo", F.lit(".zip")), F.col("file_path")), root, zipped=True)
    return _seen(corpus.scan_zip(spark, root))


@query("write_documents")
def _(spark, sf):
    rows = materialize(facts.file_facts(inputs.corpus(spark, sf)), "facts")
    path = scratch_path(spark, "documents")
    sections = documents.architecture_document(rows).unionByName(documents.setup_document(rows))
    sinks.write_documents(documents.assemble(sections), path)
    return _texts(spark, path, 2)


@query("write_file_documents")
def _(spark, sf):
    path = scratch_path(spark, "file-documents")
    sinks.write_documents(documents.file_documents(answered(spark, sf)[1]), path)
    return _texts(spark, path, 3)


@query("write_bundles")
def _(spark, sf):
    """Archives of the documents, and what their members hold."""
    rows = materialize(facts.file_facts(inputs.corpus(spark, sf)), "facts")
    path = scratch_path(spark, "bundles")
    sections = documents.architecture_document(rows).unionByName(documents.setup_document(rows))
    sinks.write_bundles(documents.assemble(sections), path)
    return corpus.scan_zip(spark, path).select(F.concat_ws("/", "repo", "file_path").alias("path"), "content")


@query("write_results_json")
def _(spark, sf):
    bundles, answers = answered(spark, sf)
    path = scratch_path(spark, "results")
    sinks.write_results_json(documents.result_json(bundles, answers, addresses(bundles)), path)
    return spark.read.option("lineSep", "\n").text(path).select(F.col("repo").cast("string").alias("repo"), F.col("value").alias("json"))
