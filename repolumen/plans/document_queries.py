"""Queries on text preparation and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, extract, prep, text
from ..operators import documents, enrich, facts
from ..operators.unnest import unnest
from ..session import materialize
from ..sources import sinks
from . import inputs
from .answers import addresses, answered, stored_bundles
from .registry import query

KEY = ["repo", "file_path"]


def bar(column):
    return F.array_join(column, "|")


# --- text preparation --------------------------------------------------------------------------


def _lines(spark, sf, profile="detailed"):
    return facts.select_files(inputs.corpus(spark, sf), profile).withColumn("lines", text.lines_of(F.col("content")))


def _context_rows(spark, sf):
    staged = _lines(spark, sf).withColumn("endpoints", extract.detailed_endpoints(F.col("content"), F.col("language")))
    return staged.select(*KEY, "language", "endpoints", prep.extract_context(
        F.col("lines"), F.col("language"), F.col("endpoints")).alias("context"))


@query("truncate_70_30")
def _(spark, sf):
    rows = inputs.corpus(spark, sf)
    return rows.select(*KEY, prep.truncate_ends(F.col("content"), 60).alias("shortened"))


@query("reduce_80_10")
def _(spark, sf):
    return _lines(spark, sf).select(*KEY, prep.reduce_text(F.col("content"), F.col("lines")).alias("reduced"))


@query("extract_context")
def _(spark, sf):
    return _context_rows(spark, sf).select(*KEY, "context")


@query("parse_response")
def _(spark, sf):
    parsed = prep.parse_response(F.col("file_path"), F.col("response"))
    rows = inputs.responses(spark, sf).select(*KEY, parsed.alias("r"))
    return rows.select(*KEY, "r.summary", bar(F.col("r.insights")).alias("insights"))


@query("parse_wait_time")
def _(spark, sf):
    return inputs.errors(spark, sf).select("event_id", F.round(prep.wait_seconds(F.col("message")), 6).alias("seconds"))


@query("parse_key_list")
def _(spark, sf):
    return unnest(inputs.key_lists(spark, sf), ["doc_id"], prep.key_list(F.col("keys")), "key", "at")


# --- prompts ---------------------------------------------------------------------------------------


def _prompt(rows, prompt):
    return rows.select(*KEY, prompt.alias("prompt")).withColumn(
        "est_tokens", F.floor(F.length("prompt") / 4).cast("long") + 100)


def _stated(spark, sf, profile="enhanced"):
    rows = materialize(facts.file_bundles(inputs.corpus(spark, sf), profile), "bundles")
    return rows.where((F.col("function_count") > 0) | (F.col("api_count") > 0))


@query("build_prompt_comprehensive")
def _(spark, sf):
    return _prompt(_stated(spark, sf), prep.comprehensive_prompt())


@query("build_prompt_concise")
def _(spark, sf):
    return _prompt(_stated(spark, sf), prep.concise_prompt())


@query("build_prompt_fast")
def _(spark, sf):
    return _prompt(_stated(spark, sf, "fast").where("is_backend"), prep.fast_prompt())


@query("build_prompt_preview")
def _(spark, sf):
    return _prompt(facts.core_facts(inputs.corpus(spark, sf)), prep.preview_prompt())


@query("build_prompt_typed")
def _(spark, sf):
    rows = facts.detailed_facts(inputs.corpus(spark, sf), with_context=True)
    kind = classify.prompt_file_type(F.col("file_path"), F.size("endpoints"))
    staged = rows.withColumn("lines", text.lines_of(F.col("context")))
    return _prompt(staged, prep.typed_prompt(prep.reduce_text(F.col("context"), F.col("lines")), kind))


def stub(prompt: str) -> str:
    """Deterministic stand-in for a user's function; fails on some prompts on purpose."""
    if "/chat_" in prompt:
        raise ValueError("refused")
    return f"SUMMARY: {len(prompt)} characters"


@query("enrich")
def _(spark, sf):
    prompts = _stated(spark, sf).select(*KEY, prep.concise_prompt().alias("prompt"))
    return enrich.enrich(prompts, stub)


# --- documents -----------------------------------------------------------------------------------------


def _stored_facts(spark, sf):
    return materialize(facts.file_facts(inputs.corpus(spark, sf)), "facts")


def _content(sections):
    return documents.assemble(sections).select("repo", "doc_name", "sec", "part", "content")


@query("doc_readme")
def _(spark, sf):
    return _content(documents.readme_document(stored_bundles(spark, sf, "funcs")))


@query("doc_api")
def _(spark, sf):
    return _content(documents.api_document(stored_bundles(spark, sf, "funcs")))


@query("doc_functions")
def _(spark, sf):
    return _content(documents.function_document(stored_bundles(spark, sf, "apis")))


@query("doc_architecture")
def _(spark, sf):
    return _content(documents.architecture_document(_stored_facts(spark, sf)))


@query("doc_project_summary")
def _(spark, sf):
    return _content(documents.project_summary_document(_stored_facts(spark, sf)))


@query("doc_setup")
def _(spark, sf):
    return _content(documents.setup_document(facts.file_facts(inputs.corpus(spark, sf))))


@query("doc_setup_core")
def _(spark, sf):
    """Set-up steps by the core profile, which knows Java."""
    files = inputs.corpus(spark, sf).where(F.col("repo") < "repo2").unionByName(inputs.java_corpus(spark, sf))
    return _content(documents.setup_document(facts.core_facts(files)))


@query("doc_per_file")
def _(spark, sf):
    return documents.file_documents(answered(spark, sf)[1])


@query("doc_insights")
def _(spark, sf):
    return _content(documents.insight_document(*answered(spark, sf)))


@query("doc_answers")
def _(spark, sf):
    return _content(documents.answer_document(*answered(spark, sf)))


@query("answers")
def _(spark, sf):
    return answered(spark, sf)[1].withColumn("insights", bar("insights"))


@query("result_json")
def _(spark, sf):
    bundles, answers = answered(spark, sf)
    return documents.result_json(bundles, answers, addresses(bundles))


@query("list_documents")
def _(spark, sf):
    rows = _stored_facts(spark, sf)
    sections = documents.architecture_document(rows).unionByName(documents.setup_document(rows))
    return sinks.list_documents(documents.assemble(sections))
