"""Queries on single files: selection, extraction and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, extract, paths, rules, text
from ..operators import facts
from ..operators.unnest import unnest
from ..session import materialize
from ..sources.corpus import scan_table
from . import inputs
from .registry import query



def content():
    return F.col("content")


def path():
    return F.col("file_path")


def language():
    return F.col("language")


KEY = ["repo", "file_path"]


def bar(array):
    return F.array_join(array, "|")


def _stored_facts(spark, sf):
    """Facts that are filtered by a computed column are stored first, so the filter reads parquet
    instead of repeating the extraction below the projection."""
    return materialize(facts.file_facts(inputs.corpus(spark, sf)), "facts")


# --- scans, filters, projections ------------------------------------------------------------


@query("scan_table")
def _(spark, sf):
    return scan_table(inputs.corpus(spark, sf)).select(*KEY, F.length("content").alias("chars"))


@query("skip_dirs")
def _(spark, sf):
    tests = [paths.in_skipped_dir(path(), p).alias(f"skip_{p}") for p in ("enhanced", "detailed", "core")]
    return inputs.corpus(spark, sf).select(*KEY, *tests)


@query("supported_language")
def _(spark, sf):
    files = inputs.corpus(spark, sf)
    return files.withColumn("language", paths.language_of(path(), "enhanced")) \
        .where(F.col("language").isNotNull()).select(*KEY, "language")


@query("max_chars")
def _(spark, sf):
    return inputs.corpus(spark, sf).where(F.char_length("content") <= rules.MAX_CHARS["fast"]) \
        .select(*KEY, F.char_length("content").alias("chars"))


@query("is_backend")
def _(spark, sf):
    return facts.file_facts(inputs.corpus(spark, sf)).select(*KEY, "is_backend")


@query("is_backend_core")
def _(spark, sf):
    return facts.select_files(inputs.corpus(spark, sf), "core") \
        .select(*KEY, classify.is_backend(path(), F.lower("content"), profile="core").alias("is_backend"))


@query("llm_eligible")
def _(spark, sf):
    return _stored_facts(spark, sf).where((F.col("function_count") > 0) | (F.col("api_count") > 0)).select(*KEY)


@query("llm_eligible_optimized")
def _(spark, sf):
    rows = materialize(facts.detailed_facts(inputs.corpus(spark, sf)), "detailed")
    return rows.where(classify.eligible_optimized(
        path(), F.col("service_info.type"), F.size("functions"), F.size("endpoints"), F.size("classes"))).select(*KEY)


@query("frontend_files")
def _(spark, sf):
    return _stored_facts(spark, sf).where(~F.col("is_backend")).select(*KEY, "language")


@query("external_only")
def _(spark, sf):
    files = facts.select_files(inputs.corpus(spark, sf)).where(extract.is_js(language()))
    sources = unnest(files, KEY, text.group_per_line(content(), rules.JS_IMPORT, 1), "source")
    return sources.where(extract.external(F.col("source"))).select(*KEY, "source")


@query("exclude_stdlib")
def _(spark, sf):
    files = facts.select_files(inputs.corpus(spark, sf)).where(extract.is_py(language()))
    names = unnest(files, KEY, text.group_per_line(content(), rules.PY_IMPORT, 1), "dep")
    return names.where(~F.col("dep").isin(rules.PY_SKIP_DEPS["enhanced"])).select(*KEY, "dep")


@query("detect_language")
def _(spark, sf):
    return inputs.corpus(spark, sf).select(
        *KEY, *[paths.language_of(path(), p).alias(f"language_{p}") for p in ("enhanced", "detailed", "core")])


@query("lines_of_code")
def _(spark, sf):
    return inputs.corpus(spark, sf).select(*KEY, text.lines_of_code(content()).alias("lines_of_code"))


@query("explode_lines")
def _(spark, sf):
    lines = unnest(facts.select_files(inputs.corpus(spark, sf)), KEY, text.lines_of(content()), "text", "p")
    return lines.select(*KEY, (F.col("p") + 1).alias("line"), "text")


@query("content_preview")
def _(spark, sf):
    return facts.select_files(inputs.corpus(spark, sf), "core").select(
        *KEY, F.substring("content", 1, rules.PREVIEW_CHARS).alias("preview"),
        F.substring("content", 1, rules.PROMPT_PREVIEW_CHARS).alias("prompt_preview"))


@query("code_snippet")
def _(spark, sf):
    files = inputs.corpus(spark, sf)
    rows = [facts.endpoints(files, p).select(*KEY, "line", F.lit(p).alias("profile"), "framework", "code_snippet")
            for p in ("enhanced", "fast")]
    return rows[0].unionByName(rows[1])


@query("split_path")
def _(spark, sf):
    return inputs.corpus(spark, sf).select(
        *KEY, paths.folder_of(path()).alias("folder"), paths.file_name(path()).alias("name"),
        paths.stem(path()).alias("stem"), paths.extension(path()).alias("extension"))


@query("parse_repo_url")
def _(spark, sf):
    url = F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, ".git").otherwise(""))
    info, core = paths.repo_info(F.col("address")), paths.repo_info(F.col("address"), "core")
    return inputs.table(spark, sf, "pages").select("page_id", url.alias("address")).select(
        "page_id", info["owner"].alias("owner"), info["name"].alias("name"),
        core["owner"].alias("core_owner"), core["name"].alias("core_name"))


# --- endpoints ---------------------------------------------------------------------------------


def _framework(name, columns):
    def run(spark, sf):
        rows = facts.endpoints(inputs.corpus(spark, sf)).where(F.col("framework") == name)
        return rows.select(*KEY, "line", *columns)
    return run


for _key, _columns in {"express": ["method", "path", "code_snippet"],
                       "nextjs": ["method", "path", "function_name"],
                       "flask": ["method", "path", "function_name"],
                       "fastapi": ["method", "path", "function_name"]}.items():
    query(f"{_key}_endpoints")(_framework(_key, _columns))


@query("detailed_endpoints")
def _(spark, sf):
    rows = unnest(facts.select_files(inputs.corpus(spark, sf), "detailed"), KEY, extract.detailed_endpoints(content(), language()), "e")
    return rows.select(*KEY, "e.line", "e.method", "e.path", "e.description", bar(F.transform(
        "e.parameters", lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string")))).alias("parameters"))


@query("core_endpoints")
def _(spark, sf):
    rows = unnest(facts.select_files(inputs.corpus(spark, sf), "core"), KEY, extract.core_endpoints(content()), "e")
    return rows.select(*KEY, "e.line", "e.method", "e.path", "e.framework")


@query("path_parameters")
def _(spark, sf):
    rows = unnest(facts.endpoints(inputs.corpus(spark, sf)), [*KEY, "line", "method"], "parameters", "p")
    return rows.select(*KEY, "line", "method", "p.name", "p.type", "p.required", "p.description")


@query("handler_association")
def _(spark, sf):
    return facts.endpoints(inputs.corpus(spark, sf)).where(F.col("framework").isin("flask", "fastapi")) \
        .select(*KEY, "line", "method", "path", "function_name")


@query("endpoint_description")
def _(spark, sf):
    return facts.endpoints(inputs.corpus(spark, sf)).select(*KEY, "line", "method", "description")


# --- functions ------------------------------------------------------------------------------------


@query("python_functions")
def _(spark, sf):
    return facts.functions(inputs.corpus(spark, sf)).where(extract.is_py(language())) \
        .select(*KEY, "line", "name", "code_snippet")


@query("js_functions")
def _(spark, sf):
    return facts.functions(inputs.corpus(spark, sf)).where(extract.is_js(language())) \
        .select(*KEY, "line", "name", "code_snippet")


@query("detailed_js_functions")
def _(spark, sf):
    files = facts.select_files(inputs.corpus(spark, sf), "detailed").where(~extract.is_py(language()))
    return unnest(files, KEY, extract.detailed_js_functions(content()), "f") \
        .select(*KEY, "f.line", "f.name", "f.is_async")


@query("java_functions")
def _(spark, sf):
    files = facts.select_files(inputs.java_corpus(spark, sf), "core").where(language() == "java")
    return unnest(files, KEY, extract.java_functions(content()), "f") \
        .select(*KEY, "f.line", "f.name", bar(F.col("f.params")).alias("params"))


@query("function_params")
def _(spark, sf):
    return facts.functions(inputs.corpus(spark, sf)).select(*KEY, "line", "name", bar(F.col("params")).alias("params"))


for _key, _column in {"function_docstring": "docstring", "function_return_type": "return_type",
                      "function_complexity": "complexity", "is_api_handler": "is_api_handler"}.items():
    query(_key)(lambda spark, sf, column=_column: facts.functions(inputs.corpus(spark, sf))
                .select(*KEY, "line", "name", column))


# --- dependencies and symbols ------------------------------------------------------------------------


@query("js_dependencies")
def _(spark, sf):
    return facts.select_files(inputs.corpus(spark, sf)).where(extract.is_js(language())) \
        .select(*KEY, bar(extract.js_dependencies(content())).alias("dependencies"))


@query("python_dependencies")
def _(spark, sf):
    return facts.select_files(inputs.corpus(spark, sf)).where(extract.is_py(language())).select(
        *KEY, bar(extract.python_dependencies(content())).alias("dependencies"),
        bar(extract.python_dependencies(content(), "core")).alias("core_dependencies"))


@query("java_dependencies")
def _(spark, sf):
    return facts.select_files(inputs.java_corpus(spark, sf), "core").where(language() == "java") \
        .select(*KEY, bar(extract.java_dependencies(content())).alias("dependencies"))


def _script_files(spark, sf):
    return facts.select_files(inputs.corpus(spark, sf), "detailed").where(~extract.is_py(language()))


@query("classes")
def _(spark, sf):
    files = _script_files(spark, sf).unionByName(
        facts.select_files(inputs.java_corpus(spark, sf), "core").where(language() == "java"))
    rows = unnest(files, KEY, text.located_matches(content(), rules.CLASS_NAME, name=1), "k")
    return rows.select(*KEY, "k.line", "k.name")


@query("imports")
def _(spark, sf):
    rows = unnest(_script_files(spark, sf), KEY, text.located_matches(content(), rules.JS_IMPORT_BLOCK, source=1), "i")
    return rows.select(*KEY, "i.line", "i.source")


@query("jsx_components")
def _(spark, sf):
    return _script_files(spark, sf).select(*KEY, bar(extract.jsx_components(content())).alias("components"))


@query("python_symbols")
def _(spark, sf):
    rows = facts.detailed_facts(inputs.corpus(spark, sf)).where(extract.is_py(language()))
    return unnest(rows, KEY, "functions", "f") \
        .select(*KEY, "f.line", "f.name", bar(F.col("f.params")).alias("params"))


@query("python_classes")
def _(spark, sf):
    rows = facts.detailed_facts(inputs.corpus(spark, sf)).where(extract.is_py(language()))
    return unnest(rows, KEY, "classes", "c").select(*KEY, "c.line", "c.name", bar(F.col("c.methods")).alias("methods"))


@query("python_imports")
def _(spark, sf):
    rows = facts.detailed_facts(inputs.corpus(spark, sf)).where(extract.is_py(language()))
    return unnest(rows, KEY, "imports", "i").select(*KEY, "i.line", "i.source")


@query("python_unparsed")
def _(spark, sf):
    rows = facts.detailed_facts(inputs.corpus(spark, sf)).where(extract.is_py(language()))
    return rows.groupBy("repo").agg(F.count("*").alias("files"), F.count_if(~F.col("parsed")).alias("unparsed"))


@query("env_vars")
def _(spark, sf):
    return facts.env_vars(inputs.corpus(spark, sf))


def _lowered(spark, sf):
    return facts.select_files(inputs.corpus(spark, sf), "detailed").select(*KEY, F.lower("content").alias("lowered"))


@query("service_type")
def _(spark, sf):
    low = F.col("lowered")
    return _lowered(spark, sf).select(*KEY, classify.service_type(low).alias("type"),
                                      classify.service_framework(path(), low).alias("framework"))


@query("service_port")
def _(spark, sf):
    return _lowered(spark, sf).select(*KEY, classify.service_port(F.col("lowered")).alias("port"))


@query("integration_points")
def _(spark, sf):
    return _lowered(spark, sf).select(*KEY, bar(classify.integration_points(F.col("lowered"))).alias("points"))


# --- classification --------------------------------------------------------------------------------------


@query("file_purpose")
def _(spark, sf):
    return facts.file_facts(inputs.corpus(spark, sf)).select(*KEY, "file_purpose")


@query("file_purpose_detailed")
def _(spark, sf):
    return facts.detailed_facts(inputs.corpus(spark, sf)).select(*KEY, "file_purpose")


@query("file_purpose_core")
def _(spark, sf):
    return facts.select_files(inputs.corpus(spark, sf), "core").select(
        *KEY, classify.file_purpose_core(path(), F.lower("content")).alias("file_purpose"))


@query("file_category")
def _(spark, sf):
    rows = facts.detailed_facts(inputs.corpus(spark, sf))
    sizes = [F.size(c) for c in ("endpoints", "jsx_components", "classes", "functions")]
    return rows.select(*KEY, classify.file_category(F.col("file_purpose"), *sizes).alias("category"),
                       classify.file_category(F.lit(""), *sizes).alias("fallback"))


@query("prompt_file_type")
def _(spark, sf):
    return facts.detailed_facts(inputs.corpus(spark, sf)).select(
        *KEY, classify.prompt_file_type(path(), F.size("endpoints")).alias("file_type"))
