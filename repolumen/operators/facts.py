"""Fact tables: one narrow pass over the corpus per table, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify, extract, paths, prep, rules, text
from ..functions.symbols import python_symbols
from .unnest import unnest


def select_files(files: DataFrame, profile: str = "enhanced", max_chars: int | None = None) -> DataFrame:
    """Files the profile analyses, with ``language``: directory and extension filters, and a size limit
    (``rules.MAX_CHARS`` has the published ones) only if the caller passes one."""
    path = F.col("file_path")
    kept = (files.where(~paths.in_skipped_dir(path, profile))
            .withColumn("language", paths.language_of(path, profile)).where(F.col("language").isNotNull()))
    return kept if max_chars is None else kept.where(F.char_length("content") <= max_chars)


def file_facts(files: DataFrame, profile: str = "enhanced") -> DataFrame:
    """One row per analysed file. Counting reads the text as a whole; nothing is split or exploded."""
    c, path, language = F.col("content"), F.col("file_path"), F.col("language")
    low, stop = F.col("lowered"), F.col("stop")
    measured = (
        select_files(files, profile)
        .withColumn("lowered", F.lower(c))
        .withColumn("stop", extract.page_stop(c, low, language, path))
        .select("repo", "file_path", "language", "lowered",
                text.lines_of_code(c).alias("lines_of_code"),
                extract.endpoint_count(c, low, language, stop).alias("api_count"),
                extract.function_count(c, language, stop).alias("function_count"),
                extract.dependencies(c, language).alias("dependencies")))
    api, fn = F.col("api_count"), F.col("function_count")
    return measured.select(
        "repo", "file_path", "language", "lines_of_code", "api_count", "function_count", "dependencies",
        classify.is_backend(path, low, api).alias("is_backend"),
        classify.file_purpose(path, low, api, fn).alias("file_purpose"))


def _with_lines(files: DataFrame, profile: str) -> DataFrame:
    return select_files(files, profile).select("repo", "file_path", "language",
                                               text.lines_of(F.col("content")).alias("lines"))


def endpoints(files: DataFrame, profile: str = "enhanced") -> DataFrame:
    """One row per endpoint of the four line-based frameworks."""
    language, path, lines = F.col("language"), F.col("file_path"), F.col("lines")
    found = _with_lines(files, profile).select(
        "repo", "file_path", "language", extract.endpoint_anchors(lines, language).alias("found"))
    stopped = found.withColumn("stop", extract.stop_position(F.col("found"), language, path))
    lines_read = unnest(stopped, ["repo", "file_path", "language", "stop"], "found", "a") \
        .where(F.col("stop").isNull() | (F.col("a.pos") <= F.col("stop")))
    is_stop = F.coalesce(F.col("a.pos") == F.col("stop"), F.lit(False))
    rows = unnest(lines_read, ["repo", "file_path", "language", (F.col("a.pos") + 1).alias("line")],
                  extract.endpoint_rows(F.col("a.text"), F.col("a.ahead"), language, path, is_stop, profile), "e", "ord")
    return rows.select("repo", "file_path", "language", "line", "ord", "e.*")


def functions(files: DataFrame, profile: str = "enhanced") -> DataFrame:
    """One row per function definition line."""
    language, path, lines = F.col("language"), F.col("file_path"), F.col("lines")
    found = _with_lines(files, profile).select(
        "repo", "file_path", "language", extract.function_anchors(lines, language).alias("found"))
    stopped = found.withColumn("stop", extract.stop_position(F.col("found"), language, path))
    rows = unnest(stopped, ["repo", "file_path", "language", "stop"], "found", "a").where(
        (F.col("stop").isNull() | (F.col("a.pos") < F.col("stop")))
        & (extract.is_py(language) | F.col("a.text").rlike(rules.JS_FUNCTION)))
    fields = extract.function_fields(F.col("a.text"), F.col("a.before"), F.col("a.ahead"), language, profile)
    return rows.select("repo", "file_path", "language", (F.col("a.pos") + 1).alias("line"),
                       *[column.alias(name) for name, column in fields.items()])


def file_bundles(files: DataFrame, profile: str = "enhanced", code: bool = True) -> DataFrame:
    """``file_facts`` plus the file's endpoints (``apis``) and functions (``funcs``) as arrays.

    Built inside the row, so per-file documents and prompts need no shuffle. Counts come from the
    whole text, so a job that drops one of the arrays never builds it; ``code=False`` leaves
    the code snippets out, which are most of the arrays' size.
    """
    c, path, language, lines = F.col("content"), F.col("file_path"), F.col("language"), F.col("lines")
    low, stop_at = F.col("lowered"), F.col("stop_at")
    staged = (
        select_files(files, profile).withColumn("lowered", F.lower(c))
        .withColumn("stop_at", extract.page_stop(c, low, language, path))
        .select("repo", "file_path", "language", "lowered", text.lines_of_code(c).alias("lines_of_code"),
                extract.endpoint_count(c, low, language, stop_at).alias("api_count"),
                extract.function_count(c, language, stop_at).alias("function_count"),
                extract.dependencies(c, language).alias("dependencies"), text.lines_of(c).alias("lines")))
    facts = ["repo", "file_path", "language", "lines_of_code", "api_count", "function_count", "dependencies", "lowered"]
    found = staged.select(
        *facts, extract.endpoint_anchors(lines, language).alias("e_found"),
        extract.function_anchors(lines, language).alias("f_found"))
    stop = F.col("stop")

    def apis_at(a):
        is_stop = F.coalesce(a["pos"] == stop, F.lit(False))
        rows = extract.endpoint_rows(a["text"], a["ahead"], language, path, is_stop, profile, code)
        return F.transform(rows, lambda e: F.struct(
            (a["pos"] + 1).alias("line"), e["framework"].alias("framework"), e["method"].alias("method"),
            e["path"].alias("path"), e["function_name"].alias("function_name"),
            e["code_snippet"].alias("code_snippet"), e["parameters"].alias("parameters"),
            e["description"].alias("description")))

    def function_at(a):
        fields = extract.function_fields(a["text"], a["before"], a["ahead"], language, profile, code)
        return F.struct((a["pos"] + 1).alias("line"), *[col.alias(name) for name, col in fields.items()])

    read = F.filter("e_found", lambda a: stop.isNull() | (a["pos"] <= stop))
    defined = F.filter("f_found", lambda a: (stop.isNull() | (a["pos"] < stop))
                       & (extract.is_py(language) | a["text"].rlike(rules.JS_FUNCTION)))
    arrays = found.withColumn("stop", extract.stop_position(F.col("e_found"), language, path)).select(
        *facts, F.flatten(F.transform(read, apis_at)).alias("apis"), F.transform(defined, function_at).alias("funcs"))
    api, fn = F.col("api_count"), F.col("function_count")
    return arrays.select(
        "repo", "file_path", "language", "lines_of_code", "dependencies", "api_count", "function_count",
        classify.is_backend(path, low, api).alias("is_backend"),
        classify.file_purpose(path, low, api, fn).alias("file_purpose"), "apis", "funcs")


def env_vars(files: DataFrame) -> DataFrame:
    """Environment variables per file: the first read of each name in pattern order."""
    found = select_files(files, "detailed").select(
        "repo", "file_path", extract.by_name(extract.env_vars(F.col("content"))).alias("found"))
    rows = unnest(found, ["repo", "file_path"], extract.first_by_name(F.col("found")), "v")
    return rows.select("repo", "file_path", "v.line", "v.name")


def core_facts(files: DataFrame) -> DataFrame:
    """File facts of the core profile."""
    c, path, language = F.col("content"), F.col("file_path"), F.col("language")
    staged = select_files(files, "core").withColumn("lowered", F.lower(c))
    return staged.select(
        "repo", "file_path", "language", text.lines_of_code(c).alias("lines_of_code"),
        F.size(extract.core_endpoints(c)).alias("api_count"),
        extract.core_function_count(c, language).alias("function_count"),
        classify.is_backend(path, F.col("lowered"), profile="core").alias("is_backend"),
        classify.file_purpose_core(path, F.col("lowered")).alias("file_purpose"),
        extract.dependencies(c, language, "core").alias("dependencies"),
        F.substring(c, 1, rules.PREVIEW_CHARS).alias("content_preview"))


def detailed_facts(files: DataFrame, with_context: bool = False) -> DataFrame:
    """File facts of the detailed profile with symbol arrays.

    JavaScript symbols are column expressions; only Python text goes to the syntax-tree
    worker, and the worker returns the symbols without the text. ``with_context`` adds the
    shortened text that prompts are built from.
    """
    c, path, language = F.col("content"), F.col("file_path"), F.col("language")
    script = language.isin("javascript", "jsx", "typescript", "tsx")
    none = F.array().cast
    py = F.col("py")
    staged = (select_files(files, "detailed").withColumn("lowered", F.lower(c))
              .withColumn("py", python_symbols(F.when(extract.is_py(language), c))))
    js_functions = F.transform(extract.detailed_js_functions(c), lambda f: F.struct(
        f["line"].alias("line"), f["name"].alias("name"), none("array<string>").alias("params"), f["is_async"].alias("is_async")))
    # a syntax tree lists plain definitions only
    py_functions = F.transform(py["functions"], lambda f: F.struct(
        f["line"].alias("line"), f["name"].alias("name"), f["params"].alias("params"), F.lit(False).alias("is_async")))
    js_classes = F.transform(text.located_matches(c, rules.CLASS_NAME, c.contains("class"), name=1), lambda k: F.struct(
        k["line"].alias("line"), k["name"].alias("name"), none("array<string>").alias("methods")))
    js_imports = text.located_matches(c, rules.JS_IMPORT_BLOCK, c.contains("import"), source=1)
    symbols = staged.select(
        "repo", "file_path", "language", text.lines_of_code(c).alias("lines_of_code"), "lowered",
        F.when(script, js_functions).otherwise(py_functions).alias("functions"),
        F.when(script, js_classes).otherwise(py["classes"]).alias("classes"),
        F.when(script, js_imports).otherwise(py["imports"]).alias("imports"),
        (script | py["parsed"]).alias("parsed"),
        F.when(script, extract.jsx_components(c)).otherwise(none("array<string>")).alias("jsx_components"),
        extract.detailed_endpoints(c, language).alias("endpoints"),
        *([text.lines_of(c).alias("lines")] if with_context else []))
    low = F.col("lowered")
    context = [prep.extract_context(F.col("lines"), language, F.col("endpoints")).alias("context")] if with_context else []
    py_deps = F.transform(F.filter("imports", lambda i: ~i["source"].startswith(".")),
                          lambda i: F.substring_index(i["source"], ".", 1))
    js_deps = F.transform(F.filter("imports", lambda i: extract.external(i["source"])),
                          lambda i: extract.top_name(i["source"]))
    return symbols.select(
        "repo", "file_path", "language", "lines_of_code", "functions", "classes", "imports", "parsed", "jsx_components",
        "endpoints", F.array_sort(F.array_distinct(F.when(script, js_deps).otherwise(py_deps))).alias("dependencies"),
        classify.service_info(path, low).alias("service_info"),
        classify.integration_points(low).alias("integration_points"),
        classify.file_purpose_detailed(path, F.size("endpoints"), F.size("jsx_components"), F.size("classes"),
                                       F.size("functions")).alias("file_purpose"), *context)
