"""Fact extraction from source text as column expressions.

Two forms of the same rules exist on purpose. Counting works on the whole text in one
regex pass per pattern and never splits it into lines; listing works on the anchored
lines, because snippets, docstrings and handlers need the neighbouring lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .paths import stem
from .text import (anchors, contains_any, count_lines, group_per_line, in_line, joined, located_matches, strip)

PARAMETERS = "array<struct<name:string,type:string,required:boolean,description:string>>"
ENDPOINT = ("array<struct<framework:string,method:string,path:string,function_name:string,code_snippet:string,"
            f"parameters:{PARAMETERS},description:string>>")


def is_js(language: Column) -> Column:
    return language.isin("javascript", "typescript")


def is_py(language: Column) -> Column:
    return language == "python"


def serves_pages(path: Column) -> Column:
    """Paths in which an exported request handler counts as a page route."""
    return contains_any(F.lower(path), ["api", "pages"])


def path_parameters(path: Column, pattern: str) -> Column:
    names = F.regexp_extract_all(path, F.lit(pattern), F.lit(1))
    return F.transform(names, lambda p: F.struct(
        p.alias("name"), F.lit("path").alias("type"), F.lit(True).alias("required"),
        F.concat(F.lit("Path parameter "), p).alias("description")))


def flask_methods(text: Column) -> Column:
    """Methods of a route decorator as written; GET when none are given."""
    listed = F.regexp_extract(text, rules.FLASK, 2)
    return F.when(listed == "", F.array(F.lit("GET"))).otherwise(
        F.transform(F.split(listed, ","), lambda m: F.btrim(strip(m), F.lit("\"'"))))


def handler_name(ahead: Column) -> Column:
    """First function defined in the four lines after the decorator, else empty."""
    following = F.filter(F.slice(ahead, 2, 4), lambda line: line.rlike(rules.DEF_NAME))
    return F.coalesce(F.regexp_extract(F.try_element_at(following, F.lit(1)), rules.DEF_NAME, 1), F.lit(""))


def snippet(ahead: Column, n: int | None) -> Column:
    """The first ``n`` lines; empty for callers that need no code."""
    return F.lit("") if n is None else joined(F.slice(ahead, 1, n))


def snippet_sizes(profile: str, code: bool) -> dict:
    return rules.SNIPPET_LINES[profile] if code else dict.fromkeys(rules.SNIPPET_LINES[profile])


def endpoint_rows(text, ahead, language, path, is_stop, profile="enhanced", code=True) -> Column:
    """Endpoints declared on one anchored line (array of structs, possibly empty).

    ``is_stop`` marks the line of a file's first page handler, which stands for four
    methods and ends the reading of that file.
    """
    size = snippet_sizes(profile, code)
    none = F.array().cast(ENDPOINT)
    no_parameters = F.array().cast(PARAMETERS)

    def row(framework, method, route, function_name, lines, parameters, description):
        return F.struct(F.lit(framework).alias("framework"), method.alias("method"), route.alias("path"),
                        function_name.alias("function_name"), lines.alias("code_snippet"),
                        parameters.alias("parameters"), description.alias("description"))

    express_method = F.upper(F.regexp_extract(text, rules.EXPRESS, 2))
    express_path = F.regexp_extract(text, rules.EXPRESS, 3)
    express = F.array(row(
        "express", express_method, express_path, F.lit(""), snippet(ahead, size["express"]),
        path_parameters(express_path, rules.EXPRESS_PARAM),
        F.concat(F.lit("API endpoint for "), express_method, F.lit(" requests to "), express_path)))

    page_name = F.regexp_extract(text, rules.NEXTJS, 1)
    page_function = F.when(page_name == "", F.lit("handler")).otherwise(page_name)
    pages = F.transform(F.array(*[F.lit(m) for m in rules.NEXTJS_METHODS]), lambda m: row(
        "nextjs", m, F.concat(F.lit("/api/"), stem(path)), page_function, snippet(ahead, size["nextjs"]),
        no_parameters, F.concat(F.lit("Next.js API route handler for "), m, F.lit(" requests"))))

    flask_path = F.regexp_extract(text, rules.FLASK, 1)
    flask = F.transform(flask_methods(text), lambda m: row(
        "flask", F.upper(m), flask_path, handler_name(ahead), snippet(ahead, size["python_endpoint"]),
        path_parameters(flask_path, rules.FLASK_PARAM),
        F.concat(F.lit("Flask route for "), m, F.lit(" requests to "), flask_path)))

    fast_method = F.upper(F.regexp_extract(text, rules.FASTAPI, 1))
    fast_path = F.regexp_extract(text, rules.FASTAPI, 2)
    fastapi = F.array(row(
        "fastapi", fast_method, fast_path, handler_name(ahead), snippet(ahead, size["python_endpoint"]),
        no_parameters,
        F.concat(F.lit("FastAPI endpoint for "), fast_method, F.lit(" requests to "), fast_path)))

    js, py = is_js(language), is_py(language)
    return F.concat(
        F.when(js & text.rlike(rules.EXPRESS), express).otherwise(none),
        F.when(js & is_stop, pages).otherwise(none),
        F.when(py & text.rlike(rules.FLASK), flask).otherwise(none),
        F.when(py & text.rlike(rules.FASTAPI), fastapi).otherwise(none))


# Cheap literal tests that every text with a match passes; they keep regular expressions off other texts.


def has_def(text: Column) -> Column:
    return text.contains("def") & text.contains("(")


def has_js_function(text: Column) -> Column:
    return text.contains("function") | text.contains("=>")


def exports_handler(text: Column) -> Column:
    return text.contains("(") & F.lower(text).contains("export") & text.rlike(rules.NEXTJS)


def has_route(lowered: Column) -> Column:
    return lowered.contains("app.") | lowered.contains("router.")


def endpoint_anchors(lines, language, ahead=12) -> Column:
    def declares(t):
        route = t.contains(".") & t.rlike(rules.EXPRESS)
        decorated = t.contains("@") & (t.rlike(rules.FLASK) | t.rlike(rules.FASTAPI))
        return t.contains("(") & F.when(is_js(language), route | exports_handler(t)) \
            .when(is_py(language), decorated).otherwise(False)

    return anchors(lines, declares, 0, ahead)


def function_anchors(lines, language, ahead=20) -> Column:
    def defines(t):
        return F.when(is_js(language), (has_js_function(t) & t.rlike(rules.JS_FUNCTION)) | exports_handler(t)) \
            .when(is_py(language), has_def(t) & t.rlike(rules.PY_FUNCTION)).otherwise(False)

    return anchors(lines, defines, 3, ahead)


def stop_position(found: Column, language: Column, path: Column) -> Column:
    """Line index of the first page handler among the anchors, or null."""
    stops = F.filter(found, lambda a: a["text"].rlike(rules.NEXTJS))
    first = F.array_min(F.transform(stops, lambda a: a["pos"]))
    return F.when(is_js(language) & serves_pages(path), first)


def function_fields(text, before, ahead, language, profile="enhanced", code=True) -> dict[str, Column]:
    """Columns of a function from its anchored line."""
    size = snippet_sizes(profile, code)
    py = is_py(language)
    js_first, js_second = F.regexp_extract(text, rules.JS_FUNCTION, 1), F.regexp_extract(text, rules.JS_FUNCTION, 2)
    lowered = F.lower(text)
    return {
        "name": F.when(py, F.regexp_extract(text, rules.PY_FUNCTION, 1))
        .when(js_first != "", js_first).otherwise(js_second),
        "params": function_params(text, py),
        "code_snippet": F.when(py, snippet(ahead, size["python_function"]))
        .otherwise(snippet(ahead, size["js_function"])),
        "is_api_handler": F.when(py, contains_any(lowered, ["request", "response", "req", "res"]))
        .otherwise(text.contains("req") & text.contains("res")),
        "return_type": F.when(py, strip(F.regexp_extract(text, rules.PY_RETURN, 1))).otherwise(F.lit("")),
        "docstring": F.when(py, python_docstring(ahead)).otherwise(js_comment(before)),
        "complexity": complexity(ahead),
    }


def function_params(text: Column, py: Column) -> Column:
    js_list = strip(F.regexp_extract(text, rules.JS_PARENS, 1))
    js = F.when(js_list == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(js_list, ","), lambda p: strip(F.substring_index(strip(p), "=", 1))))
    py_list = F.split(F.regexp_extract(text, rules.PY_FUNCTION, 2), ",")
    return F.when(py, F.transform(F.filter(py_list, lambda p: strip(p) != ""),
                                  lambda p: strip(F.substring_index(strip(p), ":", 1)))).otherwise(js)


def js_comment(before: Column) -> Column:
    kept = F.filter(F.transform(before, strip), lambda s: s.startswith("//") | s.startswith("/*"))
    return strip(F.array_join(kept, " "))


def python_docstring(ahead: Column) -> Column:
    """Quoted lines right below the definition: one line, or the opening and closing ones."""
    quotes = '"""'
    first = F.try_element_at(ahead, F.lit(2))
    count = (F.length(first) - F.length(F.replace(first, F.lit(quotes), F.lit("")))) / 3
    closing = F.try_element_at(F.filter(F.slice(ahead, 3, 8), lambda s: s.contains(quotes)), F.lit(1))
    both = strip(F.concat_ws(" ", strip(first), strip(closing)))
    return F.when(~first.contains(quotes) | first.isNull(), F.lit("")).when(count == 2, strip(first)).otherwise(both)


def complexity(ahead: Column) -> Column:
    words = F.regexp_count(joined(F.slice(ahead, 1, 20)), F.lit(rules.COMPLEXITY_WORD))
    return F.when(words <= 2, "Low").when(words <= 5, "Medium").otherwise("High")


# --- counts over the whole text --------------------------------------------------------------


def page_stop(content: Column, lowered: Column, language: Column, path: Column) -> Column:
    """Character position (from 1) of the first page handler, 0 when there is none."""
    return F.when(is_js(language) & serves_pages(path) & lowered.contains("export"),
                  F.regexp_instr(content, F.lit(in_line(rules.NEXTJS)))).otherwise(F.lit(0))


def endpoint_count(content: Column, lowered: Column, language: Column, stop: Column) -> Column:
    """Number of endpoints; a route with several methods counts once per method."""
    line_end = F.call_function("locate", F.lit("\n"), content, stop)
    readable = F.when((stop > 0) & (line_end > 0), F.substring(content, F.lit(1), line_end)).otherwise(content)
    js = count_lines(readable, rules.EXPRESS, has_route(lowered)) + F.when(stop > 0, F.lit(len(rules.NEXTJS_METHODS))).otherwise(0)
    decorated = lowered.contains("@app.") | lowered.contains("@router.")
    routes = group_per_line(content, rules.FLASK, 2, decorated)
    listed = F.array_join(routes, "")
    commas = F.length(listed) - F.length(F.replace(listed, F.lit(","), F.lit("")))
    py = count_lines(content, rules.FASTAPI, decorated) + F.size(routes) + commas
    return F.when(is_js(language), js).when(is_py(language), py).otherwise(F.lit(0))


def function_count(content: Column, language: Column, stop: Column) -> Column:
    head = F.substring(content, F.lit(1), stop - 1)
    whole_lines = F.substring(content, F.lit(1), stop - 1 - F.length(F.substring_index(head, "\n", -1)))
    readable = F.when(stop > 0, whole_lines).otherwise(content)
    return F.when(is_js(language), count_lines(readable, rules.JS_FUNCTION, has_js_function(content))) \
        .when(is_py(language), count_lines(content, rules.PY_FUNCTION, has_def(content))).otherwise(F.lit(0))


# --- dependencies ----------------------------------------------------------------------------------


def external(source: Column) -> Column:
    return ~(source.startswith(".") | source.startswith("/"))


def top_name(source: Column) -> Column:
    return F.substring_index(source, "/", 1)


def js_dependencies(content: Column, with_require: bool = False) -> Column:
    sources = group_per_line(content, rules.JS_IMPORT, 1, content.contains("import"))
    if with_require:
        sources = F.concat(sources, F.regexp_extract_all(content, F.lit(rules.JS_REQUIRE), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(F.filter(sources, external), top_name)))


def python_dependencies(content: Column, profile: str = "enhanced") -> Column:
    if profile == "core":
        found = F.concat(F.regexp_extract_all(content, F.lit(rules.PY_FROM_START), F.lit(1)),
                         F.regexp_extract_all(content, F.lit(rules.PY_IMPORT_START), F.lit(1)))
    else:
        found = F.concat(group_per_line(content, rules.PY_FROM, 1, content.contains("from")),
                         group_per_line(content, rules.PY_IMPORT, 1, content.contains("import")))
    return F.sort_array(F.array_except(found, F.array(*[F.lit(d) for d in rules.PY_SKIP_DEPS[profile]])))


def java_dependencies(content: Column) -> Column:
    found = F.regexp_extract_all(content, F.lit(rules.JAVA_IMPORT), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(
        F.filter(found, lambda d: ~d.startswith("java.")), lambda d: F.substring_index(d, ".", 1))))


def dependencies(content: Column, language: Column, profile: str = "enhanced") -> Column:
    core = profile == "core"
    chain = F.when(is_js(language), js_dependencies(content, core)) \
        .when(is_py(language), python_dependencies(content, profile))
    if core:
        chain = chain.when(language == "java", java_dependencies(content))
    return chain.otherwise(F.array().cast("array<string>"))


# --- whole-text symbols (matches may span lines) -------------------------------------------------------


def env_vars(content: Column) -> Column:
    """All environment variable reads in pattern order, as ``array<struct<line, name>>``."""
    hints = ["process.env.", "os.environ.get", "os.getenv"]
    return F.concat(*[located_matches(content, p, content.contains(h), name=1)
                      for p, h in zip(rules.ENV_PATTERNS, hints)])


def by_name(found: Column) -> Column:
    """Entries ordered by name and then by their position."""
    return F.array_sort(F.transform(found, lambda x, i: F.struct(
        x["name"].alias("name"), i.alias("at"), x["line"].alias("line"))))


def first_by_name(ordered: Column) -> Column:
    """First entry of each name; ``ordered`` is a projected column made with ``by_name``."""
    return F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["name"] != x["name"]))


def jsx_components(content: Column) -> Column:
    """Distinct capitalised tags in first-seen order."""
    tags = F.regexp_extract_all(content, F.lit(rules.JSX_TAG), F.lit(1))
    return F.array_distinct(F.filter(tags, lambda t: t.rlike("^[A-Z]")))


def detailed_js_functions(content: Column) -> Column:
    found = located_matches(content, rules.JS_FUNCTION, has_js_function(content), whole=0, first=1, second=2)
    return F.transform(found, lambda f: F.struct(
        f["line"].alias("line"), F.when(f["first"] != "", f["first"]).otherwise(f["second"]).alias("name"),
        f["whole"].contains("async").alias("is_async")))


def detailed_endpoints(content: Column, language: Column) -> Column:
    """Whole-text endpoints: app routes first, then router routes. Parameters are read from script routes only."""
    def located(pattern):
        word = "router." if "router" in pattern else "app."
        return located_matches(content, pattern, F.lower(content).contains(word), method=1, path=2)

    js = F.concat(located(rules.EXPRESS_APP), located(rules.EXPRESS_ROUTER))
    py = F.concat(located(rules.FASTAPI_APP), located(rules.FASTAPI_ROUTER))
    found = F.when(is_js(language), js).when(is_py(language), py) \
        .otherwise(F.array().cast("array<struct<line:int,method:string,path:string>>"))

    def parameters(e):
        names = F.when(is_js(language), F.regexp_extract_all(e["path"], F.lit(rules.EXPRESS_PARAM), F.lit(1))) \
            .otherwise(F.array().cast("array<string>"))
        return F.transform(names, lambda p: F.struct(
            p.alias("name"), F.lit("path").alias("type"), F.lit(True).alias("required")))

    def description(e):
        return F.concat(F.when(is_py(language), "FastAPI ").otherwise(""), F.upper(e["method"]),
                        F.lit(" endpoint for "), e["path"])
    return F.transform(found, lambda e: F.struct(
        e["line"].alias("line"), F.upper(e["method"]).alias("method"), e["path"].alias("path"),
        parameters(e).alias("parameters"), description(e).alias("description")))


def with_handlers(endpoints: Column, functions: Column, language: Column, reach: int = 4) -> Column:
    """``endpoints`` with the ``function_name`` of the first Python function in the ``reach`` lines after each, else null.
    Works on the symbol arrays of one file row."""
    def handler(e):
        near = F.filter(functions, lambda f: (f["line"] > e["line"]) & (f["line"] <= e["line"] + reach))
        return F.when(is_py(language), F.array_min(F.transform(near, lambda f: F.struct(f["line"], f["name"])))["name"])
    return F.transform(endpoints, lambda e: F.struct(
        e["line"].alias("line"), e["method"].alias("method"), e["path"].alias("path"),
        F.transform(e["parameters"], lambda p: p["name"]).alias("parameters"), handler(e).alias("function_name")))


def core_endpoints(content: Column) -> Column:
    """Endpoints with a framework label. The Express pattern also matches decorators, so
    a decorator yields two rows."""
    lowered = F.lower(content)
    flask = located_matches(content, rules.FLASK, lowered.contains("@app.route"), path=1, listed=2)
    flask_rows = F.flatten(F.transform(flask, lambda e: F.transform(
        F.when(e["listed"] == "", F.array(F.lit("GET"))).otherwise(F.split(e["listed"], ",")),
        lambda m: F.struct(e["line"].alias("line"), F.upper(F.btrim(strip(m), F.lit("\"'"))).alias("method"),
                           e["path"].alias("path"), F.lit("Flask").alias("framework")))))

    def verbs(pattern, framework):
        return F.transform(located_matches(content, pattern, has_route(lowered), method=1, path=2), lambda e: F.struct(
            e["line"].alias("line"), F.upper(e["method"]).alias("method"), e["path"].alias("path"),
            F.lit(framework).alias("framework")))

    return F.concat(flask_rows, verbs(rules.FASTAPI, "FastAPI"), verbs(rules.EXPRESS_CORE, "Express"))


def core_function_count(content: Column, language: Column) -> Column:
    """Matches of the core function patterns; an async function matches two of them."""
    def total(patterns):
        counts = [F.regexp_count(content, F.lit(p)) for p in patterns]
        return sum(counts[1:], counts[0])

    return F.when(is_py(language), total(rules.CORE_FUNCTIONS["python"])) \
        .when(is_js(language), total(rules.CORE_FUNCTIONS["javascript"])) \
        .when(language == "java", total([rules.JAVA_FUNCTION])).otherwise(F.lit(0))


def java_functions(content: Column) -> Column:
    found = located_matches(content, rules.JAVA_FUNCTION, name=2, listed=3)
    return F.transform(found, lambda f: F.struct(
        f["line"].alias("line"), f["name"].alias("name"),
        F.filter(F.transform(F.split(f["listed"], ","), strip), lambda p: p != "").alias("params")))
