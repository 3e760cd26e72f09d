"""Text preparation: shortening, context extraction, response and message parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .extract import is_js, is_py
from .paths import file_name
from .text import contains_any, head_lines, joined, lines_of, strip


def word_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")) * 1.3


def share(n: Column, part: float) -> Column:
    return F.floor(n * F.lit(part)).cast("int")


def _tail(lines: Column, n: Column) -> Column:
    """Last ``n`` lines; a count of zero keeps all of them."""
    return F.when(n > 0, F.slice(lines, -n, n)).otherwise(lines)


def _both_ends(lines: Column, start: float, end: float, mark: str) -> Column:
    n = F.size(lines)
    return joined(F.concat(head_lines(lines, share(n, start)), F.array(F.lit(mark)), _tail(lines, share(n, end))))


def truncate_ends(content: Column, max_tokens: int = 3000) -> Column:
    """Over budget: first 70 % and last 30 % of the lines around a marker."""
    return F.when(word_tokens(content) <= max_tokens, content) \
        .otherwise(_both_ends(lines_of(content), 0.7, 0.3, rules.TRUNCATED_MARK))


def shorten_lines(content: Column, lines: Column) -> tuple[Column, Column]:
    """First pass of the reduction (80 % head, 10 % tail) and its fallback of telling lines."""
    shortened = _both_ends(lines, 0.8, 0.1, rules.REDUCED_MARK)
    hits = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
                    lambda h: contains_any(h["line"], rules.REDUCE_WORDS))
    telling = F.flatten(F.transform(head_lines(hits, 100), lambda h: F.slice(lines, h["i"] + 1, F.lit(3))))
    fallback = F.when(F.size(telling) > 0, joined(head_lines(telling, 100))).otherwise(joined(head_lines(lines, 50)))
    return shortened, fallback


def reduce_text(content: Column, lines: Column) -> Column:
    shortened, fallback = shorten_lines(content, lines)
    return F.when(F.length(content) <= rules.REDUCE_LIMIT, content) \
        .when(F.length(shortened) <= rules.REDUCE_LIMIT, shortened).otherwise(fallback)


def extract_context(lines: Column, language: Column, endpoints: Column) -> Column:
    """First five lines, every telling line with its surroundings, first five endpoints."""
    def around(words, mark):
        hits = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
                        lambda h: contains_any(h["line"], words))
        return F.flatten(F.transform(hits, lambda h: F.concat(
            F.slice(lines, F.greatest(h["i"], F.lit(1)),
                    F.least(F.size(lines), h["i"] + 5) - F.greatest(h["i"] - 1, F.lit(0))),
            F.array(F.lit(mark)))))

    none = F.array().cast("array<string>")
    body = F.when(is_js(language), around(rules.JS_CONTEXT_WORDS, rules.JS_BODY_MARK)) \
        .when(is_py(language), around(rules.PY_CONTEXT_WORDS, rules.PY_BODY_MARK)).otherwise(none)
    listed = F.transform(F.slice(endpoints, 1, 5), lambda e: F.concat(F.lit("// "), e["method"], F.lit(" "), e["path"]))
    tail = F.when(F.size(endpoints) > 0, F.concat(F.array(F.lit(rules.CONTEXT_ENDPOINTS)), listed)).otherwise(none)
    return joined(F.concat(head_lines(lines, 5), F.array(F.lit(rules.CONTEXT_MARK)), body, tail))


def _bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def parse_response(path: Column, response: Column, limit: int | None = None) -> Column:
    """``struct<summary, insights>`` of a sectioned answer.

    One scan finds the headings; a section is the slice of lines up to the next one. The last summary section counts;
    lines of other sections become labelled insights, all of them or the first ``limit``. Linear in the answer.
    """
    def section(line):
        found = F.lit(None).cast("string")
        for prefix, name in reversed(rules.RESPONSE_SECTIONS):
            found = F.when(line.startswith(prefix), F.lit(name)).otherwise(found)
        return found

    def parsed(lines, heads):
        def body(h, k):
            """Lines of the section that heading ``k`` begins; positions count from 0."""
            after = F.coalesce(F.get(heads, k + 1)["at"], F.size(lines))
            return F.filter(F.slice(lines, h["at"] + 2, F.greatest(after - h["at"] - 1, F.lit(0))), lambda line: line != "")
        summaries = F.filter(F.transform(heads, lambda h, k: F.when(h["section"] == "summary", F.struct(
            h["at"].alias("at"), k.alias("k")))), lambda x: x.isNotNull())
        last = F.try_element_at(summaries, F.lit(-1))
        first_line = strip(F.replace(F.get(lines, last["at"]), F.lit("SUMMARY:"), F.lit("")))
        summary = F.when(last.isNotNull(), F.array_join(F.concat(F.array(first_line), body(last, last["k"])), " "))
        listed = F.flatten(F.transform(heads, lambda h, k: F.when(h["section"] != "summary", F.transform(
            body(h, k), lambda line: F.concat(F.lit("["), F.upper(h["section"]), F.lit("] "), line)))
            .otherwise(F.array().cast("array<string>"))))
        insights = listed if limit is None else F.slice(listed, 1, limit)
        default = F.concat(F.lit("Comprehensive analysis of "), file_name(path))
        return F.struct(F.when(F.coalesce(summary, F.lit("")) != "", summary).otherwise(default).alias("summary"),
                        insights.alias("insights"))

    def headed(lines):
        heads = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("at"), section(line).alias("section"))),
                         lambda h: h["section"].isNotNull())
        return _bound(heads, lambda found: parsed(lines, found))
    return F.when(response.isNotNull(), _bound(F.transform(lines_of(response), strip), headed))


def wait_seconds(message: Column) -> Column:
    seconds = F.regexp_extract(message, rules.WAIT_SECONDS, 1).try_cast("double")
    millis = F.regexp_extract(message, rules.WAIT_MILLIS, 1).try_cast("double")
    return F.coalesce(seconds + 2, millis / 1000 + 1, F.lit(30.0))


def key_list(text: Column) -> Column:
    """Entries longer than 20 characters of a list split at commas, semicolons and line ends."""
    return F.filter(F.transform(F.split(text, r"[,;\n]+"), strip), lambda k: F.length(k) > 20)


# --- prompts --------------------------------------------------------------------------------------


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _each(array: Column, render) -> Column:
    return F.array_join(F.transform(array, render), "")


def _titled(title: str, array: Column, render) -> Column:
    return F.when(F.size(array) > 0, _say(title, _each(array, render))).otherwise(F.lit(""))


def _fence(language: Column, code: Column) -> Column:
    return _say("```", language, "\n", code, "\n```\n")


def _python_list(parameters: Column) -> Column:
    items = F.transform(parameters, lambda p: _say(
        "{'name': '", p["name"], "', 'type': 'path', 'required': True, 'description': '", p["description"], "'}"))
    return _say("[", F.array_join(items, ", "), "]")


def comprehensive_prompt(instructions: str = "") -> Column:
    """Every endpoint and the first eight functions with code; for ``file_bundles`` rows."""
    language, apis, funcs = F.col("language"), F.col("apis"), F.col("funcs")
    head = _say("Create COMPREHENSIVE documentation for this ", language, " file:\n\nFILE: ", F.col("file_path"),
                "\nPURPOSE: ", F.col("file_purpose"), "\nLANGUAGE: ", language, "\nLINES OF CODE: ",
                F.col("lines_of_code"), "\nAPI ENDPOINTS: ", F.size(apis), "\nFUNCTIONS: ", F.size(funcs),
                "\nDEPENDENCIES: ", F.array_join(F.slice("dependencies", 1, 10), ", "), "\n\n")
    api_part = _titled("DETAILED API ENDPOINTS:\n", apis, lambda a: _say(
        "\n", a["method"], " ", a["path"], "\nFunction: ", a["function_name"], "\nDescription: ", a["description"], "\n",
        F.when(F.size(a["parameters"]) > 0, _say("Parameters: ", _python_list(a["parameters"]), "\n")).otherwise(""),
        "Code:\n", _fence(language, a["code_snippet"])))
    fn_part = _titled("\nDETAILED FUNCTIONS:\n", F.slice(funcs, 1, 8), lambda f: _say(
        "\n", f["name"], "(", F.array_join(f["params"], ", "), ")\nReturn Type: ", f["return_type"], "\nComplexity: ",
        f["complexity"], "\nDocstring: ", f["docstring"], "\nCode:\n", _fence(language, f["code_snippet"])))
    return _say(head, api_part, fn_part, instructions)


def concise_prompt(instructions: str = "") -> Column:
    """Three endpoints and five functions (three parameters each), without code."""
    apis, funcs = F.col("apis"), F.col("funcs")
    head = _say("Analyze this ", F.col("language"), " file and create concise documentation:\n\nFILE: ",
                F.col("file_path"), "\nPURPOSE: ", F.col("file_purpose"), "\nSTATS: ", F.col("lines_of_code"),
                " lines, ", F.size(funcs), " functions, ", F.size(apis), " APIs\n\n")
    api_part = _titled("KEY APIs:\n", F.slice(apis, 1, 3), lambda a: _say("- ", a["method"], " ", a["path"], "\n"))
    fn_part = _titled("\nKEY FUNCTIONS:\n", F.slice(funcs, 1, 5), lambda f: _say(
        "- ", f["name"], "(", F.array_join(F.slice(f["params"], 1, 3), ", "), ")\n"))
    return _say(head, api_part, fn_part, instructions)


def fast_prompt(instructions: str = "") -> Column:
    """Every endpoint and the first five functions with code and line; for fast bundles."""
    language, apis, funcs = F.col("language"), F.col("apis"), F.col("funcs")
    head = _say("Create comprehensive API documentation for this ", language, " file:\n\nFILE: ", F.col("file_path"),
                "\nLANGUAGE: ", language, "\nAPI ENDPOINTS: ", F.size(apis), "\nFUNCTIONS: ", F.size(funcs), "\n\n")
    api_part = _titled("API ENDPOINTS:\n", apis, lambda a: _say(
        "\n", a["method"], " ", a["path"], " (line ", a["line"], ")\n", _fence(language, a["code_snippet"])))
    fn_part = _titled("\nKEY FUNCTIONS:\n", F.slice(funcs, 1, 5), lambda f: _say(
        "\n", f["name"], "(", F.array_join(f["params"], ", "), ") (line ", f["line"], ")\n",
        _fence(language, f["code_snippet"])))
    return _say(head, api_part, fn_part, instructions)


def preview_prompt(instructions: str = "") -> Column:
    """Core facts and the first 800 characters."""
    yes = F.when(F.col("is_backend"), "True").otherwise("False")
    return _say("Analyze this ", F.col("language"), " code file and provide a comprehensive description:\n\nFile: ",
                F.col("file_path"), "\nPurpose: ", F.col("file_purpose"), "\nFunctions: ", F.col("function_count"),
                "\nAPI Endpoints: ", F.col("api_count"), "\nBackend File: ", yes, "\n\nCode Preview:\n",
                F.substring("content_preview", 1, rules.PROMPT_PREVIEW_CHARS), instructions)


def typed_prompt(content: Column, file_type: Column, instructions: dict[str, str] | None = None) -> Column:
    """Prompt by file type over prepared text; for detailed rows."""
    instructions = instructions or {}
    endpoints = F.col("endpoints")
    head = _say("FILE: ", F.col("file_path"), "\nLANGUAGE: ", F.col("language"), "\nFUNCTIONS: ", F.size("functions"),
                "\nCLASSES: ", F.size("classes"), "\nAPI_ENDPOINTS: ", F.size(endpoints))
    listed = F.when(F.size(endpoints) > 0, _say(
        "\nAPI ENDPOINTS DETECTED: ", F.size(endpoints), _each(F.slice(endpoints, 1, 5), lambda e: _say(
            "\n- ", e["method"], " ", e["path"])))).otherwise("")
    closing = F.lit("")
    for name, words in instructions.items():
        closing = F.when(file_type == name, F.lit(words)).otherwise(closing)
    return _say(head, F.when(file_type == "api_routes", listed).otherwise(""), "\n\nCODE:\n```\n", content, "\n```\n", closing)
