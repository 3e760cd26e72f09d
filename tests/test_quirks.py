"""Hand-written rows for the rules that are easy to get wrong."""

from __future__ import annotations

from pyspark.sql import functions as F

from repolumen.functions import classify, extract, paths, prep, rules, text
from repolumen.operators import facts, graph, rollup


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values))
    return df.select(column).first()[0]


def test_fastapi_handler(files):
    df = facts.endpoints(files({"a.py": '@router.post("/a/{x}")\ndef f(x):\n    pass'}))
    assert rows(df, "method", "path", "function_name", "line") == [("POST", "/a/{x}", "f", 1)]
    assert df.first().parameters == []


def test_handler_beyond_four_lines_is_not_found(files):
    near = '@app.get("/a")\n\n\n\ndef f():'
    far = '@app.get("/a")\n\n\n\n\ndef f():'
    df = facts.endpoints(files({"near.py": near, "far.py": far}))
    assert sorted(rows(df, "file_path", "function_name")) == [("far.py", ""), ("near.py", "f")]


def test_flask_methods_and_typed_parameter(files):
    df = facts.endpoints(files({"a.py": '@app.route("/u/<int:id>")\n@app.route("/v/<id>", methods=["get", \'Post\'])'}))
    got = sorted((r.line, r.method, r.description, [p.name for p in r.parameters]) for r in df.collect())
    assert got == [(1, "GET", "Flask route for GET requests to /u/<int:id>", []),
                   (2, "GET", "Flask route for get requests to /v/<id>", ["id"]),
                   (2, "POST", "Flask route for Post requests to /v/<id>", ["id"])]


def test_page_handler_stops_the_file(files):
    code = ('app.get("/first", h)\nfunction early() {}\n'
            'export default async function (req, res) { router.put("/same", h) }\napp.get("/z", h)\nfunction late() {}')
    table = files({"web/pages/x.test.js": code})
    found = sorted(rows(facts.endpoints(table), "line", "method", "path", "function_name"))
    pages = [(3, m, "/api/x.test", "handler") for m in ("DELETE", "GET", "POST", "PUT")]
    assert found == sorted([(1, "GET", "/first", ""), (3, "PUT", "/same", ""), *pages])
    assert rows(facts.functions(table), "name") == [("early",)]
    summary = facts.file_facts(table).first()
    assert (summary.api_count, summary.function_count) == (6, 1)


def test_handler_outside_page_paths_is_a_function(files):
    table = files({"lib/x.js": "export function run(req, res) {}"})
    assert facts.endpoints(table).count() == 0
    assert rows(facts.functions(table), "name", "is_api_handler") == [("run", True)]


def test_whole_text_counts_equal_listed_rows(files):
    code = {
        "a.py": 'x = 1; @app.get("/a") @app.get("/b")\n@app.route("/c", methods=["GET","PUT"])\ndef f(a,\n  b):\n    pass\n'
                "class A:\n    async def g(self): pass\n    def h(self): pass  # def i()",
        "b.ts": 'app.get("/a", x); app.post("/b", y)\nROUTER.Get("/c")\nconst f = async (a) => 1; const g = function() {}\n'
                "const h = (\n  a) => 1\nvar k = function () {}",
        "api/c.js": "let x = 1; export function handler(request, response) {}",
        "api/d.js": 'function before() {} export default function (req, res) {} app.get("/tail", h)',
    }
    table = files(code)
    counted = {r.file_path: (r.api_count, r.function_count) for r in facts.file_facts(table).collect()}
    bundled = {r.file_path: (r.api_count, r.function_count) for r in facts.file_bundles(table).collect()}
    listed = {p: (facts.endpoints(table).where(F.col("file_path") == p).count(),
                  facts.functions(table).where(F.col("file_path") == p).count()) for p in code}
    assert counted == listed == bundled
    assert counted["a.py"] == (3, 2) and counted["b.ts"] == (2, 2) and counted["api/d.js"] == (5, 0)


def test_python_import_line_gives_both_names(files):
    df = facts.file_facts(files({"a.py": "from a import b\nimport os, z\nfrom re import x"}))
    assert df.first().dependencies == ["a", "b", "x"]


def test_scoped_packages_collapse(files):
    code = 'import a from "@scope/x"\nimport b from "./local"\nimport c from \'lib/deep\'\nimport d from "/abs"'
    assert facts.file_facts(files({"a.js": code})).first().dependencies == ["@scope", "lib"]


def test_async_def(files):
    table = files({"a.py": "async def f(): pass\nclass K(B):\n    def m(self): pass\n    async def n(self): pass\n"
                           "from .x import y\nfrom . import z\nimport p.q as r"})
    assert sorted(rows(facts.functions(table), "name")) == [("f",), ("m",), ("n",)]
    d = facts.detailed_facts(table).first()
    assert [f.name for f in d.functions] == ["m"] and [list(k.methods) for k in d.classes] == [["m"]]
    assert sorted(i.source for i in d.imports) == ["p.q", "x"] and d.dependencies == ["p", "x"]


def test_unparsable_python_has_no_symbols(files):
    d = facts.detailed_facts(files({"a.py": "def f(:\n"})).first()
    assert d.functions == [] and d.imports == [] and d.lines_of_code == 1


def test_matches_across_lines(files):
    code = "import {\n  a,\n  b\n} from 'm'\nconst f = async (\n  x,\n  y\n) => x\nclass\n  Q {}"
    d = facts.detailed_facts(files({"a.js": code})).first()
    assert [(i.line, i.source) for i in d.imports] == [(1, "m")]
    assert [(f.line, f.name) for f in d.functions] == [(5, "f")]
    assert [(k.line, k.name) for k in d.classes] == [(9, "Q")]


def test_service_detection(spark):
    low = F.col("low")
    code = "const express = require('express'); app.use((req, res, next) => next())"
    assert one(spark, classify.service_type(low), low=code) == "frontend"
    assert one(spark, classify.service_framework(F.lit("a.js"), low), low=code) == "Next.js"
    assert one(spark, classify.service_type(low), low="plain") is None
    assert one(spark, classify.service_port(low), low="port = 8080; port: 9") == 8080


def test_jsx_language_per_profile(files):
    table = files({"x.tsx": 'app.get("/x", h)'})
    assert facts.endpoints(table).count() == 1
    d = facts.detailed_facts(table).first()
    assert d.language == "tsx" and d.endpoints == []


def test_core_express_repeats_decorators(files):
    table = files({"a.py": '@app.get("/x")'})
    got = table.select(F.explode(extract.core_endpoints(F.col("content"))).alias("e")).select("e.framework")
    assert sorted(r[0] for r in got.collect()) == ["Express", "FastAPI"]


def test_env_vars_first_occurrence(files):
    code = 'a = os.getenv("X")\nb = process.env.Y\nc = os.environ.get( "X" )\nd = process.env.Y'
    assert sorted(rows(facts.env_vars(files({"a.py": code})), "line", "name")) == [(2, "Y"), (3, "X")]


def test_line_numbers_survive_control_characters(files):
    d = facts.detailed_facts(files({"a.js": "\x01\n\x01class A {} class B {}\n\nclass \n C {}\x01"})).first()
    assert [(k.line, k.name) for k in d.classes] == [(2, "A"), (2, "B"), (4, "C")]


def test_hidden_directory_and_names(spark):
    df = spark.createDataFrame([(p,) for p in (".github/x.py", ".x.py", "a/dist/b.py", "dist.py", "out/a.py", ".py", "a.PY")],
                               "p string")
    p = F.col("p")
    got = {r[0]: tuple(r)[1:] for r in df.select(p, paths.in_skipped_dir(p, "enhanced"), paths.in_skipped_dir(p, "detailed"),
                                                 paths.language_of(p, "enhanced"), paths.language_of(p, "detailed")).collect()}
    assert got[".github/x.py"][:2] == (True, True) and got[".x.py"][:2] == (False, False)
    assert got["a/dist/b.py"][0] and not got["dist.py"][0] and got["out/a.py"][:2] == (False, True)
    assert got[".py"][2:] == (None, "python") and got["a.PY"][2:] == ("python", None)


def test_folders_and_modules(spark):
    df = spark.createDataFrame([("a.py",), ("src/a.py",), ("src/x/a.py",)], "p string")
    folder = paths.folder_of(F.col("p"))
    assert [tuple(r) for r in df.select(folder, paths.module_of(folder)).collect()] == [
        ("root", "core"), ("src", "core"), ("src/x", "src")]


def test_repo_urls(spark):
    url = F.col("u")
    assert tuple(one(spark, paths.repo_info(url), u="https://host.org/me/it.git")) == ("me", "it")
    assert tuple(one(spark, paths.repo_info(url), u="https://host.org/me")) == ("Unknown", "Repository")
    assert tuple(one(spark, paths.repo_info(url, "core"), u="https://host.org/a/me/it.git/")) == ("me", "it")


def test_complexity_counts_twenty_lines(files):
    body = "def f():\n" + "    if a: pass\n" * 3 + "\n" * 20 + "    if b: pass\n" * 5
    assert rows(facts.functions(files({"a.py": body})), "complexity") == [("Medium",)]


def test_docstrings(files):
    code = ('def a():\n    """one"""\ndef b():\n    """first\n    middle\n    last"""\ndef c():\n    pass\n    """no"""')
    assert rows(facts.functions(files({"a.py": code})), "name", "docstring") == [
        ("a", '"""one"""'), ("b", '"""first last"""'), ("c", "")]
    js = "// one\ncode\n/* two */\nfunction f() {}"
    assert rows(facts.functions(files({"a.js": js})), "docstring") == [("// one /* two */",)]


def test_truncation_with_zero_tail(spark):
    got = one(spark, prep.truncate_ends(F.col("c"), 1), c="a b\nc d\ne f")
    assert got == "a b\nc d\n" + rules.TRUNCATED_MARK + "\na b\nc d\ne f"


def test_reduction_falls_back_to_telling_lines(spark):
    long = "\n".join(["x" * 100] * 60 + ["def f():", "  body", "  more", "  rest"])
    lines = F.split(F.col("c"), "\n")
    assert one(spark, prep.reduce_text(F.col("c"), lines), c=long) == "def f():\n  body\n  more"
    assert one(spark, prep.reduce_text(F.col("c"), lines), c="short") == "short"


def test_response_sections(spark):
    answer = "intro\nSUMMARY: first\nSUMMARY: second\n more \n\nKEY_FUNCTIONS: x\n- f\n" + "\n".join(f"- {i}" for i in range(20))
    got = one(spark, prep.parse_response(F.col("p"), F.col("r")), p="a/b.py", r=answer)
    assert got.summary == "second more" and got.insights[0] == "[FUNCTIONS] - f" and len(got.insights) == 21
    first = one(spark, prep.parse_response(F.col("p"), F.col("r"), limit=10), p="a/b.py", r=answer)
    assert list(first.insights) == list(got.insights)[:10]
    empty = one(spark, prep.parse_response(F.col("p"), F.col("r")), p="a/b.py", r="nothing")
    assert empty.summary == "Comprehensive analysis of b.py" and empty.insights == []


def test_waits_and_keys(spark):
    wait = prep.wait_seconds(F.col("m"))
    assert one(spark, wait, m="please try again in 1.5s") == 3.5
    assert one(spark, wait, m="try again in 250ms") == 1.25
    assert one(spark, wait, m="no") == 30.0
    assert one(spark, prep.key_list(F.col("k")), k=" " + "a" * 21 + " ,;short\n" + "b" * 30) == ["a" * 21, "b" * 30]


def test_import_resolution(files):
    table = files({
        "src/a.js": 'import x from "./b"\nimport y from "../lib/c.service"\nimport z from "./gone"\nimport w from "../../up"',
        "src/b.ts": "", "src/b.js": "", "lib/c.js": "", "up.js": ""})
    got = sorted(rows(graph.resolve_imports(facts.detailed_facts(table)), "line", "target"))
    assert got == [(1, "src/b.js"), (2, "lib/c.js")]


def test_java_functions(spark):
    code = "public class A {\n  public static Map get(int a, String b) {\n  private   void stop (\n   long t) {}\n  int hidden() {}\n}"
    got = one(spark, extract.java_functions(F.col("c")), c=code)
    assert [(f.line, f.name, list(f.params)) for f in got] == [(2, "get", ["int a", "String b"]), (3, "stop", ["long t"])]


def test_size_limits(files):
    table = files({"a.py": "x" * 50_000, "b.py": "x" * 50_001, "c.py": "x" * 100_001})
    kept = {p: sorted(r.file_path for r in facts.select_files(table, p, rules.MAX_CHARS[p]).collect())
            for p in ("enhanced", "fast", "detailed")}
    assert facts.select_files(table, "fast").count() == 3
    assert kept == {"enhanced": ["a.py", "b.py"], "fast": ["a.py"], "detailed": ["a.py", "b.py", "c.py"]}


def test_lines_of_code(spark):
    assert one(spark, text.lines_of_code(F.col("c")), c=" \n a \n\t\n\nb") == 2


def test_folder_summary_ties(files):
    table = files({"f/b.py": "x=1", "f/a.ts": "x", "f/c.py": "y=1", "f/d.ts": "z"})
    row = rollup.folder_summary(facts.detailed_facts(table)).first()
    assert row.primary_language == "typescript" and row.total_files == 4 and row.folder_purpose == "General Purpose"


def test_patterns_ignore_case_where_the_tool_does(files):
    table = files({"api/a.js": "EXPORT DEFAULT FUNCTION Run(REQ, RES) {}", "b.py": '@APP.Route("/x", methods=["a","b","c"])\n@ROUTER.get("/y")'})
    assert {r.file_path: r.api_count for r in facts.file_facts(table).collect()} == {"api/a.js": 4, "b.py": 4}
    assert {r.file_path: r.api_count for r in facts.file_bundles(table).collect()} == {"api/a.js": 4, "b.py": 4}


def test_long_responses(spark):
    rng = __import__("random").Random(6)
    names = {"SUMMARY:": "SUMMARY", "API_ENDPOINTS:": "API_ENDPOINTS", "SETUP_INSTRUCTIONS:": "SETUP", "USAGE_EXAMPLES:": "USAGE",
             "KEY_FUNCTIONS:": "FUNCTIONS"}
    lines, section, summary, insights = [], None, "", []
    for k in range(30_000):
        pick = rng.random()
        if pick < 0.01:
            head = rng.choice(list(names))
            lines.append(f" {head} h{k}")
            section = names[head]
            summary = f"h{k}" if section == "SUMMARY" else summary
        elif pick < 0.1:
            lines.append("  ")
        else:
            lines.append(f"  line {k} of a long answer ")
            if section == "SUMMARY":
                summary += f" line {k} of a long answer"
            elif section:
                insights.append(f"[{section}] line {k} of a long answer")
    got = one(spark, prep.parse_response(F.col("p"), F.col("r")), p="a.py", r="\n".join(lines))
    assert got.summary == summary and list(got.insights) == insights
