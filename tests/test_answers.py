"""Answers of all eligible files and the outputs made from them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from repolumen.operators import documents, enrich, facts, rollup
from repolumen.session import materialize

FILES = {
    "api/a.py": "@app.get('/x')\ndef read(q):\n    return q\n",
    "web/b.js": "const go = (req, res) => {\n}\n",
    "web/c.ts": "function help(a) { return a; }\n",
    "lib/d.py": "X = 1\n",  # neither function nor endpoint
    "lib/e.py": "def refused():\n    pass\n",
}


def made(files):
    def reply(prompt):
        if "e.py" in prompt:
            raise RuntimeError("no")
        return "SUMMARY: about " + prompt.split("\n")[2] + "\nSETUP_INSTRUCTIONS:\nstep one\nstep two"

    bundles = facts.file_bundles(files(FILES), code=False)
    return bundles, enrich.answers(bundles, reply)


def test_every_eligible_file_is_asked(files):
    bundles, answers = made(files)
    got = {r.file_path: r for r in answers.collect()}
    assert sorted(got) == ["api/a.py", "lib/e.py", "web/b.js", "web/c.ts"]
    assert got["web/c.ts"].summary == "about FILE: web/c.ts"
    assert got["web/b.js"].insights == ["[SETUP] step one", "[SETUP] step two"]
    assert (got["lib/e.py"].response, got["lib/e.py"].error, got["lib/e.py"].summary) == (None, "no", None)


def test_function_runs_once_for_all_outputs(spark, files):
    calls = spark.sparkContext.accumulator(0)

    def counted(prompt):
        calls.add(1)
        return "SUMMARY: fine"
    bundles = facts.file_bundles(files(FILES), code=False)
    answers = enrich.answers(bundles, counted)
    for frame in (rollup.merge_enrichment(bundles, answers), rollup.processing_stats(bundles, answers),
                  documents.file_documents(answers), documents.insight_document(bundles, answers),
                  documents.answer_document(bundles, answers), documents.result_json(bundles, answers)):
        assert frame.collect()
    assert calls.value == 4


def test_own_prompt(files):
    bundles = facts.file_bundles(files(FILES), code=False)
    answers = enrich.answers(bundles, lambda p: p, prompt=F.concat(F.lit("p:"), "file_path"))
    assert {r.response for r in answers.collect()} == {"p:api/a.py", "p:web/b.js", "p:web/c.ts", "p:lib/e.py"}


def test_outputs(spark, files):
    bundles, answers = made(files)
    merged = {r.file_path: (r.summary == r.file_purpose, r.insights) for r in rollup.merge_enrichment(bundles, answers).collect()}
    assert len(merged) == 5 and merged["lib/d.py"] == (True, []) and merged["lib/e.py"] == (True, [])
    assert merged["api/a.py"] == (False, ["[SETUP] step one", "[SETUP] step two"])
    stats = rollup.processing_stats(bundles, answers).first()
    assert (stats.total_files, stats.folders, stats.enriched_files, stats.failed_files) == (5, 3, 3, 1)
    assert {r.doc_name for r in documents.file_documents(answers).collect()} == {"api_a_py.md", "web_b_js.md", "web_c_ts.md"}
    where = spark.createDataFrame([("r", "https://h.example/own/name.git")], "repo string, url string")
    parts = {r.part: json.loads(r.json) for r in documents.result_json(bundles, answers, where).collect()}
    assert parts[""]["repository_info"] == {"name": "name", "owner": "own", "url": "https://h.example/own/name.git",
                                            "description": "Comprehensive documentation for name"}
    assert parts["lib/d.py"]["api_documentation"] is None and parts["lib/e.py"]["api_documentation"] == {"error": "no"}
    asked = parts["api/a.py"]["api_documentation"]
    assert asked["file_analysis"]["api_count"] == 1 and asked["apis"][0]["path"] == "/x" and asked["functions"][0]["name"] == "read"
    assert asked["comprehensive_documentation"].startswith("SUMMARY: about") and "line" not in asked["functions"][0]


def test_list_limits_act_on_request_only(files):
    many = files({f"api/f{k:02d}.py": f"import lib{k:02d}\n@app.get('/x')\ndef a():\n    pass\ndef b():\n    pass\ndef c():\n    pass\n"
                  for k in range(25)})
    rows = facts.file_facts(many)
    for limit, want in ((None, 25), (3, 3)):
        body = "".join(r.text for r in documents.project_summary_document(rows, limit, limit).orderBy("sec", "key").collect())
        assert body.count("  - Purpose: ") == want and body.count("- lib") == want
    found = facts.detailed_facts(many)
    assert {r.component for r in rollup.folder_components(found).collect()} == {"a", "b", "c"}
    assert [r.component for r in rollup.folder_components(found, per_file=2, k=1).collect()] == ["a"]


def test_readme_and_setup_blocks(spark, files):
    def whole(frame):
        return "".join(r.text for r in frame.orderBy("sec", "key").collect())
    python = facts.file_bundles(files({"api/a.py": "import flask\n@app.get('/x')\ndef f():\n    pass\n"}, "p"), code=False)
    script = facts.file_bundles(files({f"web/page{k}.ts": "let x = 1" for k in range(5)}, "s"), code=False)
    body = whole(documents.readme_document(python))
    assert "Frontend" not in body.replace("Frontend Application", "") and "**Flask**" in body and "python api/a.py" in body
    assert "npm run dev" not in body and "Python 3.8+" in body
    body = whole(documents.readme_document(script))
    assert "### Frontend Technologies" in body and "... and 2 more" in body and "npm run dev" not in body
    assert "├── Pages (5 files)" in body and "**0 Backend Services**" in body
    setup = whole(documents.setup_document(script))
    assert "Node.js 16.0" in setup and "Python" not in setup
    java = facts.core_facts(files({"src/A.java": "class A {}"}, "j"))
    assert "mvn clean install" in whole(documents.setup_document(java))


def test_readme_reads_its_table_four_times(spark, files):
    stored = materialize(facts.file_bundles(files(FILES), code=False), "bundles")
    plan = documents.readme_document(stored)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("FileScan parquet") <= 4
