"""The graph from one read per part, against what its lists hold."""

from __future__ import annotations

import pytest

from repolumen.operators import facts, graph
from repolumen.session import materialize

FILES = {
    "api/a.py": "import os\nimport numpy as np\n\n@app.get('/x/{y}')\ndef read(y, z=1):\n    pass\n\n"
                "class Box:\n    def open(self):\n        pass\n\n@app.post('/far')\n#\n#\n#\n#\ndef late():\n    pass\n",
    "web/b.js": "import x from './c';\nimport y from \"react\";\napp.get('/u/:id/:part', h);\nconst go = async (q) => {};\nclass View {}\n",
    "web/c.js": "function help(a) { return a; }\nfunction help(b) {}\n",
    "top.py": "def (broken",
}


@pytest.fixture
def detailed(files):
    return materialize(facts.detailed_facts(files(FILES)), "detailed")


def test_nodes_and_edges(detailed):
    nodes = {(r.id, r.metadata.get("line")): r for r in graph.build_nodes(detailed).collect()}
    meta = {key: r.metadata for key, r in nodes.items()}
    assert meta["api:api/a.py:GET:/x/{y}", "4"] == {"method": "GET", "path": "/x/{y}", "line": "4", "function_name": "read",
                                                    "parameters": ""}
    assert meta["api:api/a.py:POST:/far", "12"].get("function_name") is None
    assert meta["api:web/b.js:GET:/u/:id/:part", "3"]["parameters"] == "id,part"
    assert meta["function:web/b.js:go", "4"] == {"line": "4", "parameters": "", "is_async": "true"}
    assert meta["function:api/a.py:read", "5"]["parameters"] == "y,z" and meta["class:api/a.py:Box", "8"]["methods"] == "open"
    assert meta["external:numpy", None] == {"full_name": "numpy", "is_external": "true"}
    assert meta["folder:web", None] == {"file_count": "2"} and meta["folder:root", None] == {"file_count": "1"}
    assert meta["file:web/b.js", None]["service_type"] == "frontend"
    assert ("function:web/c.js:help", "1") in nodes and ("function:web/c.js:help", "2") in nodes
    edges = {(r.source, r.target, r.type): r.metadata for r in graph.build_edges(detailed).collect()}
    assert edges["file:web/b.js", "file:web/c.js", "imports"] == {"import_line": "1"}
    assert ("api:api/a.py:GET:/x/{y}", "function:api/a.py:read", "handled_by") in edges
    assert not any(kind == "handled_by" and "far" in source for source, _, kind in edges)


def test_counts_equal_the_lists(detailed):
    want = {}
    for kind, frame in (("node", graph.build_nodes(detailed)), ("edge", graph.build_edges(detailed))):
        for r in frame.groupBy("repo", "type").count().collect():
            want[r.repo, kind, r.type] = r["count"]
    assert {(r.repo, r.kind, r.type): r.entries for r in graph.type_counts(detailed).collect()} == want


@pytest.mark.parametrize("build", [graph.build_nodes, graph.build_edges, graph.type_counts])
def test_few_reads(detailed, build):
    plan = build(detailed)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("FileScan parquet") <= 4
