"""Trees, archives, decoding, documents on disk, enrichment."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from repolumen.operators import documents, enrich, facts
from repolumen.session import materialize, scratch_root
from repolumen.sources import corpus, sinks
from repolumen.sources.files import open_root, write_files


def test_scan_tree_and_decode(spark, tmp_path):
    for name, raw in {"one/src/a.py": b"a\r\nb\rc", "one/b.JS": b"a\xffb", "two/c.txt": b"no", "two/d/e.ts": "é".encode(),
                      "two/.hid/f.py": b"x",
                      "two/pkg/__init__.py": b"i", "two/_x/.y.py": b"y", "two/dist/z.py": b"z"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(raw)
    table = corpus.scan_corpus(spark, str(tmp_path))
    got = {(r.repo, r.file_path): r.content for r in table.collect()}
    assert got == {("one", "src/a.py"): "a\nb\nc", ("one", "b.JS"): "ab", ("two", "d/e.ts"): "é", ("two", "pkg/__init__.py"): "i",
                   ("two", "_x/.y.py"): "y"}
    assert facts.file_facts(table).count() == 5


def test_scan_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "proj.zip", "w") as archive:
        archive.writestr("src/a.py", "def f(x):\n    pass\n")
        archive.writestr("src/", "")
        archive.writestr("b.md", "text")
    table = corpus.scan_zip(spark, str(tmp_path))
    assert sorted((r.repo, r.file_path) for r in table.collect()) == [("proj", "b.md"), ("proj", "src/a.py")]
    assert facts.functions(table).first().name == "f"


def test_documents_on_disk(spark, files, tmp_path):
    bundles = facts.file_bundles(files({"a.py": '@app.get("/x")\ndef f(a: int) -> str:\n    """Doc"""', "ui/b.js": "let x = 1"}))
    docs = documents.assemble(documents.api_document(bundles).unionByName(documents.function_document(bundles)))
    sinks.write_documents(docs, str(tmp_path / "docs"))
    written = sorted(str(p.relative_to(tmp_path / "docs")) for p in (tmp_path / "docs").rglob("*") if p.is_file())
    assert written == ["_SUCCESS", "r/API_DOCUMENTATION.md", "r/FUNCTIONS.md"]
    text = (tmp_path / "docs/r/FUNCTIONS.md").read_text()
    assert "### `f(a)`" in text and "**Returns**: str" in text and "ui/b.js" not in text
    assert text == "".join(r.content for r in sinks.read_document(docs, "r", "FUNCTIONS.md").collect())
    assert json.loads((tmp_path / "docs/_SUCCESS").read_text())["files"] == 2
    assert {r.path for r in sinks.list_documents(docs).collect()} == {"r/API_DOCUMENTATION.md", "r/FUNCTIONS.md"}
    sinks.write_documents(docs, str(tmp_path / "docs"))  # again: the same files
    assert (tmp_path / "docs/r/FUNCTIONS.md").read_text() == text


def test_per_file_documents_on_disk(spark, tmp_path):
    answers = spark.createDataFrame([("r", "a/b.py", "one"), ("r", "a.b_py", "two"), ("r", "c.js", "é"), ("q", "c.js", None)],
                                    "repo string, file_path string, response string")
    sinks.write_documents(documents.file_documents(answers), f"file://{tmp_path}/out")
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.md")}
    assert sorted(found) == ["r/files/a.b~py.md", "r/files/a~b.py.md", "r/files/c_js.md"]
    assert "one" in found["r/files/a~b.py.md"] and "é" in found["r/files/c_js.md"]


def test_bundles(spark, tmp_path):
    rows = [("r", f"D{d}.md", s, f"{k:03d}", f"[{d}-{s}-{k}]") for d in range(6) for s in range(2) for k in range(40)]
    docs = spark.createDataFrame(rows, "repo string, doc_name string, sec int, part string, content string").repartition(5)
    sinks.write_bundles(docs, str(tmp_path / "one"))
    got = {(r.repo, r.file_path): r.content for r in corpus.scan_zip(spark, str(tmp_path / "one")).collect()}
    assert got == {("r", f"D{d}.md"): "".join(x[4] for x in rows if x[1] == f"D{d}.md") for d in range(6)}
    sinks.write_bundles(docs, str(tmp_path / "many"), archives=3)
    names = sorted(p.name for p in (tmp_path / "many").glob("*.zip"))
    assert 1 < len(names) <= 3 and all(n.startswith("r-") for n in names)
    assert sum(len(zipfile.ZipFile(tmp_path / "many" / n).namelist()) for n in names) == 6


def test_many_and_large_members(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for k in range(2500):
            archive.writestr(f"d{k % 7}/f{k}.py", f"x = {k}\n")
        archive.writestr("large.py", "y" * (9 << 20))
    got = corpus.scan_zip(spark, str(tmp_path)).selectExpr("count(*) n", "max(length(content)) m").first()
    assert (got.n, got.m) == (2501, 9 << 20)


def _tasks_with_rows(df):
    return df.groupBy(F.spark_partition_id()).count().count()


def test_archives_and_files_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    """Their names are a few bytes, which adaptive execution would merge into one partition."""
    monkeypatch.setattr(corpus, "PIECE_FILES", 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    try:
        for name in ("one", "two"):
            with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as archive:
                for k in range(100):
                    archive.writestr(f"f{k}.md", f"{name} {k}")
        table = corpus.scan_zip(spark, str(tmp_path))
        assert sorted((r.repo, r.file_path, r.content) for r in table.collect()) == sorted(
            (name, f"f{k}.md", f"{name} {k}") for name in ("one", "two") for k in range(100))
        assert _tasks_with_rows(table) > 2  # an archive is read in pieces
        rows = spark.createDataFrame([(f"r/files/__f{k}.md", None, f"é {k}") for k in range(200)],
                                     "file string, member string, content string")
        write_files(rows, str(tmp_path / "out"))
        read = corpus.read_texts(spark, str(tmp_path / "out"), ".md")
        assert {(r.path, r.content) for r in read.collect()} == {(f"r/files/__f{k}.md", f"é {k}") for k in range(200)}
        assert _tasks_with_rows(read) > 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def test_relative_root(spark, tmp_path, monkeypatch):
    (tmp_path / "tree/one").mkdir(parents=True)
    (tmp_path / "tree/one/a.py").write_text("x")
    assert open_root(f"file:{tmp_path}")[1] == open_root(f"file://{tmp_path}/")[1] == str(tmp_path)
    monkeypatch.chdir(tmp_path)
    assert open_root("tree")[1] == f"{tmp_path}/tree"


def test_result_json(spark, files, tmp_path):
    bundles = facts.file_bundles(files({"a.py": '@app.get("/x")\ndef f(a):\n    pass', "b.ts": "let q = 'say \"hi\"'"}))
    result = documents.result_json(bundles)
    sinks.write_results_json(result, str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json").glob("repo=r/*.txt") for x in p.read_text().splitlines()]
    heads, parts = [x for x in lines if "summary" in x], sorted((x for x in lines if "file" in x), key=lambda x: x["file"]["file_path"])
    assert heads[0]["summary"]["total_files"] == 2 and parts[0]["backend_file"]["apis"][0]["path"] == "/x"
    assert [x["file"]["file_path"] for x in parts] == ["a.py", "b.ts"]
    split = result.collect()
    assert sorted(r.part for r in split) == ["", "a.py", "b.ts"] and all(json.loads(r.json) for r in split)


def test_enrich_keeps_failed_rows(spark):
    prompts = spark.createDataFrame([("r", "a", "ok"), ("r", "b", "bad")], "repo string, file_path string, prompt string")

    def answer(prompt):
        if prompt == "bad":
            raise ValueError("refused")
        return prompt.upper()

    got = {r.file_path: (r.response, r.error) for r in enrich.enrich(prompts, answer, tasks=2).collect()}
    assert got == {"a": ("OK", None), "b": (None, "refused")}


def test_materialize_uses_the_shared_folder(spark):
    stored = materialize(spark.range(5).withColumnRenamed("id", "x"), "unit")
    assert stored.count() == 5 and stored.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(scratch_root(spark).lstrip("/"))
