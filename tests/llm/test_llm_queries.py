"""Registered queries and the pipeline on the smallest tables."""

from __future__ import annotations

import brute
import corpus_pipeline
import duckdb
import pytest
from compare import connect, difference

from repolumen.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall()


def test_all_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLE))
def test_against_checking_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", ["op1_quality", "op3_fingerprints", "op6_toxicity"])
def test_one_row_per_document(spark, documents, name):
    rows = QUERIES[name](spark, SF).toPandas()
    assert sorted(rows["doc_id"]) == sorted(i for i, _ in documents)


def test_personal_data(spark, documents):
    rows = {r.doc_id: r.base_sha256 for r in QUERIES["op2_pii"](spark, SF).collect()}
    assert rows == {i: brute.sha(brute.pii_text(brute.pii(t))) for i, t in documents}


def test_near_duplicates(spark, documents):
    rows = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op5_near_duplicates"](spark, SF).collect()}
    assert rows == brute.near(documents, 3, 85)


def test_decontamination(spark, documents, con):
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
            for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    assert rows == brute.contamination(documents, items)


def test_repeats(spark, documents):
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
            for r in QUERIES["op10_suffix_dedup"](spark, SF).collect()}
    assert rows == brute.repeats(documents)


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, SF)
        rows = {r.doc_id: r.text for r in after.collect()}
        if name == "toxicity":
            assert len(rows) < len(before) and rows.items() <= before.items()
        if name == "near_dedup":
            kept = {i for i, (_, _, k) in brute.near(list(before.items()), 5, 80).items() if k}
            assert rows == {i: t for i, t in before.items() if i in kept}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {i for i, r in brute.contamination(before.items(), items).items() if r[4]}
            assert rows == {i: t for i, t in before.items() if i not in bad}
        if name == "pii":
            assert rows.keys() == before.keys() and not any(brute.pii(t) for t in rows.values())
            assert all(rows[i] == t for i, t in before.items() if not any(c in (t or "") for c in "0123456789@"))
        if name != "mixing":
            assert after.columns == columns
        else:
            assert rows.keys() <= before.keys() and "taken" in after.columns
        docs = after
