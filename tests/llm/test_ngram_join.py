"""The n-gram join against an inverted list over all documents, and the parts of its trees."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import prose
from pyspark.sql import functions as F

from repolumen.llm import ngram_join
from repolumen.llm.ngram_join import Groups, Tree, links

EDGE = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "One two", 6: "one", 8: "É é ſ ∞ 𝒳 word"}


def edited(text, seed, rate):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > rate else f"e{rng.randrange(40)}" for w in text.split())


def joined(rows, table, **how):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(table(rows), **how).collect()}


def plain(rows, width=5, percent=80):
    return {i: (n, c) for i, (n, c, _) in brute.near(rows, width, percent).items()}


def corpus():
    rows = dict(EDGE) | {9: prose(99, 30_000), 10: prose(99, 30_000) + " tail"}
    for g in range(8):
        base = prose(g, 60 + 60 * g)
        rows |= {100 * (g + 1) + k: edited(base, 1000 * g + k, 0.003 * k) for k in range(30)}
    passage = prose(777, 60)
    rows |= {2000 + k: prose(3000 + k, 40 + k) + " " + passage + " " + prose(5000 + k, 40) for k in range(60)}
    rows |= {3000 + k: prose(5, 120) for k in range(20)}
    rows |= {4000 + k: " ".join(f"w{(k * 3 + i) % 50}" for i in range(5 + k % 9)) for k in range(120)}
    return list(rows.items())


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (3, 85)])
def test_join_equals_inverted_list(table, width, percent):
    rows = corpus()
    assert joined(rows, table, width=width, percent=percent) == plain(rows, width, percent)


def test_small_blocks_and_units(table, monkeypatch):
    for name, value in (("BLOCK_SETS", 7), ("BLOCK_SHINGLES", 2000), ("UNIT_SETS", 2), ("UNIT_SHINGLES", 500),
                        ("CROWD", 2), ("CHUNK", 5)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus()
    assert joined(rows, table) == plain(rows)


def test_hot_group(table):
    base = prose(5, 150)
    rows = [(k, edited(base, k, 0.002 * (k % 25))) for k in range(500)]
    assert joined(rows, table) == plain(rows)


def test_rows_without_id_and_repeated_rows(table):
    a, b = prose(1, 50), prose(2, 50)
    rows = [(None, a), (4, a), (4, a), (None, b), (None, b), (9, b + " more"), (12, "x y"), (None, "x y"), (13, None)]
    got = ngram_join.ngram_components(table(rows)).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in got) == sorted([
        (0, 46, 4), (4, 46, 4), (4, 46, 4), (0, 46, 9), (0, 46, 9), (9, 47, 9), (12, 1, 12), (0, 1, 12), (13, 0, 13)])
    lonely = ngram_join.ngram_components(table([(None, a), (None, a + " more")])).collect()
    assert [r.component_id for r in lonely] == [None, None]
    assert ngram_join.ngram_components(table(rows).limit(0)).count() == 0


@pytest.mark.parametrize("slack", [ngram_join.SLACK, ngram_join.LONG_SLACK])
def test_linked_sets_share_prefix_shingles(spark, slack):
    rng = np.random.default_rng(slack)
    need = {r.n: r.need for r in spark.range(1, 200).withColumnRenamed("id", "n").withColumn(
        "need", ngram_join.needed(F.col("n"), 80, slack)).collect()}
    for n in range(1, 160):
        for m in range(n, 5 * n // 4 + 1):
            both = -(-80 * (n + m) // 180)
            a, b = (set(rng.permutation(1000)[:n].tolist()) for _ in range(2))
            b = set(list(a)[:both]) | set(range(1000, 1000 + m - both))
            b = b if rng.random() < 0.5 else {x if x in a else x - 2000 for x in b}  # before or behind the common ones
            pa_, pb = (sorted(x)[: ngram_join.prefix_length(len(x), 80, slack)] for x in (a, b))
            assert len(set(pa_) & set(pb)) >= max(need[n], need[m])


def test_walk_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(2)
    for trial in range(30):
        base = [np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 120))).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(40):
            own = base[rng.integers(4)]
            sets.append(np.unique(np.concatenate([own[rng.random(len(own)) > rng.random() * 0.2],
                                                  rng.integers(0, 1 << 62, 2).astype(np.uint64)])))
        want, got = Groups(40), Groups(40)
        for i in range(40):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    want.join(i, j)
        list(links(sets, None, got, 80))
        assert (want.roots() == got.roots()).all()
        split = Groups(40)
        for half, shift in ((sets[:17], 0), (sets[17:], 17)):
            inner = Groups(len(half))
            list(links(half, None, inner, 80))
            for x, r in enumerate(inner.roots()):
                split.join(x + shift, int(r) + shift)
        list(links(sets[:17], sets[17:], split, 80))
        assert (want.roots() == split.roots()).all()


def test_levels_combine_their_children():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in rng.integers(1, 300, 77)]
    tree = Tree.of_sets(sets, 256)
    for below, above in zip(tree.levels[:-1], tree.levels[1:], strict=True):
        for k in range(len(above[0])):
            part = slice(k * ngram_join.FAN_OUT, (k + 1) * ngram_join.FAN_OUT)
            assert (above[0][k] == np.bitwise_or.reduce(below[0][part])).all()
            assert (above[1][k], above[2][k], above[3][k]) == (below[1][part].min(), below[2][part].max(), below[3][part].max())
    assert len(tree.levels[-1][0]) == 1
    assert (ngram_join._fold(ngram_join._bitmap(sets[0], 1024), 4) == ngram_join._bitmap(sets[0], 256)).all()


def test_runs_keep_shared_shingles():
    rng = random.Random(4)
    for _ in range(80):
        rows = sorted((rng.randrange(30), rng.randrange(4)) for _ in range(rng.randrange(1, 60)))
        cuts = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows) + 1)))
        pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        batches = [pa.RecordBatch.from_pydict({"t": pa.array([r[0] for r in p], pa.int64()),
                                               "s": pa.array([r[1] for r in p], pa.int64())}) for p in pieces]
        got = [r for b in ngram_join._runs(batches) for r in zip(*b.to_pydict().values(), strict=True)]
        distinct = sorted(set(rows))
        often = {t: len([1 for u, _ in distinct if u == t]) for t, _ in distinct}
        edges = {rows[0][0], rows[-1][0]}
        assert got == [(t, s, None if t in edges else often[t]) for t, s in distinct if t in edges or often[t] > 1]


def test_query(spark):
    import duckdb

    from repolumen.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op11_ngram_join"](spark, sf).collect()}
    assert got == plain(rows)
