"""Whitening against numpy's eigendecomposition, rank-one updates against the matrices they stand for."""

from __future__ import annotations

import numpy as np
import pytest

from repolumen.llm import whitening
from repolumen.llm.whitening import Spectrum, rank_one

SCHEMA = "vec_id long, embedding array<float>, n long, component string, x int, dims string"


def frame(spark, vectors, parts=3):
    rows = [(i, v, 7, "c", 1, "d") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(vectors, components=16):
    """``(vec_id, x) -> ...`` by numpy, for vectors of one length."""
    x = np.array([[int(np.floor(64.0 * float(np.float32(c)))) + 1000000 for c in v] for _, v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, total = len(fit), fit.sum(0)
    centred = (n * fit - total).astype(float) / n
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    k = min(components, len(total))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    deviation = ((n * x - total) ** 2).sum(1)
    away = (n * x - total).astype(float) / n
    return n, deviation, away @ basis / np.sqrt(values), values / np.trace(cov)


def test_updates_equal_the_matrix():
    rng = np.random.default_rng(5)
    for trial in range(120):
        dims, n = int(rng.integers(1, 30)), int(rng.integers(1, 70))
        rows = rng.integers(-3, 4, (n, dims)) if trial % 2 else \
            (rng.normal(size=(n, dims)) * 64 * 10.0 ** rng.integers(-2, 3, dims)).round().astype(np.int64)
        if trial % 5 == 0:
            rows[:, dims // 2:] = 0
        if trial % 7 == 0:
            rows = np.repeat(rows, 3, axis=0)
        parts = [Spectrum(dims) for _ in range(3)]
        for i, row in enumerate(rows):
            parts[i * i % 3].add(row)
        whole = Spectrum(dims)
        for part in parts:
            whole.merge(part)
        centred = rows - rows.mean(0)
        want = centred.T @ centred
        got = whole.vectors @ np.diag(whole.values) @ whole.vectors.T
        assert np.abs(got - want).max() <= 1e-8 * max(1, np.abs(want).max())
        assert np.abs(whole.vectors.T @ whole.vectors - np.eye(whole.vectors.shape[1])).max(initial=0) < 1e-10
        assert whole.n == len(rows) and (whole.total == rows.sum(0)).all()


def test_deflation():
    basis = np.eye(4)
    values, vectors = rank_one(np.array([1.0, 2.0, 2.0, 5.0]), basis, np.array([0.0, 1.0, 1.0, 0.0]))
    assert np.allclose(values, [1, 2, 4, 5]) and np.allclose(vectors @ np.diag(values) @ vectors.T, [
        [1, 0, 0, 0], [0, 3, 1, 0], [0, 1, 3, 0], [0, 0, 0, 5]])
    values, vectors = rank_one(np.zeros(0), np.zeros((3, 0)), np.array([0.0, 3.0, 4.0]))
    assert np.allclose(values, [25]) and np.allclose(np.abs(vectors[:, 0]), [0, 0.6, 0.8])


@pytest.mark.parametrize("dims", [3, 24])
def test_whitening_equals_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = [(i, (rng.normal(size=dims) * np.linspace(1, 3, dims)).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(150)]  # copies count once in the fit
    got = whitening.whiten(frame(spark, vectors, 20)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = plain(vectors)
    k = min(16, dims)
    assert len(got) == len(vectors) * k and set(got["n"]) == {n}
    assert got["deviation"].tolist() == np.repeat(deviation, k).tolist()
    mine = got["whitened"].to_numpy().reshape(len(vectors), k)
    signs = np.sign((mine * white).sum(0))
    assert np.abs(mine * signs - white).max() < 1e-8
    assert np.abs(got["explained"].to_numpy().reshape(-1, k) / explained - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_unusable_rows_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (2, [0.25, -1.0]), (None, [1.5, 0.0])]
    rows = good + [(3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [1.0, 2.0, 3.0]),
                   (9, [3e38, 1.0, -3e38])]
    got = whitening.whiten(frame(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert sorted(by, key=str) == [1, 2, 8, 9, None] and len(by[2]) == 4 and len(by[8]) == 3
    assert {r.n for r in by[1]} == {3} and {r.n for r in by[8]} == {2}
    n, deviation, white, _ = plain(good)
    assert {r.deviation for r in by[1]} == {deviation[0]} and {r.deviation for r in by[None]} == {deviation[3]}
    assert np.allclose(sorted(abs(r.whitened) for r in by[1]), sorted(np.abs(white[0])))
    # two vectors vary along one direction only
    assert [r.whitened is None for r in sorted(by[8], key=lambda r: r.component)] == [False, True, True]
    assert by[9][0].deviation is None and all(r.identity_error < 1e-9 for r in by[8])


def test_constant_and_empty(spark):
    same = whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and all((r.n, r.deviation, r.whitened, r.explained) == (1, 0, None, None) for r in same)
    assert whitening.whiten(frame(spark, [(1, [1.0])]).limit(0)).count() == 0


def test_query_whitens_every_vector(spark):
    from repolumen.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = QUERIES["op12_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = plain([(r[0], r[1]) for r in sorted(rows)])
    assert got["deviation"].tolist() == np.repeat(deviation, 16).tolist() and set(got["n"]) == {n}
    mine = got["whitened"].to_numpy().reshape(-1, 16)
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-6
