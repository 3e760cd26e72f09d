"""Whitening of embeddings by incremental eigendecomposition.

Each partition keeps the spectrum of the scatter matrix of its vectors and adds one vector at a time: a centred
rank-one update. Projected on the current eigenvectors it is a diagonal matrix plus ``z z'``; entries of ``z`` that
vanish and equal eigenvalues are deflated, the others solve the secular equation ``1 + sum z^2 / (d - x) = 0``, all
roots at once. Spectra of partitions are combined the same way, by one update per eigenpair of the smaller one and one
for the distance of the means. A last distributed pass projects every vector on the combined basis and solves the
small projected problem (Rayleigh-Ritz), which removes what rounding has left.

Vectors become whole numbers, ``floor(64 * entry) + 1000000``; equal ones are fitted once. Sums of these are exact.

Cases: rows whose vector is null or holds null or non-finite entries are dropped, as are empty vectors. Vectors of
each length are fitted and whitened on their own. Entries beyond 2**40 in magnitude are held there. Repeated ids keep
all their rows; a null id stays null. A component without variance (constant entries, fewer vectors than components)
has a null ``whitened`` and an ``explained`` of 0 (null if no component has any) and takes no part in the identity
error. ``deviation`` is null if it does not fit into 64 bits. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SCALE, SHIFT, FAR = 64.0, 1_000_000, float(1 << 40)
#: Spectra combined by one task in one round.
FAN_IN = 8
_EPS = np.finfo(float).eps
#: Eigenvalues below this share of the largest are rounding.
NO_VARIANCE = 1e-12
_STATE = "dims int, part long, n long, total array<long>, values array<double>, vectors array<double>"


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + sum z2 / (d - x)`` for rising distinct ``d`` and positive ``z2``, one in each gap and one beyond
    the last, as ``(nearest pole, distance from it)``: the distance keeps its relative precision."""
    k = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum() * (1 + 4 * _EPS))
    middle = 0.5 * (upper - d)
    at_middle = 1 + (z2 / (d - d[:, None] - middle[:, None])).sum(1)
    left = (at_middle >= 0) | (np.arange(k) == k - 1)
    origin = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    apart = d - d[origin][:, None]
    low = np.where(left, np.where(at_middle >= 0, 0.0, middle), -middle)
    high = np.where(left, np.where(at_middle >= 0, middle, upper - d), 0.0)
    x = np.where(at_middle >= 0, 0.5 * middle, np.where(left, 0.5 * (low + high), -0.5 * middle))
    below = np.arange(k)[None, :] <= np.arange(k)[:, None]
    own, gap = d - d[origin], upper - d[origin]
    active = np.ones(k, bool)
    for _ in range(60):
        delta = apart[active] - x[active, None]
        terms = z2 / delta
        slopes = terms / delta
        value = 1 + terms.sum(1)
        done = np.abs(value) <= 4 * _EPS * k * (1 + np.abs(terms).sum(1))
        rise = value < 0
        low[active] = np.where(rise, x[active], low[active])
        high[active] = np.where(rise, high[active], x[active])
        psi = (slopes * below[active]).sum(1)
        phi = slopes.sum(1) - psi
        a1, a2 = own[active] - x[active], gap[active] - x[active]
        a = (a1 + a2) * value - a1 * a2 * (psi + phi)
        b = a1 * a2 * value
        c = value - a1 * psi - a2 * phi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        after = x[active] + step
        inside = (after > low[active]) & (after < high[active])  # false for nan, too
        after = np.where(inside, after, 0.5 * (low[active] + high[active]))
        done |= after == x[active]
        x[active] = np.where(done, x[active], after)
        active[np.flatnonzero(active)[done]] = False
        if not active.any():
            break
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, update: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``vectors diag(values) vectors' + update update'``, values rising.

    ``vectors`` has orthonormal columns, perhaps fewer than rows; the part of ``update`` outside their span becomes a
    new column with value 0."""
    z = vectors.T @ update
    if vectors.shape[1] < len(update):
        rest = update - vectors @ z
        again = vectors.T @ rest
        rest, z = rest - vectors @ again, z + again
        size = np.sqrt(rest @ rest)
        if size > 1e-10 * np.sqrt(update @ update):
            order_at = int(np.searchsorted(values, 0.0))
            values = np.insert(values, order_at, 0.0)
            z = np.insert(z, order_at, size)
            vectors = np.insert(vectors, order_at, rest / size, axis=1)
    if not len(values):
        return values, vectors
    tolerance = 8 * _EPS * max(np.abs(values).max(), z @ z)
    used = z * z > tolerance * 1e-3
    pairs = np.flatnonzero(used)
    rotated = False
    for i, j in zip(pairs[:-1], pairs[1:], strict=True):  # equal eigenvalues: turn z into one of the two directions
        if values[j] - values[i] <= tolerance:
            r = np.hypot(z[i], z[j])
            cos, sin = z[j] / r, z[i] / r
            if not rotated:
                vectors, z, rotated = vectors.copy(), z.copy(), True
            vectors[:, i], vectors[:, j] = cos * vectors[:, i] - sin * vectors[:, j], \
                sin * vectors[:, i] + cos * vectors[:, j]
            z[i], z[j], used[i] = 0.0, r, False
    at = np.flatnonzero(used)
    if not len(at):
        return values, vectors
    d, z2 = values[at], z[at] ** 2
    origin, shift = _roots(d, z2)
    apart = (d - d[origin][:, None]) - shift[:, None]  # pole minus root
    # the z for which the computed roots are exact: the new eigenvectors are then orthogonal
    ratio = -apart / np.where(np.eye(len(d), dtype=bool), 1.0, d[:, None] - d[None, :]).T
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(z[at])
    basis = exact / apart
    basis /= np.sqrt((basis * basis).sum(1))[:, None]
    values, out = values.copy(), vectors.copy()
    values[at] = d[origin] + shift
    out[:, at] = vectors[:, at] @ basis.T
    order = np.argsort(values, kind="stable")
    return values[order], out[:, order]


class Spectrum:
    """Count, exact sum and eigenpairs of the scatter matrix of the vectors seen."""

    def __init__(self, dims: int, n: int = 0, total=None, values=None, vectors=None):
        self.dims, self.n = dims, n
        self.total = np.zeros(dims, np.int64) if total is None else np.asarray(total, np.int64)
        self.values = np.zeros(0) if values is None else np.asarray(values, float)
        self.vectors = np.zeros((dims, 0)) if vectors is None else np.asarray(vectors, float).reshape(dims, -1)

    def _shift(self, between: np.ndarray, weight: float) -> None:
        if between.any():
            self.values, self.vectors = rank_one(self.values, self.vectors, between * np.sqrt(weight))

    def add(self, x: np.ndarray) -> None:
        if self.n:
            self._shift(x - self.total / self.n, self.n / (self.n + 1))
        self.n, self.total = self.n + 1, self.total + x

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > _EPS * other.values[-1]:
                self._shift(vector, value)
        if self.n and other.n:
            self._shift(self.total / self.n - other.total / other.n, self.n * other.n / (self.n + other.n))
        self.n, self.total = self.n + other.n, self.total + other.total

    def row(self, part: int) -> dict:
        return {"dims": self.dims, "part": part, "n": self.n, "total": self.total.tolist(), "values": self.values.tolist(),
                "vectors": self.vectors.ravel().tolist()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("dims", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.int64())),
             ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], [k for k, _ in kinds])


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _fit(batches):
    """One spectrum per vector length of the partition."""
    spectra: dict[int, Spectrum] = {}
    for batch in batches:
        flat, offsets = _lists(batch.column("x"))
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            spectra.setdefault(int(b - a), Spectrum(int(b - a))).add(flat[a:b])
    if spectra:
        part = TaskContext.get().partitionId()
        yield _batch([s.row(part) for s in spectra.values()])


def _combine(table: pa.Table) -> pa.Table:
    """The spectra of one unit, the largest first, as one."""
    rows = table.sort_by([("n", "descending"), ("part", "ascending")]).to_pylist()
    whole, *others = [Spectrum(r["dims"], r["n"], r["total"], r["values"], r["vectors"]) for r in rows]
    for other in others:
        whole.merge(other)
    return pa.Table.from_batches([_batch([whole.row(rows[0]["unit"])])])


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector is usable."""
    entries = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = F.transform(entries, lambda c: F.floor(F.least(F.lit(FAR), F.greatest(F.lit(-FAR), c * SCALE)))
                       .cast("long") + SHIFT)
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), held.alias("x"))


def spectra(fit: DataFrame) -> DataFrame:
    """``(dims, part, n, total, values, vectors)``: one spectrum per vector length of ``fit(x)``.

    Partitions fit their own vectors; spectra are then combined ``FAN_IN`` at a time by the number of their part, every
    round a grouped job whose groups hold so many spectra at most, until part 0 alone is left. Rounds are written, so a
    lost executor repeats one of them.
    """
    now = materialize(fit.mapInArrow(_fit, _STATE), "whitening-parts")
    while now.where("part > 0").limit(1).count():
        units = now.withColumn("unit", F.floor(F.col("part") / FAN_IN).cast("long"))
        now = materialize(units.groupBy("dims", "unit").applyInArrow(_combine, _STATE), "whitening-round")
    return now


def _centred(flat: np.ndarray, offsets: np.ndarray, model: dict):
    """Per vector length of a batch: its rows and ``n * x - S`` (exact), ``x - S / n``."""
    lengths = np.diff(offsets)
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        m = model[int(dims)]
        x = flat[(offsets[:-1][rows][:, None] + np.arange(dims))]
        yield rows, m, x


def _away(x: np.ndarray, m: dict) -> np.ndarray:
    # whole numbers first: x - S / n in doubles would lose digits of x
    base, rest = m["total"] // m["n"], m["total"] % m["n"]
    return (x - base) - rest / m["n"]


def _projected(batches, model: dict):
    """Partial sums ``Y'Y`` and ``sum Y`` of the vectors projected on the basis."""
    sums: dict[int, list] = {}
    for batch in batches:
        for _, m, x in _centred(*_lists(batch.column("x")), model):
            for at in range(0, len(x), 4096):
                y = _away(x[at: at + 4096], m) @ m["basis"]
                now = sums.setdefault(x.shape[1], [np.zeros((y.shape[1],) * 2), np.zeros(y.shape[1])])
                now[0] += y.T @ y
                now[1] += y.sum(0)
    for dims, (square, line) in sums.items():
        flat = np.concatenate([square.ravel(), line])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), dims), pa.int32()),
                                          pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)],
                                         ["dims", "cell", "value"])


def _sums(fit: DataFrame, model: dict) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``Y'Y / n`` and ``sum Y / n`` over the fit list. Cells are added up by Spark; the driver gets one number per
    cell, ``dims * (dims + 1)`` at most, however many vectors there are."""
    cells = fit.mapInArrow(partial(_projected, model=model), "dims int, cell int, value double") \
        .groupBy("dims", "cell").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for dims, rows in cells.groupby("dims"):
        flat = rows.sort_values("cell")["value"].to_numpy() / model[int(dims)]["n"]
        k = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2 + 0.5)
        out[int(dims)] = flat[: k * k].reshape(k, k), flat[k * k:]
    return out


def fit_model(fit: DataFrame, components: int = 16) -> dict[int, dict]:
    """Per vector length ``n, total, basis, values, trace, error``: the leading eigenpairs of the covariance."""
    model = {}
    for row in spectra(fit).collect():  # one row per vector length
        basis = np.asarray(row.vectors, float).reshape(row.dims, -1)
        full, _ = np.linalg.qr(np.hstack([basis[:, ::-1], np.eye(row.dims)]))
        model[row.dims] = {"n": row.n, "total": np.asarray(row.total, np.int64), "basis": full[:, : row.dims]}
    for dims, (square, line) in (_sums(fit, model) if model else {}).items():
        values, turn = np.linalg.eigh(square - np.outer(line, line))
        values, turn = values[::-1], turn[:, ::-1]
        m = model[dims]
        k = min(components, dims)
        m |= {"values": np.where(values[:k] > NO_VARIANCE * max(values[0], 0), values[:k], 0.0),
              "trace": float(values.sum()), "basis": m["basis"] @ turn[:, :k]}
    for dims, (square, line) in (_sums(fit, model) if model else {}).items():
        m = model[dims]
        kept = m["values"] > 0
        size = np.sqrt(np.where(kept, m["values"], 1.0))
        off = (square - np.outer(line, line)) / np.outer(size, size) - np.eye(len(size))
        m["error"] = float(np.abs(off[np.ix_(kept, kept)]).max()) if kept.any() else None
    return model


def _deviation(x: np.ndarray, m: dict) -> list:
    away = [m["n"] * v - s for v, s in ((x.max(0).astype(object), m["total"].astype(object)),
                                         (x.min(0).astype(object), m["total"].astype(object)))]
    if len(x) and max(abs(int(v)) for a in away for v in a) ** 2 * x.shape[1] < 1 << 62:
        return ((m["n"] * x - m["total"]) ** 2).sum(1).tolist()
    exact = ((m["n"] * x.astype(object) - m["total"].astype(object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _whitened(batches, model: dict):
    for batch in batches:
        ids = batch.column("vec_id")
        for rows, m, x in _centred(*_lists(batch.column("x")), model):
            k, kept = len(m["values"]), m["values"] > 0
            y = (_away(x, m) @ m["basis"]) / np.sqrt(np.where(kept, m["values"], 1.0))
            y = np.where(kept, y, np.nan)
            n = len(rows)
            deviation = np.array(_deviation(x, m), object)
            explained = m["values"] / m["trace"] if m["trace"] > 0 else np.full(k, np.nan)
            for at in range(0, n, 1024):
                part = slice(at, at + 1024)
                size = len(rows[part])
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(rows[part], k))),
                    pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()),
                    pa.array(np.full(size * k, m["n"]), pa.int64()),
                    pa.array(np.repeat(deviation[part], k), pa.int64()),
                    pa.array(y[part].ravel(), from_pandas=True),
                    pa.array(np.tile(explained, size), pa.float64(), from_pandas=True),
                    pa.array([m["error"]] * (size * k), pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: one row per usable vector and
    component. The model, ``dims * components`` numbers per vector length (``dims ** 2`` while it is refined), goes to the
    tasks with their code; its size depends on the length of the vectors alone."""
    rows = materialize(whole_numbers(embeddings), "whitening-rows")
    model = fit_model(materialize(rows.select("x").distinct(), "whitening-fit"), components)
    return rows.mapInArrow(partial(_whitened, model=model), "vec_id long, component int, n long, deviation long, "
                           "whitened double, explained double, identity_error double")
