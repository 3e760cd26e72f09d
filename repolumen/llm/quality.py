"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Random indexing gives every token a sparse ternary index vector drawn from its hash; the vector of a token is the sum
of the index vectors of its neighbours over the sample, summed up by Spark from partial sums of each partition. A
document is the mean and the spread-weighted mean of its tokens' vectors; tokens outside the vocabulary use their
index vector. Tokens are runs of letters, runs of digits and runs of one sign, so layout and junk are seen as well.
The network has one hidden layer and its logits are divided by a temperature that is fitted on a part of the sample
kept apart, so that scores are probabilities.

Cases: null and empty texts are scored from a document vector of zeros. Any length is read whole. Equal texts score
alike. Without labelled rows of both classes every score is the share of label 1 (0.5 without any). Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .labelled import held_out, training_rows

#: Most labelled rows read to fit vectors and network, and most words that get a vector of their own.
TRAINING_ROWS, VOCABULARY = 4000, 8000
DIM, NONZERO, REACH, HIDDEN, INDEXES = 48, 4, 2, 24, 4096
_TOKEN = re.compile(r"[^\W\d_]+|\d+|([^\w\s]|_)\1*|\n")


def tokens(text: str) -> list[str]:
    """Lower-case words, numbers as one class each by length, sign runs by sign, line ends."""
    return [t if t.isalpha() else ("0" * min(len(t), 4) if t.isdigit() else t[0] * min(len(t), 3))
            for t in (m.group() for m in _TOKEN.finditer(text.lower()))]


def index_table() -> np.ndarray:
    """The sparse ternary index vectors, fixed for all runs; a token's hash picks one."""
    rng, table = np.random.default_rng(1), np.zeros((INDEXES, DIM), np.float32)
    for row in table:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return table


def index_of(names: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode()) % INDEXES for t in names], dtype=np.int64)


def _context_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of neighbours' index vectors by token, emitted whenever a bound is reached and at the end."""
    index = index_table()
    sums: dict[str, np.ndarray] = {}

    def emit():
        names = list(sums)
        table = np.array([sums[n] for n in names]) if names else np.zeros((0, DIM + 1))
        sums.clear()
        return pd.DataFrame({"token": names, "n": table[:, DIM], **{f"v{k}": table[:, k] for k in range(DIM)}})
    for frame in frames:
        for text in frame["text"]:
            line = tokens(text)
            if not line:
                continue
            marks = index[index_of(line)]
            total = np.concatenate([np.zeros((1, DIM)), np.cumsum(marks, 0)])
            at = np.arange(len(line))
            around = total[np.minimum(len(line), at + REACH + 1)] - total[np.maximum(0, at - REACH)] - marks
            for token, vector in zip(line, around, strict=True):
                row = sums.get(token)
                if row is None:
                    row = sums[token] = np.zeros(DIM + 1)
                row[:DIM] += vector
                row[DIM] += 1
            if len(sums) > 40_000:
                yield emit()
    if sums:
        yield emit()


def word_vectors(sample: DataFrame, vocabulary: int = VOCABULARY) -> dict[str, tuple[np.ndarray, float]]:
    """Unit context vector and weight of the ``vocabulary`` most frequent tokens of the sample."""
    columns = ["token", "n", *[f"v{k}" for k in range(DIM)]]
    partial_sums = sample.select("text").mapInPandas(
        _context_sums, "token string, " + ", ".join(f"{c} double" for c in columns[1:]))
    table = partial_sums.groupBy("token").agg(*[F.sum(c).alias(c) for c in columns[1:]]) \
        .orderBy(F.col("n").desc(), "token").limit(vocabulary).toPandas()
    total = table["n"].sum()
    values = table[columns[2:]].to_numpy()
    values = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    weights = 1e-3 / (1e-3 + table["n"].to_numpy() / max(total, 1))
    return {t: (v.astype(np.float32), float(w)) for t, v, w in zip(table["token"], values, weights, strict=True)}


class Pooler:
    """Document vectors: mean vector, rarity-weighted mean vector, and three numbers on size and variety."""

    width = 2 * DIM + 3

    def __init__(self, vectors: dict[str, tuple[np.ndarray, float]]):
        self.place = {t: k for k, t in enumerate(vectors)}
        self.table = np.array([v for v, _ in vectors.values()], np.float32).reshape(-1, DIM)
        self.weights = np.array([w for _, w in vectors.values()], np.float32)
        self.index = index_table()

    def pool(self, text: str) -> np.ndarray:
        counts = Counter(tokens(text))
        out = np.zeros(self.width, np.float32)
        if not counts:
            return out
        n = sum(counts.values())
        known = [(self.place[t], c) for t, c in counts.items() if t in self.place]
        plain, rare = np.zeros(DIM, np.float32), np.zeros(DIM, np.float32)
        if known:
            at, times = np.array(known).T
            plain += times @ self.table[at]
            rare += (times * self.weights[at]) @ self.table[at]
        others = [t for t in counts if t not in self.place]
        if others:
            vector = np.array([counts[t] for t in others], np.float32) @ self.index[index_of(others)] / (4 * NONZERO)
            plain += vector
            rare += vector
        out[:DIM], out[DIM: 2 * DIM] = plain / n, rare / n
        out[2 * DIM:] = np.log1p(n) / 10, len(counts) / n, sum(c for t, c in counts.items() if not t.isalpha()) / n
        return out


@dataclass
class Network:
    """Standardisation, two layers and the temperature; ``share`` answers without layers."""

    share: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 64, rate: float = 0.01) -> Network:
    """Adam on four fifths of the rows; the temperature is fitted on the rest."""
    if not len(y) or y.min() == y.max():
        return Network(share=float(y.mean()) if len(y) else 0.5)
    x = x.astype(np.float64)
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart = np.zeros(len(y), bool)
    tx, ty, rng = x[~apart], y[~apart], np.random.default_rng(7)
    net = Network(float(y.mean()), tx.mean(0), tx.std(0) + 1e-3, rng.normal(0, 0.15, (x.shape[1], HIDDEN)),
                  np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0)
    z = (tx - net.mean) / net.scale
    p = {"w1": net.w1, "b1": net.b1, "w2": net.w2, "b2": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(ty))
        for at in range(0, len(order), batch):
            rows = order[at: at + batch]
            h = np.tanh(z[rows] @ p["w1"] + p["b1"])
            out = 1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -40, 40)))
            d = (out - ty[rows]) / len(rows)
            dh = np.outer(d, p["w2"]) * (1 - h ** 2)
            grads = {"w1": z[rows].T @ dh + 1e-4 * p["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-4 * p["w2"],
                     "b2": np.array([d.sum()])}
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= rate * 0.96 ** epoch * (first[k] / (1 - 0.9 ** step)) \
                    / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    net.b2 = float(p["b2"][0])
    if apart.any():
        raw, target = net.logits(x[apart]), y[apart]

        def loss(temperature):
            q = 1 / (1 + np.exp(-np.clip(raw / temperature, -40, 40)))
            return -np.mean(target * np.log(q + 1e-12) + (1 - target) * np.log(1 - q + 1e-12))
        net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def _pooled(frames: Iterator[pd.DataFrame], vectors) -> Iterator[pd.DataFrame]:
    pooler = Pooler(vectors)
    for frame in frames:
        yield pd.DataFrame({"row": frame["row"], "label": frame["label"].astype("int32"),
                            "x": [pooler.pool(t).astype(float).tolist() for t in frame["text"]]})


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS):
    """Word vectors and network from at most ``rows`` labelled documents outside the held-out fold."""
    sample = materialize(training_rows(docs, labels, "quality", rows).repartition(8, "row"), "quality-sample")
    vectors = word_vectors(sample)
    data = sample.mapInPandas(partial(_pooled, vectors=vectors), "row long, label int, x array<double>").toPandas() \
        .sort_values("row", kind="stable")
    x = np.array(data["x"].tolist()).reshape(-1, Pooler.width)
    return vectors, fit(x, data["label"].to_numpy(dtype=float))


def quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per document."""
    vectors, network = train(docs, labels, rows)

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pooler = Pooler(vectors)
        for texts in parts:
            yield pd.Series(network.score(np.array([pooler.pool(t) for t in texts.fillna("")])
                                      .reshape(-1, Pooler.width)), dtype="float64")
    scored = docs.select("doc_id", probability(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
