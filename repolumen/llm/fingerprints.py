"""Document fingerprints by consistent weighted sampling.

A text is a bag of weighted terms: its words and its pairs of neighbouring words, each with its number of
occurrences. For each of ``SAMPLES`` samples a term draws ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)`` from its hash; a
weight ``s`` is quantised to ``t = floor(ln s / r + b)`` and the term with the least ``ln c - r (t - b) - r`` is
sampled together with ``t``. Two texts draw the same sample with a probability equal to their generalised Jaccard
similarity (sum of least weights over sum of greatest weights), so the share of equal samples estimates it. A sample
is stored as one byte of hash; chance agreement (1/256) is taken off the estimate.

The draws of a term follow from its full 64-bit hash, so unlike terms never share them. They are made of three
exponential draws: ``e`` is the value of the term at weight 1 and needs one hash, ``c = e + f`` with another draw ``f``,
``r (1 - b) = ln(c / e)`` and ``r b`` is the third; this gives r, c and b the distributions above. Terms that occur more
often are worked out only in samples where a lower bound of their value is below the best so far.

Cases: null and empty texts have no term and the fingerprint of the empty bag; two of them are alike (1.0), one of
them and another text are not (0.0). Equal texts have equal fingerprints. Rows with equal ``doc_id`` are put in order
by their text, rows without come last. The only row of a table is its own neighbour. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, SPACE, U64, mix, prefix_hash, stretch_hash, words

SAMPLES = 64
#: Terms whose draws are made at a time.
BLOCK = 1024
_KEYS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
#: Rows of one ordered stretch of documents, and most stretches: what the driver knows of them stays bounded, and
#: longer stretches are sorted with spill and read as a stream.
STRETCH_ROWS, MOST_STRETCHES = 1024, 20_000


def _drawn(terms: np.ndarray) -> np.ndarray:
    """64 bits for each term and sample; the terms are hashes already."""
    x = terms[:, None] ^ _KEYS
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    x *= U64(0x94D049BB133111EB)
    return x


def _uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1)."""
    return ((bits >> U64(12)).astype(np.float64) + 0.5) / float(1 << 52)


def term_weights(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word pairs of a text, and their weights."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), SPACE)
    single = stretch_hash(prefix_hash(data), starts, ends)
    pairs = mix(single[:-1] * U64(3) + single[1:])
    return np.unique(np.concatenate([single, pairs]), return_counts=True)


def sampled(bits: np.ndarray, third: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithm of the sampling value, and the quantised weight, of terms of weight ``s``. ``third`` is ``exp(-r b)``."""
    e = -np.log1p(-_uniform(bits))
    c = e - np.log(_uniform(mix(bits + U64(2))))
    rest, rb = np.log(c / e), -np.log(third)
    r = rest + rb
    t = np.floor((np.log(s) + rb) / r)
    return np.log(c) - r * t - rest, t


def fingerprint(text: bytes) -> np.ndarray:
    """``SAMPLES`` bytes; all zero for a text without words."""
    terms, weights = term_weights(text)
    if not len(terms):
        return np.zeros(SAMPLES, np.uint8)
    every = np.arange(SAMPLES)
    best, name, level = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES)
    once = terms[weights == 1]
    for lo in range(0, len(once), BLOCK):
        bits = _drawn(once[lo: lo + BLOCK])
        k = bits.argmin(0)
        value = np.log(-np.log1p(-_uniform(bits[k, every])))
        better = value < best
        best[better], name[better] = value[better], once[lo + k[better]]
    often, counts = terms[weights > 1], weights[weights > 1].astype(np.float64)
    lo, block = 0, BLOCK if len(once) else 16  # without a bound every sample of the first block is worked out
    while lo < len(often):
        bits, s = _drawn(often[lo: lo + block]), counts[lo: lo + block]
        third = _uniform(bits * U64(0xD6E8FEB86659FD93) ^ (bits >> U64(32)))
        # The value is at least e exp(-r b) / s, and e is at least its uniform number.
        at, sample = np.nonzero(_uniform(bits) * third <= s[:, None] * np.exp(best))
        if len(at):
            value, t = sampled(bits[at, sample], third[at, sample], s[at])
            order = np.lexsort((value, sample))
            first = order[np.unique(sample[order], return_index=True)[1]]
            first = first[value[first] < best[sample[first]]]
            chosen = sample[first]
            best[chosen], name[chosen], level[chosen] = value[first], often[lo + at[first]], t[first]
        lo, block = lo + block, BLOCK
    drawn = mix(mix(name + level.astype(np.int64).astype(np.uint64) * U64(0x10001)) + (every.astype(np.uint64) << U64(40)))
    return (drawn & U64(0xFF)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, empty_a: bool, empty_b: bool) -> float:
    """Share of equal samples, corrected for bytes that agree by chance."""
    if empty_a or empty_b:
        return float(empty_a and empty_b)
    equal = float((a == b).mean())
    return min(1.0, max(0.0, (equal - 1 / 256) / (1 - 1 / 256)))


def _edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _describe(batches):
    """Rows of whole stretches in descending order; a row is described once its neighbour is known."""
    before = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for batch in batches:
        out = []
        for doc_id, text, stretch, halo in zip(*[batch.column(c).to_pylist() for c in
                                                 ("doc_id", "text", "stretch", "halo")], strict=True):
            if halo and not (before and before[4] == stretch):
                continue
            raw = text.encode()
            mark, blank = fingerprint(raw), not raw.strip(b"\x20\x09\x0a\x0b\x0c\x0d")
            if before and before[4] == stretch:
                own_id, own, own_mark, own_blank, _ = before
                edited = _edited(own, text)
                changed = edited.encode()
                changed_mark = fingerprint(changed)
                out.append((own_id, len(own), hashlib.sha256(changed).hexdigest(), own_mark.tobytes().hex(),
                            changed_mark.tobytes().hex(),
                            likeness(own_mark, changed_mark, own_blank,
                                     not changed.strip(b"\x20\x09\x0a\x0b\x0c\x0d")),
                            likeness(own_mark, mark, own_blank, blank)))
            before = None if halo else (doc_id, text, mark, blank, stretch)
        frame = pd.DataFrame(out, columns=names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(frame[n].tolist(), kind) for n, kind in zip(names, (
                pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()),
                strict=True)], names)


def _place(batches, cuts: np.ndarray):
    """Adds the number of the stretch that holds the id; ids are missing in the last one only."""
    for batch in batches:
        ids = batch.column("doc_id")
        known = np.asarray(ids.is_valid())
        place = np.searchsorted(cuts, np.asarray(ids.fill_null(0)), "left")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(known, place, -1), pa.int64())],
                                         [*batch.schema.names, "stretch"])


def fingerprints(docs: DataFrame, stretch_rows: int = STRETCH_ROWS) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per document.

    Documents are dealt out once, in stretches of neighbouring ids. The first document of each stretch is also sent to
    the stretch before it, where it only serves as the neighbour of the last one; the first of all goes to the end.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = texts.count()
    if not n:
        return texts.mapInArrow(_describe_nothing, _SCHEMA)
    parts = min(MOST_STRETCHES, max(1, n // stretch_rows))
    cuts = texts.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5],
                                         max(10_000, 10 * parts)).alias("c")).first().c or []
    cuts = np.unique(np.array(cuts if parts > 1 else [], dtype=np.int64))
    schema = "doc_id long, text string, stretch long"
    placed = texts.mapInArrow(partial(_place, cuts=cuts), schema)
    # The first row of a stretch is the one with the largest id; several such rows are all sent, the first is used.
    heads = texts.select("doc_id").mapInArrow(partial(_place, cuts=cuts), "doc_id long, stretch long") \
        .groupBy("stretch").agg(F.max("doc_id").alias("head")).collect()  # one row per stretch
    order = sorted((row.stretch for row in heads), reverse=True)
    before = {stretch: order[k - 1] for k, stretch in enumerate(order)}
    sent = [(row.head, row.stretch, before[row.stretch]) for row in heads]
    spark = docs.sparkSession
    moves = F.broadcast(spark.createDataFrame(sent, "head long, stretch long, goes long"))
    halo = placed.join(moves, (placed["stretch"] == moves["stretch"])
                       & placed["doc_id"].eqNullSafe(moves["head"])) \
        .select("doc_id", "text", F.col("goes").alias("stretch"), F.lit(True).alias("halo"))
    dealt = placed.withColumn("halo", F.lit(False)).union(halo).repartition("stretch") \
        .sortWithinPartitions("stretch", "halo", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return dealt.mapInArrow(_describe, _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, " \
    "near_edited double, near_next double"


def _describe_nothing(batches):
    yield from ()
