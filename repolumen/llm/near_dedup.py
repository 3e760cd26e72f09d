"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

Distinct shingle sets get ``96`` minima. Four minima make a band; sets that share a band are candidates. The low
four bits of all minima, packed into six longs, estimate the similarity of a candidate from bit counts, corrected
for chance agreement; only estimates far below the threshold are dropped. Every link is confirmed on whole sets.

No group is paired with itself. A bucket first links each member to its smallest member (a star). The sets of buckets
that still hold several components are searched again. Their shingles that are rare among them lead to all pairs with
a rare shingle in common, a bounded number each. Any other pair has at most the remaining ``c`` shingles of a set in
common, and its union has at least the other's size plus the set's ``u`` rare ones, so it is looked at only if
``c / (size of the other + u)`` reaches the threshold both ways. Both bounds are exact: no link is lost by them.

Cases: null, empty and blank texts have no shingles, are linked with nothing and kept. Equal texts fall together
before any bucket is made. Rows with the same ``doc_id`` count as one document. A row without ``doc_id`` takes the
component of equal texts, if any, else none. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bytetext import LOWER, SPACE, U64, as_long, mix, prefix_hash, stretch_hash, text_slices, words
from .components import connected_components

BANDS, ROWS, BITS = 24, 4, 4
MINIMA = BANDS * ROWS
#: An estimate this far below the threshold cannot belong to a link: over five standard deviations.
MARGIN = 0.22
#: A shingle is rare if at most so many of the sets that are searched again hold it.
RARE = 64
_NIBBLES = 0x1111111111111111
_MULTIPLIERS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * U64(0xD1342543DE82EF95)) | U64(1)
_STEPS = mix(np.arange(101, 117, dtype=np.uint64)) | U64(1)


def shingle_sets(column, width: int):
    """For each text the sorted distinct hashes of its ``width``-word shingles (all words if fewer)."""
    for row, end, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, owner = words(data, offsets, SPACE)
        hashes = stretch_hash(prefix_hash(data), starts, ends)
        bounds = np.searchsorted(owner, np.arange(end - row + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b == a:
                yield np.zeros(0, np.uint64)
                continue
            take = min(width, b - a)
            total = np.full(b - a - take + 1, take, np.uint64)
            for k in range(take):
                total = mix(total * _STEPS[k % 16] + hashes[a + k: b - take + k + 1])
            yield np.unique(total)


def _minima(values: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, ~U64(0))
    for at in range(0, len(values), 4096):
        least = np.minimum(least, (values[at: at + 4096, None] * _MULTIPLIERS).min(0))
    return mix(least)


def _signatures(batches, width: int):
    for batch in batches:
        ids = batch.column("doc_id")
        sets = shingle_sets(batch.column("text"), width)
        counts, firsts, seconds, bands, packed = [], [], [], [], []
        for values in sets:
            counts.append(len(values))
            firsts.append(np.bitwise_xor.reduce(mix(values + U64(11))) if len(values) else U64(0))
            seconds.append(mix(values ^ U64(0x5555)).sum(dtype=np.uint64) if len(values) else U64(0))
            if not len(values):
                bands.append(np.zeros(BANDS, np.uint64))
                packed.append(np.zeros(MINIMA * BITS // 64, np.uint64))
                continue
            least = _minima(values)
            keys = np.zeros(BANDS, np.uint64)
            for column in least.reshape(BANDS, ROWS).T:
                keys = mix(keys * _STEPS[0] + column)
            bands.append(keys)
            low = (least & U64(15)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * U64(4))
            packed.append(np.bitwise_or.reduce(low, axis=1))

        def lists(parts, size):
            flat = as_long(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(counts, pa.int64()), pa.array(as_long(np.array(firsts, np.uint64))),
             pa.array(as_long(np.array(seconds, np.uint64))), lists(bands, BANDS), lists(packed, MINIMA * BITS // 64)],
            ["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])


def _full_sets(batches, width: int):
    for batch in batches:
        sets = list(shingle_sets(batch.column("text"), width))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]) if sets else np.zeros(1)
        flat = as_long(np.concatenate(sets) if sets else np.zeros(0, np.uint64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
            ["id", "shingles"])


def estimated_similarity(a: str, b: str) -> Column:
    """Similarity estimate of two packed signatures: share of equal low bits, corrected for chance."""
    unequal = F.lit(0)
    for word in range(MINIMA * BITS // 64):
        x = F.col(a)[word].bitwiseXOR(F.col(b)[word])
        folded = x
        for shift in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, shift))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(_NIBBLES)))
    chance = 2.0 ** -BITS
    return (1 - unequal / MINIMA - chance) / (1 - chance)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` whose full sets reach the threshold."""
    near = pairs.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv")), "v") \
        .join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("su")), "u") \
        .select("u", "v", F.size("su").alias("nu"), F.size("sv").alias("nv"),
                F.size(F.array_intersect("su", "sv")).alias("both"))
    return near.where(100 * F.col("both").cast("long") >= percent * (F.col("nu") + F.col("nv") - F.col("both")))


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row; links are pairs of documents whose ``width``-word
    shingle sets have at least ``percent`` hundredths of their union in common."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(texts.mapInArrow(partial(_signatures, width=width), "doc_id long, n_shingles long, "
                         "set_a long, set_b long, bands array<long>, bits array<long>"), "neardup-signatures")
    key = ["n_shingles", "set_a", "set_b"]
    nodes = signed.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node")).where("node is not null")
    named = materialize(signed.select("doc_id", *key).join(nodes, key, "left"), "neardup-nodes")
    first = signed.where("n_shingles > 0").join(
        named.where("doc_id = node").select("node", *[F.col(c).alias(f"_{c}") for c in key]).distinct(),
        (F.col("doc_id") == F.col("node")) & (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b"))
        & (F.col("n_shingles") == F.col("_n_shingles")), "left_semi")
    spread = first.select(F.col("doc_id").alias("id"), "n_shingles", "bits", F.posexplode("bands").alias("band", "key"))
    narrow = spread.select("id", "band", "key")
    shared = materialize(narrow.groupBy("band", "key").agg(
        F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
        .select("band", "key", "leader"), "neardup-buckets")
    members = materialize(narrow.join(shared, ["band", "key"]), "neardup-members")

    bits = first.select(F.col("doc_id").alias("id"), "bits", "n_shingles")
    floor = percent / 100 - MARGIN
    stars = members.where("id <> leader").select(F.col("leader").alias("u"), F.col("id").alias("v")).distinct()
    likely = stars.join(bits.select(F.col("id").alias("u"), F.col("bits").alias("bu")), "u") \
        .join(bits.select(F.col("id").alias("v"), F.col("bits").alias("bv")), "v") \
        .where(estimated_similarity("bu", "bv") >= floor).select("u", "v")
    likely = materialize(likely, "neardup-stars")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = materialize(texts.join(wanted, "doc_id", "left_semi").mapInArrow(
        partial(_full_sets, width=width), "id long, shingles array<long>"), "neardup-sets")
    links = materialize(_confirm(likely, sets, percent).select("u", "v"), "neardup-links")
    found = connected_components(links, "neardup-components")

    placed = materialize(members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")),
                         "neardup-placed")
    split = placed.groupBy("band", "key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min(F.when(F.col("id") == F.col("leader"), F.col("component"))).alias("main")).where("low <> high")
    open_ = placed.join(split.select("band", "key", "main"), ["band", "key"])
    # The leader itself has already met every member of its bucket.
    homes = open_.select("id", "component").distinct()
    spelled = materialize(sets.join(homes, "id").select("id", "component", F.explode("shingles").alias("s")),
                          "neardup-spelled")
    rare = materialize(spelled.groupBy("s").agg(
        F.count("*").alias("n"), (F.min("component") < F.max("component")).alias("between"))
        .where(F.col("n") <= RARE), "neardup-rare")
    own = spelled.join(rare.select("s"), "s", "left_semi").groupBy("id").agg(F.count("*").alias("own"))
    facts = materialize(bits.join(homes, "id").join(own, "id", "left").select(
        "id", "component", "bits", F.col("n_shingles").alias("n"), F.coalesce("own", F.lit(0)).alias("own")),
        "neardup-facts")
    alike = (F.col("a.component") != F.col("b.component")) & (estimated_similarity("a.bits", "b.bits") >= floor)
    # Pairs with a rare shingle in common: at most RARE rows meet in one key.
    keyed = spelled.join(rare.where("n > 1 and between").select("s"), "s").select("s", "id") \
        .join(facts.select("id", "component", "bits"), "id")
    shared_rare = keyed.alias("a").join(keyed.alias("b"), (F.col("a.s") == F.col("b.s")) & (
        F.col("a.id") < F.col("b.id")) & alike).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    # All other pairs: rare shingles count for the union only.
    rest = open_.where("id <> leader").drop("component").join(facts, "id")
    a, b = rest.where("component <> main").alias("a"), rest.alias("b")
    able = [100 * (F.col(f"{x}.n") - F.col(f"{x}.own")) >= percent * (F.col(f"{y}.n") + F.col(f"{x}.own"))
            for x, y in (("a", "b"), ("b", "a"))]
    others = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key"))
                    & ((F.col("b.component") == F.col("b.main")) | (F.col("a.id") < F.col("b.id")))
                    & able[0] & able[1] & alike).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    more = shared_rare.union(others).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    late = materialize(_confirm(more, sets, percent).select("u", "v"), "neardup-late")
    if not late.isEmpty():
        found = connected_components(links.union(late), "neardup-all")
    return named.join(found.select(F.col("id").alias("node"), "component"), "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
