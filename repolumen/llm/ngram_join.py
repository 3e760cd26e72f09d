"""Jaccard join of word n-gram sets through signature trees.

A leaf of a tree is one set: a bitmap of its hashed shingles, its size, and its excess, the shingles that found their bit
taken. A node combines its children's bitmaps by OR and keeps the range of their sizes and their largest excess. Two
sets below two nodes have at most ``common bits + excess`` shingles in common, so a pair of nodes is followed further
only if that and the size ranges allow a link. Two trees are walked together from the roots down; leaves that remain are
compared on their full sets. A pair of nodes whose sets already hang together is left out, as it cannot change a
component.

Which trees meet:

1. Shingles are ordered by hash. Linked sets share at least ``need`` shingles among the first ``prefix`` of each (the
   usual prefix bound with some slack). Prefix shingles that no other set has are dropped in one sorted pass over
   range-split rows; a set left with fewer than ``need`` links with nothing. This is done twice, with a short prefix of
   all sets and a long one of those left. Then the ``need - 1`` most frequent shingles of each set are dropped: a link
   shares a less frequent one. This keeps passages that many documents quote out of the join.
2. The remaining sets are range-split by two of their minima, so that alike sets stand together. Blocks of bounded size
   become trees, each joined with itself. The sets it links become units of bounded size, trees of their own.
3. Units of different components meet if they share a kept shingle: first those of each shingle with its smallest unit,
   then, where components still differ, all of them. The units of a shingle that more than ``CROWD`` have are dealt into
   chunks, and trees over the roots of a chunk are walked together, so that only pairs that allow a link become rows.
   Units that are left are compared from their roots down.

All bounds are exact, so no link is lost; equal sets enter once.

Cases: null, empty and blank texts have no shingles and are linked with nothing. Rows with the same ``doc_id`` count as
one document. A row without ``doc_id`` links like others and takes part in its component, named by the smallest id there
is; without any, ``component_id`` is null. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .bytetext import U64, as_long, mix
from .components import connected_components
from .near_dedup import shingle_sets

#: Hundredths of a set's shingles by which the prefix exceeds the least one, for all sets and for those left.
SLACK, LONG_SLACK = 5, 40
#: Sets and shingles of a block, and of a unit (at least one set).
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1 << 20
UNIT_SETS, UNIT_SHINGLES = 64, 1 << 15
#: Units of one shingle that are still paired one by one, and those of one chunk beyond it.
CROWD, CHUNK = 32, 512
FAN_OUT = 8
BITS_LOW, BITS_HIGH = 256, 1 << 16
_EXACT = "unit long, part long, low long, high long, excess array<long>, bits array<long>, members array<long>, " \
    "sizes array<long>, shingles array<long>"


def prefix_length(n: int, percent: int, slack: int) -> int:
    """Shingles of a set of ``n`` that are looked at: ``n - required + 1``, and the slack."""
    return min(n, n - (percent * n + 99) // 100 + 1 + slack * n // 100)


def needed(n: Column, percent: int, slack: int) -> Column:
    """Shared prefix shingles that any link of a set of ``n`` has: one, and the slack of the smallest partner."""
    return 1 + F.floor(slack * percent * n / 10_000)


def _profiles(batches, width: int, percent: int):
    """Size, key and prefix per text; the prefix only where the partition has not seen the set before."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        counts, firsts, seconds, prefixes = [], [], [], []
        for values in shingle_sets(batch.column("text"), width):
            n = len(values)
            key = (int(np.bitwise_xor.reduce(mix(values + U64(17)))), int(mix(values ^ U64(0x3333)).sum(dtype=np.uint64))) \
                if n else (0, 0)
            counts.append(n)
            firsts.append(key[0])
            seconds.append(key[1])
            fresh = n > 0 and key not in seen
            seen.add(key)
            prefixes.append(as_long(values[: prefix_length(n, percent, SLACK)]) if fresh else None)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("row"), pa.array(counts, pa.int64()),
            pa.array(as_long(np.array(firsts, np.uint64))), pa.array(as_long(np.array(seconds, np.uint64))),
            pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "row", "n", "set_a", "set_b", "prefix"])


def _column(batch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _runs(batches):
    """Rows ``(t, s, often)`` of sorted input whose ``t`` has ``often`` different ``s``, more than one. The first and the
    last ``t`` of a partition, which may go on in the next one, stay in any case, with a null ``often``."""
    def rows(t, s, often):
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(s, pa.int64()), often], ["t", "s", "often"])

    def unknown(n):
        return pa.nulls(n, pa.int64())

    first, t, s = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        t, s = (np.append(old, batch.column(c).to_numpy()) for old, c in ((t, "t"), (s, "s")))
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, s = t[new], s[new]
        first = t[0] if first is None else first
        done = int(np.searchsorted(t, t[-1]))  # the last run may go on in the next batch
        opening = int(np.searchsorted(t[:done], first, "right"))
        if opening:
            yield rows(t[:opening], s[:opening], unknown(opening))
        _, at, sizes = np.unique(t[opening:done], return_inverse=True, return_counts=True)
        often = sizes[at]
        many = often > 1
        yield rows(t[opening:done][many], s[opening:done][many], pa.array(often[many], pa.int64()))
        t, s = t[done:], s[done:]
    yield rows(t, s, unknown(len(t)))


def _long_prefixes(batches, percent: int):
    for batch in batches:
        parts = [v[: prefix_length(len(v), percent, LONG_SLACK)] for v in _column(batch, "shingles")]
        node = np.repeat(batch.column("node").to_numpy(), [len(p) for p in parts])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64()),
                                          pa.array(node, pa.int64())], ["t", "s"])


def _shared(postings: DataFrame) -> DataFrame:
    """Postings ``(t, s, often)`` of the shingles that several sets have. Rows are split by range, so the sets of a
    frequent shingle fall to many tasks."""
    return postings.repartitionByRange("t", "s").sortWithinPartitions("t", "s") \
        .mapInArrow(_runs, "t long, s long, often long")


def _full_sets(batches, width: int):
    for batch in batches:
        sets = list(shingle_sets(batch.column("text"), width))
        least = np.array([[int(mix(v * U64(c)).min()) for c in (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)] for v in sets],
                         np.uint64).reshape(len(sets), 2)
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in sets])]) if sets else np.zeros(1)
        flat = as_long(np.concatenate(sets) if sets else np.zeros(0, np.uint64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(as_long(least[:, 0].copy())), pa.array(as_long(least[:, 1].copy())),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["node", "m1", "m2", "shingles"])


def _bit_count(largest: int) -> int:
    """Bits of a bitmap for sets of up to so many shingles: a power of two, 16 per shingle or more."""
    return min(BITS_HIGH, max(BITS_LOW, 1 << int(16 * largest - 1).bit_length()))


def _bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, bool)
    # the low bits of a hash: half as long a bitmap is the OR of its halves
    out[(mix(values.view(np.uint64)) & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def _fold(bitmap: np.ndarray, words: int) -> np.ndarray:
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] | bitmap[..., half:]
    return bitmap


def _able(common: np.ndarray, low_a, high_a, low_b, high_b, percent: int) -> np.ndarray:
    """Whether sets of these sizes with at most ``common`` shingles in common can be linked."""
    most = np.minimum(common, np.minimum(high_a, high_b))
    return ((100 + percent) * most >= percent * (low_a + low_b)) & (100 * high_a >= percent * low_b) \
        & (100 * high_b >= percent * low_a)


class Tree:
    """Signature tree over leaves in the given order; level 0 are the leaves, the last level is one root. A level is
    ``(bitmaps, smallest sizes, largest sizes, excess)``."""

    def __init__(self, maps: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray):
        self.size = len(maps)
        self.levels = [(maps, low, high, excess)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, excess = self.levels[-1]
            starts = np.arange(0, len(maps), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(maps, starts), np.minimum.reduceat(low, starts),
                                np.maximum.reduceat(high, starts), np.maximum.reduceat(excess, starts)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], bits: int) -> Tree:
        sizes, maps = np.array([len(v) for v in sets], np.int64), np.stack([_bitmap(v, bits) for v in sets])
        return cls(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(1, dtype=np.int64))

    def children(self, level: int, nodes: np.ndarray) -> list[np.ndarray]:
        return [np.arange(n * FAN_OUT, min((n + 1) * FAN_OUT, len(self.levels[level - 1][0]))) for n in nodes]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Groups:
    """Union-find over the sets of one task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def _uniform(labels: np.ndarray, level: int) -> np.ndarray:
    """Per node of a level the group of all its sets, -1 if there are several."""
    for _ in range(level):
        starts = np.arange(0, len(labels), FAN_OUT)
        low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        labels = np.where(low == high, low, -1)
    return labels


def _walk(a: Tree, b: Tree, labels, percent: int):
    """Dual traversal of two trees: yields the pairs of leaves that may hold a link and differ in their label.
    ``labels()`` gives the labels of both trees' leaves as they are now. ``a is b`` walks a tree against itself."""
    todo = [(len(a.levels) - 1, len(b.levels) - 1, np.zeros(1, int), np.zeros(1, int))]
    while todo:
        la, lb, x, y = todo.pop()
        for at in range(0, len(x), 4096):
            i, j = x[at: at + 4096], y[at: at + 4096]
            left, right = labels()
            ga, gb = _uniform(left, la)[i], _uniform(right, lb)[j]
            other = (ga != gb) | (ga < 0)
            if a is b and la == lb == 0:
                other &= i < j
            i, j = i[other], j[other]
            ma, mb = a.levels[la], b.levels[lb]
            common = np.bitwise_count(ma[0][i] & mb[0][j]).sum(1, dtype=np.int64) + np.minimum(ma[3][i], mb[3][j])
            able = _able(common, ma[1][i], ma[2][i], mb[1][j], mb[2][j], percent)
            i, j = i[able], j[able]
            if la == lb == 0:
                yield from zip(i.tolist(), j.tolist(), strict=True)
            elif len(i):  # go down on the higher side, on both if level
                ca = a.children(la, i) if la >= lb else [np.array([n]) for n in i]
                cb = b.children(lb, j) if lb >= la else [np.array([n]) for n in j]
                left = np.concatenate([np.repeat(p, len(q)) for p, q in zip(ca, cb, strict=True)])
                right = np.concatenate([np.tile(q, len(p)) for p, q in zip(ca, cb, strict=True)])
                if a is b:
                    left, right = left[left <= right], right[left <= right]
                todo.append((la - (la >= lb), lb - (lb >= la), left, right))


def _alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = _overlap(p, q)
    return 100 * both >= percent * (len(p) + len(q) - both)


def links(a: list[np.ndarray], b: list[np.ndarray] | None, groups: Groups, percent: int):
    """Links ``(index in a, index in b)`` that join two groups; ``b`` of None is ``a`` itself. The sets of ``b`` stand
    behind those of ``a`` in ``groups``, which takes the links."""
    bits = _bit_count(max(len(v) for v in a + (b or [])))
    left = Tree.of_sets(a, bits)
    right, shift = (left, 0) if b is None else (Tree.of_sets(b, bits), len(a))
    b = a if b is None else b

    def labels():
        now = groups.roots()
        return now[: len(a)], now[shift: shift + len(b)]
    for u, v in _walk(left, right, labels, percent):
        if groups.root(u) != groups.root(v + shift) and _alike(a[u], b[v], percent):
            groups.join(u, v + shift)
            yield u, v


def _units(nodes: np.ndarray, sets: list[np.ndarray], percent: int):
    """Join a block with itself and cut the groups found into units: rows of the unit table."""
    groups = Groups(len(sets))
    for u in range(len(sets) - 1):  # neighbours first: most links of a large group are found without the tree
        if _alike(sets[u], sets[u + 1], percent):
            groups.join(u, u + 1)
    for _ in links(sets, None, groups, percent):
        pass
    labels, sizes = groups.roots(), np.array([len(v) for v in sets])
    order = np.lexsort((nodes, sizes, labels))
    cuts, total = [0], 0
    for k, at in enumerate(order):
        total += sizes[at]
        if k > cuts[-1] and (labels[at] != labels[order[k - 1]] or k - cuts[-1] == UNIT_SETS or total > UNIT_SHINGLES):
            cuts.append(k)
            total = sizes[at]
    for begin, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[begin:end]
        bits = _bit_count(int(sizes[own].max()))
        maps = np.stack([_bitmap(sets[k], bits) for k in own])
        excess, folded = [], maps
        for _ in range(3):  # as long as it is, halved and quartered: partners' bitmaps can be shorter
            excess.append(int((sizes[own] - np.bitwise_count(folded).sum(1, dtype=np.int64)).max()))
            folded = _fold(folded, max(folded.shape[1] // 2, BITS_LOW // 64))
        yield {"unit": int(nodes[own].min()), "part": int(nodes[labels == labels[own[0]]].min()),
               "low": int(sizes[own].min()), "high": int(sizes[own].max()), "excess": excess,
               "bits": as_long(np.bitwise_or.reduce(maps)), "members": nodes[own], "sizes": sizes[own],
               "shingles": as_long(np.concatenate([sets[k] for k in own]))}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [(c.split()[0], pa.list_(pa.int64()) if "array" in c else pa.int64()) for c in _EXACT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], [k for k, _ in kinds])


def _blocks(batches, percent: int):
    """Units of the blocks of a partition."""
    nodes, sets, total = [], [], 0

    def done():
        rows, held = [], 0
        for unit in _units(np.array(nodes, np.int64), sets, percent) if sets else ():
            rows.append(unit)
            held += len(unit["shingles"])
            if held > UNIT_SHINGLES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)
    for batch in batches:
        for node, values in zip(batch.column("node").to_pylist(), _column(batch, "shingles"), strict=True):
            if sets and (len(sets) == BLOCK_SETS or total + len(values) > BLOCK_SHINGLES):
                yield from done()
                nodes, sets, total = [], [], 0
            nodes.append(node)
            sets.append(values.view(np.uint64).copy())
            total += len(values)
    yield from done()


def _roots_of(maps: list[np.ndarray], low, high, excess: list[np.ndarray], words: int) -> Tree:
    """A tree over roots of units, their bitmaps folded to so many words."""
    known = [e[f] if (f := int(len(m) // words).bit_length() - 1) < len(e) else h
             for m, e, h in zip(maps, excess, high, strict=True)]
    return Tree(np.stack([_fold(m.view(np.uint64), words) for m in maps]), low, high, np.array(known, np.int64))


def _possible(batches, percent: int):
    """Pairs of units whose roots allow a link."""
    for batch in batches:
        size = {c: batch.column(c).to_numpy() for c in ("low_u", "high_u", "low_v", "high_v")}
        lists = {c: _column(batch, c) for c in ("bits_u", "bits_v", "excess_u", "excess_v")}
        keep = []
        for k in range(batch.num_rows):
            words = min(len(lists["bits_u"][k]), len(lists["bits_v"][k]))
            u, v = (_roots_of([lists[f"bits_{x}"][k]], size[f"low_{x}"][k: k + 1], size[f"high_{x}"][k: k + 1],
                              [lists[f"excess_{x}"][k]], words) for x in "uv")
            keep.append(any(True for _ in _walk(u, v, lambda: (np.zeros(1, int), np.ones(1, int)), percent)))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _crowd(table: pa.Table, percent: int) -> pa.Table:
    """Pairs of units of one or two chunks whose roots allow a link and whose components differ."""
    batch = table.combine_chunks().to_batches()[0]
    side, unit, component, low, high = (batch.column(c).to_numpy() for c in ("side", "unit", "component", "low", "high"))
    excess, maps = _column(batch, "excess"), _column(batch, "bits")
    words = np.array([len(m) for m in maps])
    found = []
    classes = [(s, w, np.flatnonzero((side == s) & (words == w))) for s in (0, 1) for w in np.unique(words)]
    alone = not side.any()
    for s, w, x in classes:
        for r, v, y in classes:
            if not len(x) or not len(y) or not (s == 0 and (w <= v if alone else r == 1)):
                continue
            trees = [_roots_of([maps[k] for k in z], low[z], high[z], [excess[k] for k in z], int(min(w, v))) for z in (x, y)]
            if alone and w == v:
                trees[1] = trees[0]
            for i, j in _walk(*trees, lambda x=x, y=y: (component[x], component[y]), percent):
                found.append((unit[x[i]], unit[y[j]]))
    pairs = np.sort(np.array(found, np.int64).reshape(-1, 2), axis=1)
    return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})


def _linked(batches, percent: int):
    """One link per pair of units that have any: each unit is one component already."""
    for batch in batches:
        found = []
        members, sizes, shingles = ([_column(batch, f"{c}_{x}") for x in "uv"] for c in ("members", "sizes", "shingles"))
        for k in range(batch.num_rows):
            sides = [np.split(shingles[x][k].view(np.uint64), np.cumsum(sizes[x][k])[:-1]) for x in (0, 1)]
            link = next(links(*sides, Groups(len(sides[0]) + len(sides[1])), percent), None)
            if link:
                found.append((members[0][k][link[0]], members[1][k][link[1]]))
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["u", "v"])


def _compare(pairs: DataFrame, units: DataFrame, percent: int, label: str) -> DataFrame:
    """Links between units that are paired, roots first."""
    def side(x, *columns):
        return units.select(F.col("unit").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    roots = ["low", "high", "excess", "bits"]
    able = pairs.join(side("u", *roots), "u").join(side("v", *roots), "v") \
        .mapInArrow(partial(_possible, percent=percent), "u long, v long")
    able = materialize(able, f"{label}-able")
    sets = ["members", "sizes", "shingles"]
    return materialize(able.join(side("u", *sets), "u").join(side("v", *sets), "v").mapInArrow(
        partial(_linked, percent=percent), "u long, v long"), f"{label}-links")


def ngram_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row; links are pairs of documents whose ``width``-word shingle sets
    have at least ``percent`` hundredths of their union in common."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .withColumn("row", F.xxhash64("text"))
    profiles = materialize(texts.mapInArrow(
        partial(_profiles, width=width, percent=percent),
        "doc_id long, row long, n long, set_a long, set_b long, prefix array<long>"), "ngram-profiles")
    key = ["n", "set_a", "set_b"]
    classes = materialize(profiles.where("n > 0").groupBy(*key).agg(
        F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("text"))
        .withColumn("node", F.coalesce("first", "set_a")), "ngram-classes")

    short = _shared(profiles.where("prefix is not null").select(F.explode("prefix").alias("t"), F.col("set_a").alias("s")))
    left = short.groupBy("s").agg(F.count("*").alias("common")).join(classes.withColumnRenamed("set_a", "s"), "s") \
        .where(F.col("common") >= needed(F.col("n"), percent, SLACK))
    wanted = materialize(left.select("node", F.col("text.doc_id").alias("_id"), F.col("text.row").alias("_row")),
                         "ngram-wanted")
    # the list of wanted texts grows with the corpus: joined by a shuffle at any size
    bodies = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))) \
        .groupBy("node").agg(F.first("text").alias("text"))
    sets = materialize(bodies.mapInArrow(partial(_full_sets, width=width),
                                         "node long, m1 long, m2 long, shingles array<long>"), "ngram-sets")
    shared = materialize(_shared(sets.mapInArrow(partial(_long_prefixes, percent=percent), "t long, s long")), "ngram-shared")
    edges = shared.where("often is null")
    counted = edges.groupBy("t").agg(F.countDistinct("s").alias("often")).where("often > 1")
    known = shared.where("often is not null").union(edges.drop("often").join(counted, "t"))
    rank = F.row_number().over(W.partitionBy("s").orderBy(F.col("often").desc(), "t"))
    held = known.withColumn("rank", rank).join(sets.select(F.col("node").alias("s"), F.size("shingles").alias("n")), "s") \
        .where(F.col("rank") >= needed(F.col("n"), percent, LONG_SLACK))
    kept = materialize(held.select("t", F.col("s").alias("node")), "ngram-kept")
    sets = sets.join(kept.select("node").distinct(), "node", "left_semi")

    units = materialize(sets.repartitionByRange("m1", "m2", "node").sortWithinPartitions("m1", "m2", "node")
                        .mapInArrow(partial(_blocks, percent=percent), _EXACT), "ngram-units")
    inside = units.select("part", F.explode("members").alias("node"))
    pairs = [inside.where("part <> node").select(F.col("part").alias("u"), F.col("node").alias("v"))]
    places = units.select("unit", "part", "low", "high", F.explode("members").alias("node"))
    spots = kept.join(places, "node").select("t", "unit", "part", "low", "high").distinct()
    # of shingles that the same units have, one is enough
    lists = spots.groupBy("t").agg(F.count("*").alias("m"), F.sum(F.xxhash64("unit") % (1 << 40)).alias("h"),
                                   F.sum(F.xxhash64("unit", F.lit(1)) % (1 << 40)).alias("k"), F.min("unit").alias("least"),
                                   F.min("part").alias("a"), F.max("part").alias("b")).where("a < b")
    chosen = lists.groupBy("m", "h", "k", "least").agg(F.min("t").alias("t")).select("t")
    spots = materialize(spots.join(chosen, "t"), "ngram-spots")

    fits = (100 * F.col("b.high") >= percent * F.col("a.low")) & (100 * F.col("a.high") >= percent * F.col("b.low"))
    pair = [F.least("a.unit", "b.unit").alias("u"), F.greatest("a.unit", "b.unit").alias("v")]
    # one unit of every component of a shingle with its smallest one
    ends = spots.groupBy("t", "part").agg(F.min(F.struct("unit", "low", "high")).alias("x")) \
        .select("t", "part", "x.unit", "x.low", "x.high")
    leaders = ends.groupBy("t").agg(F.min(F.struct("part", "unit", "low", "high")).alias("x"), F.count("*").alias("m")) \
        .where("m > 1").select("t", "x.part", "x.unit", "x.low", "x.high")
    stars = leaders.alias("a").join(ends.alias("b"), (F.col("a.t") == F.col("b.t")) & (
        F.col("a.part") < F.col("b.part")) & fits).select(*pair).distinct()
    pairs.append(_compare(materialize(stars, "ngram-stars"), units, percent, "ngram-star"))
    found = connected_components(pairs[1].join(inside.select(F.col("node").alias("u"), F.col("part").alias("pu")), "u")
                                 .join(inside.select(F.col("node").alias("v"), F.col("part").alias("pv")), "v")
                                 .select(F.col("pu").alias("u"), F.col("pv").alias("v")), "ngram-parts")
    # all units of different components that still share a shingle
    now = spots.join(found.select(F.col("id").alias("part"), "component"), "part", "left") \
        .withColumn("component", F.coalesce("component", "part"))
    apart = now.groupBy("t").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")) \
        .where("x < y").select("t", "m")
    open_ = materialize(now.join(apart, "t"), "ngram-open")
    few = open_.where(F.col("m") <= CROWD)
    rest = few.alias("a").join(few.alias("b"), (F.col("a.t") == F.col("b.t")) & (
        F.col("a.component") < F.col("b.component")) & fits).select(*pair).distinct()

    def meet(table: pa.Table) -> pa.Table:
        return _crowd(table, percent)
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    dealt = open_.where(F.col("m") > CROWD).withColumn("own", F.pmod(F.xxhash64("unit"), chunks).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))).select(
            "t", "unit", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"))
    crowds = dealt.join(units.select("unit", "low", "high", "excess", "bits"), "unit").groupBy("t", "i", "j") \
        .applyInArrow(meet, "u long, v long")
    rest = rest.union(crowds).distinct()
    rest = rest.join(stars, ["u", "v"], "left_anti")
    pairs.append(_compare(materialize(rest, "ngram-rest"), units, percent, "ngram-rest"))
    edges = pairs[0].union(pairs[1]).union(pairs[2])
    found = connected_components(edges, "ngram-components")
    named = found.join(classes.select(F.col("node").alias("id"), "first"), "id")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = materialize(named.join(least, "component").select(F.col("id").alias("node"), "component_id"), "ngram-ids")
    labelled = classes.join(ids, "node", "left").select(*key, F.coalesce("component_id", "first").alias("class_id"))
    return profiles.select("doc_id", *key).join(labelled, key, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"))
