"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes (a window) that also starts anywhere else, in the same or in
another document.

1. Winnowing sends equal windows to the same place: each window is named by its least ``GRAM``-byte hash, so equal
   windows have equal names. Consecutive windows named by one position form a piece, a stretch of text. Only pieces
   whose name occurs at least twice can hold a repeated window. Equal pieces are counted and kept once.
2. The remaining pieces are dealt to shards by their names. Each shard builds the suffix array of its pieces by
   Larsson-Sadakane refinement (only groups that are still tied are sorted again, by the rank ``h`` places on), then
   Kasai's common prefixes. A run of suffixes with common prefixes of ``LENGTH`` is one repeated string if its pieces
   count to two or more.
3. A name with too many bytes for one shard is spread over several. Their strings are merged afterwards: the sorted
   strings of one shard are looked up in those of the others by binary search.
4. Repeated windows go back to the documents that hold the pieces, and their bytes are cut.

Cases: null texts are empty; texts shorter than a window keep all bytes; repeated rows are documents of their own, so
all of a repeated long text goes. Matches never cross documents. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bytetext import U64, as_long, mix, prefix_hash, stretch_hash, text_slices

LENGTH, GRAM = 200, 64
#: Bytes of pieces in one suffix array.
SHARD_BYTES = 2 << 20
#: Lists of document keys up to this length are broadcast; longer ones are joined by a shuffle.
BROADCAST_KEYS = 500_000
_CHUNK, _PLACE_BITS = 1 << 20, 21


def _window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash (the leftmost of equals) in each run of ``width`` hashes: minima of blocks from
    both sides."""
    out = np.empty(len(grams) - width + 1, np.int64)
    for lo in range(0, len(out), _CHUNK):
        part = grams[lo: lo + _CHUNK + width - 1]
        places = np.arange(len(part), dtype=np.uint64)
        keys = (part >> U64(_PLACE_BITS) << U64(_PLACE_BITS)) | places
        n = len(part) - width + 1
        blocks = np.concatenate([keys, np.full(-len(keys) % width, ~U64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[width - 1: width - 1 + n])
        out[lo: lo + n] = (least & U64((1 << _PLACE_BITS) - 1)).astype(np.int64) + lo
    return out


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """``(row, start in the row, windows, name, content hash)`` arrays of the pieces of texts laid end to end."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = stretch_hash(sums, at, at + gram)
    place = _window_minima(grams, length - gram + 1)
    edge = np.zeros(len(data) + 2, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(edge, offsets[:-1][long], 1)
    np.add.at(edge, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(edge)[: len(place)] > 0
    fresh = valid.copy()
    fresh[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    ends = valid.copy()
    ends[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    first, last = np.flatnonzero(fresh), np.flatnonzero(ends)
    row = np.searchsorted(offsets, first, "right") - 1
    content = stretch_hash(sums, first, last + length)
    return row, first - offsets[row], last - first + 1, grams[place[first]], content


def _names(batches, full: bool):
    """Rows of pieces: name only, or name, content, document key, start and number of windows."""
    for batch in batches:
        keys = batch.column("key")
        for row, _, data, offsets in text_slices(batch.column("text")):
            owner, start, windows, name, content = pieces(data, offsets)
            if not full:
                yield pa.RecordBatch.from_arrays([pa.array(as_long(name))], ["name"])
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(name)), pa.array(as_long(content)), keys.take(pa.array(owner + row)),
                 pa.array(start), pa.array(windows.astype(np.int32))],
                ["name", "content", "key", "start", "windows"])


def _cut_out(batches):
    """The bytes of the chosen pieces of each document."""
    for batch in batches:
        rows = []
        for text, chosen in zip(batch.column("text").to_pylist(), batch.column("chosen").to_pylist(), strict=True):
            raw = text.encode()
            rows += [(c["name"], c["content"], c["copies"], c["shard"], c["split"], c["windows"],
                      raw[c["start"]: c["start"] + c["windows"] + LENGTH - 1]) for c in chosen]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                                         ["name", "content", "copies", "shard", "split", "windows", "bytes"])


def suffix_order(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first ``length`` bytes. ``data`` must end in ``length`` bytes of padding, whose
    suffixes are left out. Larsson-Sadakane: ranks by the first ``h`` bytes, then ``2 h``; settled suffixes rest."""
    n = len(data) - length
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    key = np.zeros(len(data), np.uint64)
    for k in range(8):
        key = (key << U64(8)) | padded[k: k + len(data)]
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(data) + length, np.int64)
    rank[len(data):] = 0

    def number(values: np.ndarray, positions: np.ndarray, base: np.ndarray | None):
        """Ranks of sorted suffixes: the place of the first of each group of equals."""
        fresh = np.ones(len(values), bool)
        fresh[1:] = values[1:] != values[:-1]
        if base is None:
            starts = np.flatnonzero(fresh)
            rank[positions] = starts[np.cumsum(fresh) - 1]
        else:
            starts = np.flatnonzero(fresh)
            rank[positions] = base[starts[np.cumsum(fresh) - 1]]
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        return tied

    tied = number(key[order], order, None)
    h = 8
    while h < length and tied.any():
        step = min(h, length - h)
        places = np.flatnonzero(tied) if h == 8 else slots[tied]
        active = order[places]
        pair = (rank[active].astype(np.uint64) << U64(32)) | rank[active + step].astype(np.uint64)
        inner = np.argsort(pair, kind="stable")
        order[places] = active[inner]
        slots = places
        tied = number(pair[inner], active[inner], places)
        h += step
    return order[order < n]


def common_prefixes(data: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Kasai: bytes, up to ``length``, that each suffix shares with its predecessor in ``order``; indexed by position.

    Kasai walks the text, because a suffix shares at most one byte less than the suffix one place before it. Here every
    ``STRIDE``-th position starts afresh and all of those walk on together, eight bytes at a time.
    """
    stride, n = 16, len(data) - length
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    # The eight bytes from each position as one number, first byte lowest.
    eight = np.zeros(len(data) + 8, np.uint64)
    for k in range(8):
        eight |= padded[k: k + len(eight)].astype(np.uint64) << U64(8 * k)
    shared = np.zeros(n, np.int64)

    def extend(at: np.ndarray, known: np.ndarray) -> np.ndarray:
        out, live = known.copy(), np.flatnonzero(before[at] >= 0)
        out[before[at] < 0] = 0
        while len(live):
            i, j, l = at[live], before[at[live]], out[live]
            unequal = eight[i + l] ^ eight[j + l]
            low = unequal & (~unequal + U64(1))
            same = np.where(unequal == 0, 8, np.log2(np.maximum(low, U64(1)).astype(np.float64)).astype(np.int64) // 8)
            out[live] = np.minimum(l + same, length)
            live = live[(same == 8) & (out[live] < length)]
        return out

    at = np.arange(0, n, stride)
    known = extend(at, np.zeros(len(at), np.int64))
    shared[at] = known
    for _ in range(stride - 1):
        at, known = at + 1, known
        keep = at < n
        at, known = at[keep], known[keep]
        # Suffixes tied over the whole length have no fixed order, so nothing follows for their successors.
        known = extend(at, np.where(known < length, np.maximum(known - 1, 0), 0))
        shared[at] = known
    return shared


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    change = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def search_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of one shard as ``(name, content, first, last)`` window numbers of a piece; for pieces of
    split names also one row per distinct string, with its hashes and count, for the merge."""
    blocks = [np.frombuffer(b, np.uint8) for b in frame["bytes"]]
    sizes = np.array([len(b) for b in blocks])
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    data = np.concatenate([*blocks, np.zeros(LENGTH, np.uint8)])
    windows = frame["windows"].to_numpy(np.int64)
    n = len(data) - LENGTH
    weight = np.zeros(n + 1, np.int64)
    np.add.at(weight, starts, frame["copies"].to_numpy(np.int64))
    np.add.at(weight, starts + windows, -frame["copies"].to_numpy(np.int64))
    weight = np.cumsum(weight)[:n]
    order = suffix_order(data)
    shared = common_prefixes(data, order)
    fresh = shared[order] < LENGTH
    fresh[0] = True
    group = np.cumsum(fresh) - 1
    total = np.bincount(group, weights=weight[order]).astype(np.int64)
    repeated = np.zeros(n, bool)
    repeated[order] = total[group] >= 2
    repeated &= weight > 0
    a, b = _runs(repeated)
    # A run may pass from the windows of one piece to those of the next only across bytes without windows.
    piece = np.searchsorted(starts, a, "right") - 1
    names, contents = frame["name"].to_numpy(), frame["content"].to_numpy()
    out = pd.DataFrame({"name": names[piece], "content": contents[piece], "first": a - starts[piece],
                        "last": b - 1 - starts[piece]})
    out["string_a"], out["string_b"], out["count"] = 0, 0, 0
    split = frame["split"].to_numpy(bool)
    if split.any():
        inside = np.zeros(n, bool)
        for s, w in zip(starts[split], windows[split], strict=True):
            inside[s: s + w] = True
        wanted = order[inside[order]]
        groups = group[inside[order]]
        first = np.ones(len(groups), bool)
        first[1:] = groups[1:] != groups[:-1]
        at, totals = wanted[first], total[groups[first]]
        sums = prefix_hash(data)
        other = prefix_hash(data ^ 0xA5)
        owner = np.searchsorted(starts, at, "right") - 1
        out = pd.concat([out, pd.DataFrame({
            "name": names[owner], "content": contents[owner], "first": at - starts[owner], "last": at - starts[owner],
            "string_a": as_long(stretch_hash(sums, at, at + LENGTH)),
            "string_b": as_long(stretch_hash(other, at, at + LENGTH)), "count": totals})])
    return out


_FOUND = "name long, content long, first long, last long, string_a long, string_b long, count long"


def merge_shards(frame: pd.DataFrame) -> pd.DataFrame:
    """Strings of split names that several shards hold: each one is looked up in the sorted list of all."""
    lists = frame.sort_values(["string_a", "string_b"], kind="stable").reset_index(drop=True)
    own = lists["string_a"].to_numpy()
    low, high = np.searchsorted(own, own, "left"), np.searchsorted(own, own, "right")
    several = lists[(high - low) > 1]
    totals = several.groupby(["string_a", "string_b"])["count"].transform("sum")
    return several[totals >= 2]


def _remove(batches, length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, gone, spans, marks = batch.column("doc_id"), [], [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
            raw = (text or "").encode()
            runs: list[list[int]] = []
            for a, b in sorted((f["a"], f["b"]) for f in found or []):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            sizes.append(len(raw))
            gone.append(sum(b - a for a, b in runs))
            spans.append(len(runs))
            marks.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in (sizes, gone, spans)],
                                          pa.array(marks, pa.string())],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _near_keys(texts: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join that moves no text while the list of keys is short."""
    return texts.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", how)


def repeated_ranges(texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(key, found)``: byte ranges of repeated windows of each document of ``texts(key, text)`` that has any."""
    twice = texts.mapInArrow(partial(_names, full=False), "name long").groupBy("name").agg(
        F.count("*").alias("n")).where("n > 1").select("name")
    held = materialize(texts.mapInArrow(partial(_names, full=True), "name long, content long, key long, start long, "
                       "windows int").join(twice, "name"), "suffix-pieces")
    distinct = held.groupBy("name", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("key", "start")).alias("at"), F.min("windows").alias("windows"))
    distinct = materialize(distinct, "suffix-distinct")
    weight = F.col("windows") + LENGTH - 1
    total = distinct.agg(F.sum(weight)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    large = distinct.groupBy("name").agg(F.sum(weight).alias("b")).where(F.col("b") > shard_bytes // 2) \
        .select("name", F.ceil(2 * F.col("b") / shard_bytes).alias("parts"))
    placed = distinct.join(large, "name", "left").withColumn("split", F.col("parts").isNotNull()).withColumn(
        "shard", F.pmod(F.xxhash64("name", F.when(F.col("split"), F.pmod("content", F.col("parts")))), F.lit(shards)))
    chosen = materialize(placed.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct(
        "name", "content", "copies", "shard", "split", "windows", F.col("at.start").alias("start"))).alias("chosen")),
        "suffix-chosen")
    blocks = _near_keys(texts, chosen.select("key"), "left_semi").join(chosen, "key").select("text", "chosen") \
        .mapInArrow(_cut_out, "name long, content long, copies long, shard long, split boolean, windows int, "
                              "bytes binary")
    found = materialize(blocks.groupBy("shard").applyInPandas(search_shard, _FOUND), "suffix-found")
    merged = found.where("count > 0").groupBy(F.pmod("string_a", F.lit(4 * shards)).alias("m")) \
        .applyInPandas(merge_shards, _FOUND)
    ranges = found.where("count = 0").union(merged).select("name", "content", "first", "last").distinct()
    return held.select("name", "content", "key", "start").join(ranges, ["name", "content"]).groupBy("key").agg(
        F.collect_set(F.struct((F.col("start") + F.col("first")).alias("a"),
                               (F.col("start") + F.col("last") + LENGTH).alias("b"))).alias("found"))


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("key", F.xxhash64("doc_id", "text"))
    ranges = materialize(repeated_ranges(texts.select("key", "text"), shard_bytes), "suffix-ranges")
    keys = ranges.select("key")
    cut = _near_keys(texts, keys, "left_semi").join(ranges, "key").select("doc_id", "text", "found").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = _near_keys(texts, keys, "left_anti").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return cut.union(whole)
