"""Groups of spelling variants: words one edit apart, found by PartEnum signatures.

A word's letters with their repetition number ("a", "a again", ...) are the set bits of a binary vector. A replaced
letter changes at most two bits, an inserted or deleted one changes one. PartEnum deals the bits into first-level
groups, of which one must differ in few bits, and each group's bits into parts; every choice of all parts but as many
as can differ gives one exact signature, and two near words agree on at least one. Words of equal length take the
scheme for distance two, words of neighbouring lengths that for distance one. Bits are dealt so that all parts hold
equally many letters of the corpus.

Anagrams and their like share signatures in great numbers, so a signature is keyed with one half of the word: an edit
leaves the first or the last half of the shorter word as it was. Words that share a key meet in an equality join and
are verified by edit distance. A key held by more than ``CROWD`` words is not paired whole: its words meet under what is
left of the word without one letter, at that letter's place. Words of one such key differ in that one place, or are the
word itself and its one-letter extensions, so it holds at most an alphabet of words whatever the corpus. Near words
always share such a key, so nothing is lost.

Cases: null, empty and wordless texts have no words. In rows without ``doc_id`` no letter is deleted; rows with the
same id count each. Long texts are read in stretches that end between words, and each task passes on counts of a
bounded number of distinct words at a time. Ties of the most frequent near word go to the smallest in code-point
order. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bytetext import U64, as_long, mix

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
#: Words of one key that are still compared with each other directly.
CROWD = 200
#: Repetitions of a letter whose bits are dealt by frequency; bits of later ones by a hash.
DEALT = 8
STRETCH, DISTINCT = 1 << 20, 200_000
#: Shorter runs cannot give a word.
_RUN, _OTHER = re.compile(f"[{LETTERS}]{{{MIN_LENGTH},}}"), re.compile(f"[^{LETTERS}]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_MASK = (1 << 64) - 1


def _runs(text: str):
    """Lists of the letter runs of ``text``, one per stretch."""
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, min(at + STRETCH, len(text)))
        end = cut.start() if cut else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def _thinned(doc_id, word: str) -> str:
    """``word``, without one letter if the hash of its document and itself says so."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _counted(batches):
    """Partial counts ``(word, n)``; words are kept in memory until there are ``DISTINCT`` of them."""
    counts: Counter = Counter()

    def flush():
        rows = [(w, n) for w, n in counts.items() if len(w) >= MIN_LENGTH]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()),
                                           pa.array([n for _, n in rows], pa.int64())], ["word", "n"])
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            doc_id = doc_id.as_py()
            for runs in _runs(text.as_py() or ""):
                for run, n in Counter(runs).items():
                    word = run.translate(_LOWER)
                    counts[word if doc_id is None else _thinned(doc_id, word)] += n
                if len(counts) >= DISTINCT:
                    yield flush()
    yield flush()


def frequent_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the words of at least ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= MIN_COUNT)


def _hash(*parts: int) -> int:
    x = 0x9E3779B97F4A7C15
    for p in parts:
        x = ((x ^ p) * 0xBF58476D1CE4E5B9) & _MASK
        x ^= x >> 29
        x = (x * 0x94D049BB133111EB) & _MASK
        x ^= x >> 32
    return x


def _bits(word: str):
    seen: dict[str, int] = {}
    for letter in word:
        again = seen.get(letter, 0)
        seen[letter] = again + 1
        yield letter, again


class PartEnum:
    """Signatures of letter multisets for a Hamming distance: ``first`` groups of ``second`` parts each.

    ``common`` lists bits by falling frequency; each goes to the part that holds least so far."""

    def __init__(self, distance: int, first: int, second: int, common: list[tuple[str, int, int]] = ()):
        self.first, self.second = first, second
        differing = distance // first
        if differing >= second:
            raise ValueError("a group needs more parts than can differ")
        self.choices = list(combinations(range(second), second - differing))
        self.parts = first * second
        self.places: dict[tuple[str, int], tuple[int, int]] = {}
        load = [0] * self.parts
        for letter, again, n in common:
            part = load.index(min(load))
            load[part] += n
            self.places[letter, again] = part, _hash(ord(letter), again, 2)

    def _place(self, bit: tuple[str, int]) -> tuple[int, int]:
        found = self.places.get(bit)
        return found or (_hash(ord(bit[0]), bit[1], 1) % self.parts, _hash(ord(bit[0]), bit[1], 2))

    def signatures(self, words: list[str]) -> np.ndarray:
        """One row per word, one column per signature."""
        sums = np.zeros((len(words), self.parts), np.uint64)
        for row, word in zip(sums, words, strict=True):
            own = [0] * self.parts
            for bit in _bits(word):
                part, value = self._place(bit)
                own[part] += value  # the bits of a part in any order
            row[:] = [v & _MASK for v in own]
        out = []
        for group in range(self.first):
            for number, choice in enumerate(self.choices):
                total = np.full(len(words), 1 + group * len(self.choices) + number, np.uint64)
                for part in choice:
                    total = mix(total * U64(0xD1342543DE82EF95) + sums[:, group * self.second + part])
                out.append(total)
        return np.stack(out, axis=1)


def _halves(words: list[str], shorter: int) -> np.ndarray:
    """Hashes of the two ends of each word that survive an edit, if the shorter word of a pair lacks ``shorter``
    letters of this one."""
    out = np.zeros((len(words), 2), np.uint64)
    for row, word in zip(out, words, strict=True):
        size = len(word) - shorter
        head, tail = word[:size // 2], word[len(word) - (size - size // 2):]
        row[:] = size << 33 | zlib.crc32(head.encode()), size << 33 | 1 << 32 | zlib.crc32(tail.encode())
    return out


def _bit_counts(batches):
    counts: Counter = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            counts.update(bit for bit in _bits(word) if bit[1] < DEALT)
    rows = list(counts.items())
    yield pa.RecordBatch.from_arrays([pa.array([b[0] for b, _ in rows], pa.string()),
                                      pa.array([b[1] for b, _ in rows], pa.int32()),
                                      pa.array([n for _, n in rows], pa.int64())], ["letter", "again", "n"])


def _keyed(batches, common):
    replaced, inserted = PartEnum(2, 1, 4, common), PartEnum(1, 1, 3, common)
    for batch in batches:
        words = batch.column("word").to_pylist()
        keys = []
        for scheme, shorter, sort in ((replaced, 0, 1), (inserted, 0, 2), (inserted, 1, 2)):
            ends = mix(_halves(words, shorter) + U64(sort << 50))
            keys.append(mix(scheme.signatures(words)[:, :, None] ^ ends[:, None, :]).reshape(len(words), -1))
        flat = as_long(np.concatenate(keys, axis=1).ravel()) if words else np.zeros(0, np.int64)
        at = pa.array(np.repeat(np.arange(len(words)), len(flat) // max(len(words), 1)))
        yield pa.RecordBatch.from_arrays([batch.column("word").take(at), pa.array(flat)], ["word", "k"])


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of words that differ by exactly one inserted, deleted or replaced letter."""
    # at most an alphabet times DEALT rows
    common = words.select("word").mapInArrow(_bit_counts, "letter string, again int, n long") \
        .groupBy("letter", "again").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "letter", "again").collect()
    keyed = words.select("word").mapInArrow(partial(_keyed, common=[tuple(r) for r in common]),
                                            "word string, k long").repartition("k")  # the one shuffle of all keys
    sizes = keyed.groupBy("k").agg(F.count("*").alias("m")).where("m > 1")
    member = keyed.join(sizes.where(F.col("m") <= CROWD).select("k"), "k")
    crowded = materialize(keyed.join(sizes.where(F.col("m") > CROWD).select("k"), "k"), "spelling-crowds")
    x, y = F.col("a.word"), F.col("b.word")
    plain = member.alias("a").join(member.alias("b"), (F.col("a.k") == F.col("b.k")) & (x < y) & (
        F.abs(F.char_length(x) - F.char_length(y)) <= 1) & (F.levenshtein(x, y, 1) == 1))
    left_out = crowded.select("k", "word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("at")).select(
        "k", "word", "at", F.concat(F.expr("substring(word, 1, at - 1)"), F.expr("substring(word, at + 1)")).alias("rest"))
    replaced = left_out.alias("a").join(left_out.alias("b"), (F.col("a.k") == F.col("b.k")) & (
        F.col("a.at") == F.col("b.at")) & (F.col("a.rest") == F.col("b.rest")) & (x < y))
    inserted = left_out.alias("a").join(crowded.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.rest") == y))
    pairs = [p.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for p in (plain, replaced, inserted)]
    return pairs[0].union(pairs[1]).union(pairs[2]).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` by pointer doubling; ``forms(word, form)`` has no cycles, since counts at least double."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.alias("x").join(now.alias("y"), F.col("x.root") == F.col("y.word"), "left")
        now = materialize(further.select("x.word", F.coalesce("y.root", "x.root").alias("root"),
                                         F.col("y.root").isNotNull().alias("moved")), "spelling-roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per frequent word: the near word it is a variant of, and the last of
    the chain of such words."""
    words = materialize(frequent_words(docs), "spelling-words")
    pairs = materialize(near_words(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"),
                                       F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_variant = -F.col("best.less") >= RATIO * F.col("n")
    chosen = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_variant, F.col("best.near")).alias("form"),
        F.when(is_variant, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(chosen.where("form is not null"))
    return chosen.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                     "n_near", "form_n")
