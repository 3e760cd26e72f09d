"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index holds one posting ``(term, doc, pos)`` for each document word that some test item uses, written once to
the shared folder. Every window of a test item is looked up by its rarest term: a posting of that term fixes where
the item would have to start in the document (the diagonal). For those diagonals alone the offset-adjusted lists of
all terms are intersected; runs of matched positions as long as a window are exact phrase matches.

Cases: null and empty texts have no words. Rows with the same id and text are one document. Item rows with the same id
and different texts are looked up one by one and listed once; item rows without id count as hits and are not listed.
Empty tables give empty lists. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WINDOW = 13
#: Tables of at most so many rows (three or four numbers each) are broadcast; larger ones are joined by shuffles.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    """Words in their original case; the first and last may be empty."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), _BETWEEN)


def _folded(word: Column) -> Column:
    """A-Z in lower case, all else unchanged; the fast form is right for pure ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)) \
        .otherwise(F.translate(word, _UPPER, _LOWER))


def document_key() -> Column:
    """Names a document in postings; equal rows share it."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast behind a check of the size."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, ipos, term, word)`` with positions from 0; an ``item_id`` names one text."""
    exploded = items.where("item_id is not null").select("item_id", F.posexplode(F.filter(_words(F.col("text")), lambda w: w != ""))
                            .alias("ipos", "word"))
    return exploded.select("item_id", "ipos", F.xxhash64(_folded(F.col("word"))).alias("term"),
                           _folded(F.col("word")).alias("word")).distinct()


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``(term, doc, pos)`` of the words in ``terms(term, word)``, stored in the shared folder."""
    exploded = docs.select(document_key().alias("doc"), F.posexplode(_words(F.col("text"))).alias("pos", "raw")) \
        .select("doc", "pos", _folded(F.col("raw")).alias("raw"))
    found = exploded.select("doc", "pos", "raw", F.xxhash64("raw").alias("term")).join(_small(terms), "term")
    return materialize(found.where("raw = word").select("term", "doc", "pos"), "decontam-postings")


def _diagonals(index: DataFrame, placed: DataFrame, window: int) -> DataFrame:
    """``(doc, item_id, start)``: where an item would begin in a document, judged by the rarest term of some window."""
    rarity = index.groupBy("term").agg(F.count("*").alias("df"))
    sizes = placed.groupBy("item_id").agg((F.max("ipos") + 1).alias("n"))
    ranked = placed.join(rarity, "term", "left").join(sizes, "item_id") \
        .withColumn("df", F.coalesce("df", F.lit(0))) \
        .withColumn("len", F.least(F.col("n"), F.lit(window)))
    windows = ranked.select("item_id", "ipos", "term", "df", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("ipos") - F.col("len") + 1), F.least(F.col("ipos"), F.col("n") - F.col("len"))))
        .alias("w"))
    rarest = windows.groupBy("item_id", "w").agg(F.min(F.struct("df", "ipos", "term")).alias("r"))
    anchors = rarest.where("r.df > 0").select("item_id", F.col("r.ipos").alias("ipos"), F.col("r.term").alias("term")) \
        .distinct()
    return index.join(_small(anchors), "term").select("doc", "item_id", (F.col("pos") - F.col("ipos")).alias("start")) \
        .distinct()


def phrase_matches(index: DataFrame, placed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc, item_id, start, hits)``: document positions inside exact occurrences of item windows on one diagonal."""
    diagonals = materialize(_diagonals(index, placed, window), "decontam-diagonals")
    sizes = placed.groupBy("item_id").agg((F.max("ipos") + 1).alias("n"))
    spans = diagonals.join(_small(sizes), "item_id").select("doc", "item_id", "start", "n")
    lists = index.join(_small(spans), "doc").where("pos >= start and pos < start + n") \
        .select("doc", "item_id", "start", "n", "term", (F.col("pos") - F.col("start")).alias("ipos"))
    matched = lists.join(_small(placed.select("item_id", "ipos", "term")), ["item_id", "ipos", "term"])
    grouped = matched.groupBy("doc", "item_id", "start").agg(
        F.first("n").alias("n"), F.array_sort(F.collect_set("ipos")).alias("at"))
    size = F.least(F.col("n"), F.lit(window))
    begins = F.filter(F.sequence(F.lit(0), F.size("at") - size),
                      lambda i: F.get(F.col("at"), i + size - 1) == F.get(F.col("at"), i) + size - 1)
    runs = grouped.where(F.size("at") >= size).withColumn("begins", begins).where(F.size("begins") > 0)
    covered = F.array_distinct(F.flatten(F.transform("begins", lambda i: F.sequence(
        F.col("start") + F.get(F.col("at"), i), F.col("start") + F.get(F.col("at"), i) + size - 1))))
    return runs.select("doc", "item_id", "start", covered.alias("hits"))


def proximity_matches(index: DataFrame, placed: DataFrame, least_share: float = 0.8, slack: int = 4,
                      window: int = WINDOW) -> DataFrame:
    """``(doc, item_id, start, share)``: diagonals around which at least ``least_share`` of an item's distinct terms
    stand within ``slack`` positions of their place, in any order."""
    diagonals = _diagonals(index, placed, window)
    sizes = placed.groupBy("item_id").agg((F.max("ipos") + 1).alias("n"), F.countDistinct("term").alias("terms"))
    spans = diagonals.join(_small(sizes), "item_id")
    lists = index.join(_small(spans), "doc").where(f"pos >= start - {slack} and pos < start + n + {slack}")
    near = lists.join(_small(placed.select("item_id", F.col("term"), "ipos")), ["item_id", "term"]) \
        .where(F.abs(F.col("pos") - F.col("start") - F.col("ipos")) <= slack)
    return near.groupBy("doc", "item_id", "start").agg(
        (F.countDistinct("term") / F.first("terms")).alias("share")).where(F.col("share") >= least_share)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, doc, n_words, n_hit, item_ids, contaminated)`` per document; ``item_ids`` are sorted as strings and
    ``doc`` is ``document_key()`` of the row."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = F.xxhash64("item_id", F.col("text").cast("string"))  # each text of an item by itself
    named = items.select(key.alias("item"), F.col("item_id").cast("string").alias("name")).distinct()
    placed = materialize(item_terms(items.select(key.alias("item_id"), "text")), "decontam-items")
    index = build_index(texts, placed.select("term", "word").distinct())
    matches = phrase_matches(index, placed.select("item_id", "ipos", "term"), window)
    per_doc = materialize(matches.join(_small(named), F.col("item_id") == F.col("item")).groupBy("doc").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set("name")).alias("item_ids")), "decontam-hits")
    parts = _words(F.col("text"))
    edge = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    counted = texts.select("doc_id", document_key().alias("doc"), (F.size(parts) - edge).cast("long").alias("n_words"))
    return counted.join(_small(per_doc), "doc", "left").select(
        "doc_id", "doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")) \
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
