"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. ``target / size`` is split into whole copies, which every document of the
source gets for certain, and a fraction, the inclusion probability of one further copy. Documents are ranked by
Pareto's ratio ``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a fixed random number of the document, and taken in that
order until the words still owed are reached: a sample of fixed size (in words) with unequal probabilities between
sources and, with a ``boost`` column, within them.

The cut is found without sorting the corpus: words are added up per source and 65,536 key ranges, and only the range
in which a source's cut falls is looked at row by row.

Cases: null and blank texts have size 0 and take 0 words; a null source is a source, sorted last; a document draws its
number by its id, and rows that share an id or have none draw by id, text and repetition, each a number of its own;
empty tables give empty results; extra columns stay, but for names the result itself needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordering import ordinal
from ..session import materialize

WEIGHTS = (3, 1, 2)
RANGES = 65_536
#: Source tables up to so many rows are broadcast.
BROADCAST_SOURCES = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Weights go round the sources in code point order, null last. With sources sorted by ``cap / weight``, a source
    stops at its cap exactly if the level reached without it, ``(total - caps before) / (weight left)``, is not below
    that ratio. Windows run over the table of sources, not of documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    position = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), position)) \
        .withColumn("cap", most * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) \
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return levelled.select("source", "source_size", F.when(F.col("full"), F.col("cap"))
                           .otherwise(final * F.col("w")).alias("target"))


def pareto_key(fraction: Column, seed: int) -> Column:
    """Pareto's ranking variable: odds of a fixed random number over the odds of inclusion."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}"), "_draw").cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), fraction))
    return (u / (1 - u)) / (p / (1 - p))


def _drawing(rows: DataFrame, shared: DataFrame | None, label: str) -> DataFrame:
    """``rows`` with ``_draw``, what a row's number depends on besides its id: nothing, but text and repetition where the
    id is in ``shared``. Equal rows are numbered in blocks; which of them gets which number makes no difference."""
    if shared is None:
        return rows.withColumn("_draw", F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    plain = rows.join(shared, same, "left_anti").withColumn("_draw", F.lit(""))
    again = rows.join(shared, same, "left_semi").withColumn("_same", F.xxhash64("doc_id", "_text", "source", "size")) \
        .withColumn("_salt", F.rand(1))
    numbered = ordinal(again, ["_same"], ["_salt"], "_at", label) \
        .withColumn("_draw", F.concat_ws("|", F.lit(""), "_text", "_at")).drop("_same", "_salt", "_at")
    return plain.unionByName(numbered)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17,
        boost: str | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies`` and ``taken`` (words taken, repeats counted), which
    replace columns of these names.

    ``boost`` names a column of relative inclusion weights within a source (default: all alike).
    """
    sized = docs.select(F.struct("*").alias("_doc"), "doc_id", "source", word_count(F.col("text")).alias("size"),
                        (F.col(boost).cast("double") if boost else F.lit(1.0)).alias("boost"),
                        F.xxhash64("text").alias("_text"))
    narrow = materialize(sized.drop("_doc"), "mixing-sizes")
    shared = materialize(narrow.groupBy("doc_id").count().where("count > 1 or doc_id is null")
                         .select(F.col("doc_id").alias("_id")), "mixing-shared")
    shared = None if shared.isEmpty() else shared
    sources = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = materialize(sources.withColumn("whole", F.floor(ratio)).withColumn("fraction", ratio - F.floor(ratio))
                          .withColumn("owed", F.col("target") - F.col("whole") * F.col("source_size")), "mixing-sources")
    small = F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda df: df)

    def keyed(rows: DataFrame, facts: DataFrame) -> DataFrame:
        facts = facts.withColumnRenamed("source", "_source")
        out = rows.join(small(facts), F.col("source").eqNullSafe(F.col("_source"))).drop("_source") \
            .withColumn("_key", pareto_key(F.col("fraction") * F.col("boost"), seed))
        return out.withColumn("_range", F.floor(RANGES * F.col("_key") / (1 + F.col("_key"))))

    keys = keyed(_drawing(narrow, shared, "mixing-again"), sources)
    if shared is not None:
        keys = materialize(keys, "mixing-keys")
    per_range = keys.groupBy("source", "_range").agg(F.sum("size").alias("words"), F.first("owed").alias("owed"))
    ahead = W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    crossing = per_range.withColumn("upto", F.sum("words").over(ahead)) \
        .where((F.col("owed") > 0) & (F.col("upto") >= F.col("owed")) & (F.col("upto") - F.col("words") < F.col("owed"))) \
        .groupBy("source").agg(F.min(F.struct("_range", (F.col("upto") - F.col("words")).alias("done"))).alias("c")) \
        .select(F.col("source").alias("_s"), F.col("c._range").alias("_r"), F.col("c.done").alias("done"))
    inside = keys.join(small(crossing), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    tied = inside.groupBy("source", "_range", "_key", "done", "owed").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("_key").rowsBetween(W.unboundedPreceding, W.currentRow))
    cuts = tied.withColumn("upto", F.col("done") + upto) \
        .groupBy("source", "_range").agg(F.max(F.when(F.col("upto") - F.col("words") / 2 <= F.col("owed"),
                                                      F.col("_key"))).alias("cut_key"))
    facts = sources.alias("s").join(cuts.select(F.col("source").alias("_cs"), F.col("_range").alias("cut_range"),
                                                "cut_key"),
                                    F.col("source").eqNullSafe(F.col("_cs")), "left").drop("_cs")
    facts = materialize(facts, "mixing-cuts")
    chosen = keyed(_drawing(sized, shared, "mixing-chosen"), facts)
    added = ["size", "source_size", "target", "copies", "taken"]
    extra = F.when(F.col("owed") <= 0, 0).when(F.col("cut_range").isNull(), 1) \
        .when(F.col("_range") < F.col("cut_range"), 1) \
        .when((F.col("_range") == F.col("cut_range")) & (F.col("_key") <= F.col("cut_key")), 1).otherwise(0)
    return chosen.withColumn("copies", (F.col("whole") + extra).cast("int")) \
        .withColumn("taken", F.col("size") * F.col("copies")) \
        .select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c not in added], *added)
