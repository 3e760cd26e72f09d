"""Running totals and folds over groups of any size.

A plain window sorts a whole group in one task, which fails when one group holds a third
of all rows. Here rows are range-split into blocks of similar size first; each block is
scanned on its own and starts from the combined value of the blocks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

CHUNK_ROWS = 4096
_KINDS = {
    "sum": (F.sum, lambda local, carry: local + F.coalesce(carry, F.lit(0))),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def in_blocks(df: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Range-split by group and order, with the block number as ``_block``. Written once, so a
    retried task can never see other block borders. The number of blocks follows the session's
    shuffle partitions; adaptive execution merges small neighbours, which keeps the order."""
    ranged = df.repartitionByRange(*group, *order).withColumn("_block", F.spark_partition_id())
    return materialize(ranged, label)


def running(blocked: DataFrame, group: list[str], order: list[str], name: str, value: Column,
            kind: str = "sum") -> DataFrame:
    """Add the running ``kind`` of ``value`` up to each row; needs ``in_blocks`` input."""
    fold, combine = _KINDS[kind]
    inside = W.partitionBy("_block", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carries = (blocked.groupBy("_block", *group).agg(fold(value).alias("_t"))
               .select("_block", *group, fold("_t").over(earlier).alias("_carry")))
    local = blocked.withColumn("_local", fold(value).over(inside))
    return local.join(carries, ["_block", *group]) \
        .withColumn(name, combine(F.col("_local"), F.col("_carry"))).drop("_local", "_carry")


def ordinal(df: DataFrame, group: list[str], order: list[str], name: str, label: str) -> DataFrame:
    """Position of each row in its group, from 0."""
    numbered = running(in_blocks(df, group, order, label), group, order, name, F.lit(1))
    return numbered.withColumn(name, F.col(name) - 1).drop("_block")


def with_halo(df: DataFrame, micros: str, reach_seconds: int, bucket_seconds: int) -> DataFrame:
    """Cut time into buckets and repeat in each bucket the rows of the ``reach`` before it.

    A look-back of at most ``reach`` can then be computed per (key, ``_bucket``); rows with
    ``_halo`` true only serve as history and must be dropped afterwards.
    """
    width, reach = bucket_seconds * 1_000_000, reach_seconds * 1_000_000
    if reach > width:
        raise ValueError("a bucket must be at least as long as the look-back")
    home = F.floor(F.col(micros) / width).cast("long")
    late = F.col(micros) - home * width >= width - reach
    copies = F.when(late, F.array(F.struct(home.alias("b"), F.lit(False).alias("h")),
                                  F.struct((home + 1).alias("b"), F.lit(True).alias("h")))) \
        .otherwise(F.array(F.struct(home.alias("b"), F.lit(False).alias("h"))))
    return df.withColumn("_c", F.explode(copies)).select(
        *df.columns, F.col("_c.b").alias("_bucket"), F.col("_c.h").alias("_halo"))


def fold_in_blocks(blocked: DataFrame, group: list[str], order: list[str], unit: Column, same: Column, then) -> DataFrame:
    """``(*group, state)``: the rows of each group, in order, combined by ``then(first, second)``.

    ``unit`` is what one row does, ``same`` does nothing, and ``then`` must be associative. Chunks of rows fold to one
    state each, then blocks, then the group; no step collects more than a chunk's rows or a group's chunk and block
    states.
    """
    inside = W.partitionBy("_block", *group).orderBy(*order)
    rows = blocked.select(*group, "_block", F.row_number().over(inside).alias("_n"), unit.alias("state"))

    def fold(df, keys, position):
        packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(position, "state"))).alias("_l"))
        return packed.select(*keys, F.aggregate(F.col("_l")["state"], same, then).alias("state"))

    chunked = rows.withColumn("_chunk", F.floor((F.col("_n") - 1) / CHUNK_ROWS).cast("long"))
    per_chunk = fold(chunked, [*group, "_block", "_chunk"], "_n")
    per_block = fold(per_chunk, [*group, "_block"], "_chunk")
    return fold(per_block, group, "_block")


#: A clamped addition ``x -> min(hi, max(lo, x + add))``. These are closed under composition.
CLAMPED = "struct<add:bigint,lo:bigint,hi:bigint>"
_FAR = 1 << 40


def clamped(add: Column, lo: int, hi: int = _FAR) -> Column:
    return F.struct(add.cast("long").alias("add"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))


def unchanged() -> Column:
    return clamped(F.lit(0), -_FAR)


def clamped_then(first: Column, second: Column) -> Column:
    """The clamped addition that does ``first`` and then ``second``."""
    def clamp(x):
        return F.least(second["hi"], F.greatest(second["lo"], x + second["add"]))
    return F.struct((first["add"] + second["add"]).alias("add"), clamp(first["lo"]).alias("lo"),
                    clamp(first["hi"]).alias("hi"))


def clamped_at(step: Column, start: int) -> Column:
    return F.least(step["hi"], F.greatest(step["lo"], F.lit(start) + step["add"]))


def clamped_fold(blocked: DataFrame, group: list[str], order: list[str], measures: dict) -> DataFrame:
    """Final value per group of clamped running additions, e.g. a score kept within 0 and 100.

    ``measures`` maps a name to ``(start, add, lo, hi)``.
    """
    unit = F.struct(*[clamped(add, lo, hi).alias(name) for name, (_, add, lo, hi) in measures.items()])
    same = F.struct(*[unchanged().alias(name) for name in measures])

    def then(a, b):
        return F.struct(*[clamped_then(a[name], b[name]).alias(name) for name in measures])
    folded = fold_in_blocks(blocked, group, order, unit, same, then)
    return folded.select(*group, *[clamped_at(F.col("state")[name], start).alias(name)
                                   for name, (start, *_) in measures.items()])
