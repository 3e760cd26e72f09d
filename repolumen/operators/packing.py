"""Greedy packing of ordered rows into slots of a budget, in blocks.

A row opens a new slot if it does not fit into the open one; a row larger than the budget has a slot of its own. Where
slots begin depends on all rows before, but a block of rows is a function of one number, the fill of the slot that is
open when it starts: the first row that does not fit opens a slot, and from there on the block runs by itself. That
function is a short table with a line per row of the block, made for all blocks at once. Only table look-ups follow
the order of the blocks; then all blocks assign their slots at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .ordering import in_blocks


def _starts(sums: np.ndarray, budget: int) -> np.ndarray:
    """For a slot that begins at each row, the row that begins the next one; ``sums`` are running sums from 0."""
    rows = len(sums) - 1
    beyond = np.searchsorted(sums, sums[:-1] + budget, "right") - 1
    return np.maximum(beyond, np.arange(rows) + 1)


def block_function(sizes: np.ndarray, budget: int) -> dict[str, np.ndarray]:
    """The block as a table: if the first row that does not fit is row ``i``, the block opens ``slots[i]`` slots and
    leaves the last one filled by ``fill[i]``. ``upto[i]`` is the sum of the sizes up to that row; the last line is for
    a block that fits whole."""
    sums = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    rows = len(sizes)
    following = _starts(sums, budget)
    slots, last = np.zeros(rows + 1, np.int64), np.arange(rows + 1)
    for i in range(rows - 1, -1, -1):
        slots[i] = 1 + slots[following[i]]
        if following[i] < rows:
            last[i] = last[following[i]]
    fill = sums[-1] - sums[last]
    fill[rows] = sums[-1]
    return {"upto": np.append(sums[1:], np.iinfo(np.int64).max), "slots": slots, "fill": fill}


def assign(sizes: np.ndarray, budget: int, fill: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Slot, counted from the open one, and the sum of that slot up to each row. ``fill`` None: no slot is open yet."""
    sums = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    rows = len(sizes)
    following = _starts(sums, budget)
    at = 0 if fill is None else int(np.searchsorted(sums[1:], budget - fill, "right"))
    opens = np.zeros(rows, np.int64)
    base = np.full(rows, 0 if fill is None else -fill, np.int64)
    first = fill is None
    while at < rows:
        opens[at] = not first
        base[at:] = sums[at]
        first = False
        at = following[at]
    return np.cumsum(opens), sums[1:] - base


def greedy_slots(df: DataFrame, group: list[str], order: list[str], size: Column, budget: int, label: str) -> DataFrame:
    """``df`` with ``slot``, from 0 in each group, and ``used``, the sum of the row's slot up to the row. Null and
    negative sizes count as 0. Rounds follow the blocks of the group that spans most of them."""
    blocked = in_blocks(df.withColumn("_size", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")), group, order, label)
    ranks = blocked.select(*group, "_block").distinct().withColumn(
        "_rank", F.row_number().over(W.partitionBy(*group).orderBy("_block")) - 1)
    named = [field for field in blocked.schema if field.name in group]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named)

    def table(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by([(c, "ascending") for c in order])
        lines = block_function(unit.column("_size").to_numpy(), budget)
        kept = slice(0, 1) if unit.column("_rank")[0].as_py() == 0 else slice(None)
        count = len(lines["upto"][kept])
        return pa.table({
            **{c: unit.column(c).take(pa.array(np.zeros(count, np.int64))) for c in group},
            "_rank": pa.array(np.full(count, unit.column("_rank")[0].as_py()), pa.int32()),
            "upto": lines["upto"][kept], "at": np.arange(count), "slots": lines["slots"][kept], "fill": lines["fill"][kept]})

    # groups within one block need no table
    spanning = ranks.where("_rank > 0").select(*group).distinct()
    ranked = blocked.join(ranks, [*group, "_block"])
    tables = materialize(ranked.join(spanning, group, "left_semi").groupBy(*group, "_block").applyInArrow(
        table, f"{columns}, _rank int, upto long, at long, slots long, fill long"), f"{label}-tables")
    ends = tables.where("_rank = 0").select(*group, F.lit(1).alias("_rank"), "fill", (F.col("slots") - 1).alias("slot"))
    entries, last = [ends], tables.agg(F.max("_rank")).first()[0] or 0
    for rank in range(1, last):
        open_ = entries[-1].select(*group, F.col("fill").alias("_fill"), F.col("slot").alias("_slot"))
        lines = tables.where(F.col("_rank") == rank).join(open_, group)
        met = lines.where(F.col("upto") > budget - F.col("_fill")).groupBy(*group, "_fill", "_slot").agg(
            F.min(F.struct("upto", "at", "slots", "fill")).alias("m"))  # rows without size have the sum of the one before
        whole = F.when(F.col("m.slots") == 0, F.col("_fill")).otherwise(0)
        entries.append(materialize(met.select(
            *group, F.lit(rank + 1).alias("_rank"), (F.col("m.fill") + whole).alias("fill"),
            (F.col("_slot") + F.col("m.slots")).alias("slot")), f"{label}-entries"))
    entered = entries[0]
    for more in entries[1:]:
        entered = entered.unionByName(more)
    own = df.columns
    known = ranked.join(entered.withColumnRenamed("fill", "_fill").withColumnRenamed("slot", "_slot"), [*group, "_rank"], "left")

    def place(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by([(c, "ascending") for c in order])
        fill, slot = unit.column("_fill")[0].as_py(), unit.column("_slot")[0].as_py() or 0
        slots, used = assign(unit.column("_size").to_numpy(), budget, fill)
        return unit.select(own).append_column("slot", pa.array(slots + slot, pa.int64())) \
            .append_column("used", pa.array(used, pa.int64()))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return known.groupBy(*group, "_block").applyInArrow(place, f"{shape}, slot long, used long")
