"""Rows from computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column | str, name: str, position: str | None = None) -> DataFrame:
    """One row per array element.

    A plain ``explode`` makes the optimizer add ``size(array) > 0`` as a filter, which moves down
    to the scan and evaluates an expensive array expression twice, possibly in few tasks. The
    outer form with a test on its output keeps the expression where it is.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(position, name)).where(F.col(position).isNotNull())
