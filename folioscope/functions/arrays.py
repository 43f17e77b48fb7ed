"""Rows from arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(
    df: DataFrame,
    keep: Sequence[str | Column],
    array: Column | str,
    item: str,
    pos: str = "_pos",
) -> DataFrame:
    """``keep..., pos, item``: one row per array element.

    The outer form is used and its empty row dropped: for the plain form the
    optimizer adds a filter on the array's size, and an array that is computed
    from a text would be computed again for it.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.where(F.col(pos).isNotNull())
