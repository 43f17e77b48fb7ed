"""Order-dependent operators that survive a very large group.

A plain window puts a whole group into one task.  Here each group is cut into
buckets of neighbouring rows: a window over one small summary row per bucket
carries the state from bucket to bucket, and a second window works inside each
bucket.  ``bucket`` must not decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _inside(keys: Sequence[str], bucket: str, order: Sequence[str]):
    return Window.partitionBy(*keys, bucket).orderBy(*order)


def _join_carried(
    df: DataFrame, carried: DataFrame, keys: Sequence[str], bucket: str, null_keys: bool = False
) -> DataFrame:
    """Bring the bucket summary back to the rows.

    The plain join leaves the rows partitioned as the window after it needs
    them.  With ``null_keys`` a null key is a group as well, at the cost of one
    more shuffle when the summary is too large to be broadcast.
    """
    if not null_keys:
        return df.join(carried, [*keys, bucket])
    names = {c: f"_key_{c}" for c in (*keys, bucket)}
    side = carried.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    return df.join(side, reduce(lambda a, b: a & b, same)).drop(*names.values())


def lag_in_order(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: str,
    out: str,
    null_keys: bool = False,
) -> DataFrame:
    """Value of the row before, null on the first row of the group."""
    ends = df.groupBy(*keys, bucket).agg(
        F.max_by(value, F.struct(*order)).alias("_end")
    )
    carried = ends.select(
        *keys,
        bucket,
        F.lag("_end").over(Window.partitionBy(*keys).orderBy(bucket)).alias("_carried"),
    )
    inside = _inside(keys, bucket, order)
    return (
        _join_carried(df, carried, keys, bucket, null_keys)
        .withColumn(
            out,
            F.when(F.row_number().over(inside) == 1, F.col("_carried")).otherwise(
                F.lag(value).over(inside)
            ),
        )
        .drop("_carried")
    )


def number_and_lead(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: str,
    number: str,
    following: str,
) -> DataFrame:
    """Row number from 1 and value of the row after, in one go."""
    parts = df.groupBy(*keys, bucket).agg(
        F.min_by(value, F.struct(*order)).alias("_start"), F.count(F.lit(1)).alias("_n")
    )
    along = Window.partitionBy(*keys).orderBy(bucket)
    carried = parts.select(
        *keys,
        bucket,
        F.col("_n").alias("_size"),
        F.lead("_start").over(along).alias("_carried"),
        F.coalesce(
            F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    inside = _inside(keys, bucket, order)
    row = F.row_number().over(inside)
    return (
        _join_carried(df, carried, keys, bucket)
        .withColumn(
            following,
            F.when(row == F.col("_size"), F.col("_carried")).otherwise(F.lead(value).over(inside)),
        )
        .withColumn(number, F.col("_before") + row)
        .drop("_size", "_carried", "_before")
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    values: dict[str, str],
) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_total`` for each ``name: column``.

    ``before`` is the sum over the earlier rows of the group.
    """
    sums = df.groupBy(*keys, bucket).agg(
        *[F.sum(col).alias(f"_s_{name}") for name, col in values.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = sums.select(
        *keys,
        bucket,
        *[
            F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}")
            for n in values
        ],
        *[
            F.sum(f"_s_{n}").over(Window.partitionBy(*keys)).alias(f"{n}_total")
            for n in values
        ],
    )
    inside = _inside(keys, bucket, order).rowsBetween(Window.unboundedPreceding, -1)
    joined = _join_carried(df, carried, keys, bucket)
    for name, col in values.items():
        joined = joined.withColumn(
            f"{name}_before",
            F.col(f"_c_{name}") + F.coalesce(F.sum(col).over(inside), F.lit(0)),
        ).drop(f"_c_{name}")
    return joined


def numbered(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], out: str
) -> DataFrame:
    """Row number from 1 inside each group."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = counts.select(
        *keys, bucket, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carried")
    )
    inside = _inside(keys, bucket, order)
    return (
        _join_carried(df, carried, keys, bucket)
        .withColumn(out, F.col("_carried") + F.row_number().over(inside))
        .drop("_carried")
    )


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group.

    Spark plans a group limit below the shuffle, so at most ``k`` rows per key
    leave each map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def _orderable(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Tie keys.  Long values stand as hashes, so a key stays small."""
    plain = {"string", "binary"}
    keys = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        if "map<" not in kind and "variant" not in kind:
            keys.append(F.xxhash64(c) if kind in plain else F.col(c))
    return keys


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group by ``order``, then by the other columns that have
    an order; groups are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order, *_orderable(df, rest))).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(df.columns)


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each group by ``order``, then by the other columns that have
    an order; groups are reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order, *_orderable(df, rest))).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(df.columns)
