"""Rank fusion and score fusion of a dense and a sparse hit list.

Legs hold ``query_id, <item>, rank`` and ``dense_score`` / ``bm25_score``.
They are unioned and reduced by key: one shuffle, instead of the two of a full
outer join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .ordered import top_k


def _legs(dense: DataFrame, sparse: DataFrame, item_id: str, query_id: str) -> DataFrame:
    empty = F.lit(None)
    both = dense.select(
        query_id,
        item_id,
        F.col("rank").alias("dense_rank"),
        "dense_score",
        empty.cast("int").alias("sparse_rank"),
        empty.cast("double").alias("bm25_score"),
    ).unionByName(
        sparse.select(
            query_id,
            item_id,
            empty.cast("int").alias("dense_rank"),
            empty.cast("double").alias("dense_score"),
            F.col("rank").alias("sparse_rank"),
            "bm25_score",
        )
    )
    return both.groupBy(query_id, item_id).agg(
        *[
            F.max(c).alias(c)
            for c in ("dense_rank", "dense_score", "sparse_rank", "bm25_score")
        ]
    )


def reciprocal_rank_fusion(
    dense: DataFrame,
    sparse: DataFrame,
    k: int = K.TOP_K,
    c: int = K.RRF_CONSTANT,
    dense_weight: float = K.RRF_DENSE_WEIGHT,
    item_id: str = "chunk_id",
    query_id: str = "query_id",
) -> DataFrame:
    """Sum of ``weight / (c + rank)`` over the legs that hold the item."""

    def share(weight: float, rank: str) -> Column:
        return F.coalesce(F.lit(weight) / (F.lit(c) + F.col(rank)), F.lit(0.0))

    fused = _legs(dense, sparse, item_id, query_id).withColumn(
        "_score", share(dense_weight, "dense_rank") + share(1.0 - dense_weight, "sparse_rank")
    )
    best = top_k(
        fused,
        [query_id],
        [F.desc("_score"), F.asc_nulls_last("dense_rank"), F.asc("sparse_rank")],
        k,
    )
    return best.withColumn("fusion_score", F.round("_score", 5)).drop("_score")


def relative_score_fusion(
    dense: DataFrame,
    sparse: DataFrame,
    k: int = K.TOP_K,
    alpha: float = K.SCORE_FUSION_ALPHA,
    item_id: str = "chunk_id",
    query_id: str = "query_id",
) -> DataFrame:
    """Weighted sum of min-max scaled scores; equal scores in a leg scale to 1."""
    window = Window.partitionBy(query_id)

    def scaled(score: str) -> Column:
        low, high = F.min(score).over(window), F.max(score).over(window)
        value = F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low))
        return F.when(F.col(score).isNotNull(), value).otherwise(0.0)

    fused = (
        _legs(dense, sparse, item_id, query_id)
        .withColumn("_dense", scaled("dense_score"))
        .withColumn("_sparse", scaled("bm25_score"))
        .withColumn("_score", F.lit(alpha) * F.col("_dense") + F.lit(1.0 - alpha) * F.col("_sparse"))
    )
    best = top_k(fused, [query_id], [F.desc("_score"), F.asc(item_id)], k)
    return best.withColumn("fusion_score", F.round("_score", 5)).drop(
        "_score", "_dense", "_sparse"
    )
