"""Retrieval metrics.

``hits`` are ``<groups>, query_id, rank, chunk_id, section_id``; ``truth`` is
``query_id, expected_section_id, expected_chunk_ids``.  A query without hits
counts with zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def relevant(section_only: bool = False) -> Column:
    section = F.coalesce(F.col("section_id") == F.col("expected_section_id"), F.lit(False))
    if section_only:
        return section
    chunk = F.coalesce(F.array_contains("expected_chunk_ids", F.col("chunk_id")), F.lit(False))
    return chunk | section


def _group_values(groups: Sequence[str], values: dict[str, Sequence]) -> Column:
    """Array of structs with every combination of group values."""
    combos: list[dict] = [{}]
    for group in groups:
        combos = [{**c, group: v} for c in combos for v in values[group]]
    return F.array(
        *[F.struct(*[F.lit(v).alias(g) for g, v in c.items()]) for c in combos]
    )


def query_metrics(
    hits: DataFrame,
    truth: DataFrame,
    ks: Sequence[int] = K.BENCHMARK_KS,
    groups: dict[str, Sequence] | None = None,
    section_only: bool = False,
) -> DataFrame:
    """Long form: ``<groups>, query_id, k, hit, precision, recall, rr``.

    ``groups`` names the grouping columns of ``hits`` with their values, e.g.
    ``{"mode": ["dense", "sparse"]}``.
    """
    groups = groups or {}
    names = list(groups)
    every = truth.select("query_id", F.size("expected_chunk_ids").alias("n_expected"))
    if names:
        every = every.withColumn("_g", F.explode(_group_values(names, groups))).select(
            "query_id", "n_expected", "_g.*"
        )
    judged = hits.join(truth, "query_id").withColumn("_rel", relevant(section_only))
    largest = max(ks)
    counts = judged.groupBy(*names, "query_id").agg(
        *[
            F.sum(F.when(F.col("_rel") & (F.col("rank") <= k), 1).otherwise(0)).alias(f"_m{k}")
            for k in ks
        ],
        F.min(F.when(F.col("_rel") & (F.col("rank") <= largest), F.col("rank"))).alias("_first"),
    )
    wide = every.join(counts, [*names, "query_id"], "left")
    per_k = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("k"), F.coalesce(f"_m{k}", F.lit(0)).alias("matches"))
                for k in ks
            ]
        )
    )
    long = wide.withColumn("_k", per_k).select(*names, "query_id", "n_expected", "_first", "_k.*")
    return long.select(
        *names,
        "query_id",
        "k",
        F.when(F.col("matches") > 0, 1).otherwise(0).alias("hit"),
        (F.col("matches") / F.col("k")).alias("precision"),
        F.least(F.lit(1.0), F.col("matches") / F.greatest(F.lit(1), "n_expected")).alias("recall"),
        F.coalesce(F.lit(1.0) / F.col("_first"), F.lit(0.0)).alias("rr"),
    )


def macro_metrics(
    per_query: DataFrame, groups: Sequence[str] = (), digits: int = 4
) -> DataFrame:
    """Means over queries: ``<groups>, k, hit_rate, precision, recall, mrr``."""

    def mean(name: str) -> Column:
        return F.round(F.avg(name), digits)

    return per_query.groupBy(*groups, "k").agg(
        mean("hit").alias("hit_rate"),
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        mean("rr").alias("mrr"),
    )


def sweep_k(
    hits: DataFrame,
    truth: DataFrame,
    ks: Sequence[int] = K.SWEEP_KS,
    digits: int = 4,
) -> DataFrame:
    """One ranking, every cut-off: hit rate, precision, context size, trade-off.

    ``hits`` carry ``token_count`` of each chunk; a missing count is 600.
    """
    judged = hits.join(truth, "query_id").withColumn("_rel", relevant())
    tokens = F.coalesce("token_count", F.lit(K.DEFAULT_CHUNK_TOKENS))
    counts = judged.groupBy("query_id").agg(
        *[
            F.struct(
                F.sum(F.when(F.col("_rel") & (F.col("rank") <= k), 1).otherwise(0)).alias("m"),
                F.sum(F.when(F.col("rank") <= k, tokens).otherwise(0)).alias("t"),
            ).alias(f"_k{k}")
            for k in ks
        ]
    )
    wide = truth.select("query_id").join(counts, "query_id", "left")
    per_k = F.explode(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_k{k}").alias("v")) for k in ks])
    )
    long = wide.withColumn("_k", per_k).select(
        F.col("_k.k").alias("k"),
        F.coalesce("_k.v.m", F.lit(0)).alias("m"),
        F.coalesce("_k.v.t", F.lit(0)).alias("t"),
    )
    means = long.groupBy("k").agg(
        F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)).alias("h"),
        F.avg(F.col("m") / F.col("k")).alias("p"),
        F.floor(F.sum("t") / F.count(F.lit(1))).cast("int").alias("avg_context_tokens"),
    )
    return means.select(
        "k",
        F.round("h", digits).alias("hit_rate"),
        F.round("p", digits).alias("precision"),
        "avg_context_tokens",
        F.round(
            F.col("h") * K.SWEEP_HIT_WEIGHT + F.col("p") * K.SWEEP_PRECISION_WEIGHT, digits
        ).alias("tradeoff_score"),
    )


def query_detail(hits: DataFrame, groups: Sequence[str] = (), n: int = 3) -> DataFrame:
    """``<groups>, query_id, top_retrieved``: the first ``n`` ids in rank order."""
    top = hits.where(F.col("rank") <= n)
    return top.groupBy(*groups, "query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda s: s["chunk_id"]
        ).alias("top_retrieved")
    )


def latency_summary(timings: DataFrame, groups: Sequence[str] = ("mode",)) -> DataFrame:
    """Mean latency per group from ``<groups>, latency_ms`` rows."""
    return timings.groupBy(*groups).agg(F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"))
