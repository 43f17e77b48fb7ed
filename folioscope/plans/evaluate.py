"""Retrieval experiments.  Each ranks once and measures every cut-off."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import chunking, dense, evaluation, fusion, lexical
from ..operators.chunking import ChunkSize
from ..session import settle

BENCHMARK_MODES = ("dense", "sparse", "hybrid_rrf", "hybrid_weighted")


def _tagged(hits: DataFrame, mode: str) -> DataFrame:
    return hits.select(F.lit(mode).alias("mode"), "query_id", "rank", "chunk_id")


def rank_modes(
    vectors: DataFrame,
    corpus: DataFrame,
    queries: DataFrame,
    k: int = max(K.BENCHMARK_KS),
    leg: int = K.BENCHMARK_LEG,
    text: str = "index_text",
) -> DataFrame:
    """``mode, query_id, rank, chunk_id`` of the four modes.

    The two legs are computed once to ``leg`` rows, written and shared: the
    first ``k`` rows are the single-leg modes.
    """
    d = settle(dense.dense_top_k(vectors, queries, leg), "dense")
    s = settle(lexical.bm25_top_k(corpus, queries, leg, text=text), "sparse")
    return reduce(
        DataFrame.unionByName,
        [
            _tagged(d.where(F.col("rank") <= k), "dense"),
            _tagged(s.where(F.col("rank") <= k), "sparse"),
            _tagged(fusion.reciprocal_rank_fusion(d, s, k), "hybrid_rrf"),
            _tagged(fusion.relative_score_fusion(d, s, k), "hybrid_weighted"),
        ],
    )


def compare_modes(
    hits: DataFrame,
    sections: DataFrame,
    truth: DataFrame,
    ks: Sequence[int] = K.BENCHMARK_KS,
    modes: Sequence[str] = BENCHMARK_MODES,
    digits: int = 4,
) -> DataFrame:
    """Metrics per mode and k.  ``sections`` maps ``chunk_id`` to ``section_id``."""
    judged = hits.join(sections.select("chunk_id", "section_id"), "chunk_id", "left")
    per_query = evaluation.query_metrics(judged, truth, ks, {"mode": list(modes)})
    return evaluation.macro_metrics(per_query, ["mode"], digits)


def compare_models(
    models: dict[str, tuple[DataFrame, DataFrame]],
    sections: DataFrame,
    truth: DataFrame,
    ks: Sequence[int] = K.BENCHMARK_KS,
    digits: int = 4,
) -> DataFrame:
    """Metrics per embedding model from (chunk vectors, query vectors) pairs."""
    ranked = [
        dense.dense_top_k(v, q, max(ks)).select(
            F.lit(name).alias("model"), "query_id", "rank", "chunk_id"
        )
        for name, (v, q) in models.items()
    ]
    judged = reduce(DataFrame.unionByName, ranked).join(
        sections.select("chunk_id", "section_id"), "chunk_id", "left"
    )
    per_query = evaluation.query_metrics(judged, truth, ks, {"model": list(models)})
    return evaluation.macro_metrics(per_query, ["model"], digits)


def tune_k(
    vectors: DataFrame,
    queries: DataFrame,
    chunk_info: DataFrame,
    truth: DataFrame,
    ks: Sequence[int] = K.SWEEP_KS,
    digits: int = 4,
) -> DataFrame:
    """Sweep k over one dense ranking.

    ``chunk_info`` is ``chunk_id, section_id, token_count``.
    """
    hits = dense.dense_top_k(vectors, queries, max(ks)).join(chunk_info, "chunk_id")
    return evaluation.sweep_k(hits, truth, ks, digits)


def chunk_configs(texts: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Chunks of every text under each published size: adds ``config_id``."""
    sizes = [ChunkSize(*c[2:]) for c in K.CHUNK_CONFIGS]
    chunks = chunking.split_into_sizes(texts, sizes, keep=keep)

    def of_config(field: int) -> Column:
        return F.element_at(F.array(*(F.lit(c[field]) for c in K.CHUNK_CONFIGS)), F.col("size_no") + 1)

    return chunks.select(
        *keep, "chunk_no", "text", "token_count", of_config(0).alias("config_id"), of_config(1).alias("name"),
        of_config(2).alias("target_tokens"), of_config(5).alias("overlap_tokens"),
    )


def ablate_chunk_sizes(
    chunks: DataFrame,
    queries: DataFrame,
    truth: DataFrame,
    search: Callable[[DataFrame, DataFrame, int], DataFrame],
    k: int = K.ABLATION_K,
    digits: int = 4,
) -> DataFrame:
    """Size statistics with hit rate and precision per chunk configuration.

    ``chunks`` come from :func:`chunk_configs` with ``chunk_id, section_id``;
    ``search`` ranks one configuration.  Relevance is the section alone.  The
    chunks are written once; statistics, search and sections read them there.
    """
    chunks = settle(chunks, "configurations")
    groups = ("config_id", "name", "target_tokens", "overlap_tokens")
    sizes = chunking.chunk_statistics(chunks, groups)
    ids = [c[0] for c in K.CHUNK_CONFIGS]
    ranked = []
    for config_id in ids:
        own = chunks.where(F.col("config_id") == config_id)
        ranked.append(
            search(own, queries, k)
            .select("query_id", "rank", "chunk_id")
            .join(own.select("chunk_id", "section_id"), "chunk_id")
            .withColumn("config_id", F.lit(config_id))
        )
    per_query = evaluation.query_metrics(
        reduce(DataFrame.unionByName, ranked), truth, [k], {"config_id": ids}, section_only=True
    )
    means = evaluation.macro_metrics(per_query, ["config_id"], digits).select(
        "config_id",
        F.col("hit_rate").alias(f"hit_rate_at_{k}"),
        F.col("precision").alias(f"precision_at_{k}"),
    )
    return sizes.join(means, "config_id")


def timed(name: str, build: Callable[[], DataFrame], sink: Callable[[DataFrame], object]) -> dict:
    """Wall time of one mode in milliseconds, plan building included."""
    start = time.perf_counter()
    sink(build())
    return {"mode": name, "latency_ms": round((time.perf_counter() - start) * 1000.0, 2)}
