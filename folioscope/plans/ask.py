"""Batched questions: retrieve, project, build context and prompt."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import context, dense, fusion, lexical, state, targets

from ..plugins import Embedder, Generator, embed, generate
from ..session import settle

MODES = ("dense", "sparse", "hybrid", "score_fusion")


def leg_size(k: int) -> int:
    return max(k * K.LEG_FACTOR, K.LEG_MIN)


def _dense(chunks, queries, k, filtered, prefilter, item_id):
    if not filtered:
        return dense.dense_top_k(chunks, queries, k, item_id)
    if prefilter:
        return dense.dense_top_k_prefiltered(chunks, queries, k, item_id)
    wide = dense.dense_top_k(chunks, queries, targets.overfetch(k), item_id)
    return targets.keep_target_hits(wide, queries, chunks, k, item_id)


def _sparse(chunks, queries, k, filtered, prefilter, item_id, index):
    if not filtered:
        return lexical.bm25_top_k(chunks, queries, k, item_id, "index_text", index=index)
    if prefilter:
        return lexical.bm25_top_k_prefiltered(
            chunks, queries, k, item_id, "index_text", index=index
        )
    wide = lexical.bm25_top_k(
        chunks, queries, targets.overfetch(k), item_id, "index_text", index=index
    )
    return targets.keep_target_hits(wide, queries, chunks, k, item_id)


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    mode: str = "hybrid",
    k: int = K.TOP_K,
    filtered: bool = False,
    prefilter: bool = False,
    item_id: str = "chunk_id",
    index: lexical.Bm25Index | None = None,
) -> DataFrame:
    """``query_id, chunk_id, rank, score`` (+ scores per leg).

    ``chunks`` carry ``embedding`` (dense) and text (sparse); ``queries`` carry
    ``vector`` and ``query``.  With ``filtered`` the queries carry the target
    columns of :func:`targets.target_keys`.
    """
    corpus = chunks
    if mode != "dense" and "index_text" not in chunks.columns:
        corpus = chunks.withColumn(
            "index_text", lexical.corpus_text(F.col("section_title"), F.col("text"))
        )
    if mode == "dense":
        hits = _dense(corpus, queries, k, filtered, prefilter, item_id)
        return hits.withColumn("score", F.col("dense_score"))
    if mode == "sparse":
        hits = _sparse(corpus, queries, k, filtered, prefilter, item_id, index)
        return hits.withColumn("score", F.col("bm25_score"))
    n = leg_size(k)
    left = _dense(corpus, queries, n, filtered, prefilter, item_id)
    right = _sparse(corpus, queries, n, filtered, prefilter, item_id, index)
    fuse = (
        fusion.relative_score_fusion if mode == "score_fusion" else fusion.reciprocal_rank_fusion
    )
    fused = fuse(left, right, k, item_id=item_id)
    return fused.withColumn("score", F.col("fusion_score"))


def ask(
    queries: DataFrame,
    chunks: DataFrame,
    registry: DataFrame | None = None,
    mode: str = "hybrid",
    k: int = K.TOP_K,
    history: DataFrame | None = None,
    reports: DataFrame | None = None,
    embedder: Embedder | None = None,
    generators: Sequence[Generator] = (),
    prefilter: bool = False,
    index: lexical.Bm25Index | None = None,
) -> DataFrame:
    """``query_id, query, doc_filter, sources, context, prompt`` (+ ``answer``).

    ``queries`` need ``query_id, query``; optional ``doc_filter``, ``vector``,
    ``conv_id``, ``user_id``.  Without a generator the result ends with the
    prompt; no answer is made up.  Runs the retrieval; the texts are joined
    lazily.
    """
    q = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "")
    q = targets.extract_mentions(q, "query", "doc_filter" if "doc_filter" in q.columns else None)
    filtered = registry is not None
    resolved = None
    if filtered:
        resolved = settle(targets.resolve_targets(q, registry), "targets")
        q = targets.target_keys(q, resolved)
    if reports is not None and "user_id" in q.columns:
        q = state.attach_patient(q, reports)
        q = q.withColumn("bp_category", F.col("vitals.bp_category")).withColumn(
            "comorbidities", F.col("vitals.comorbidities")
        )
        q = context.enrich_query(q)
        note = context.patient_note(F.col("vitals"), F.col("summary"))
    else:
        q = q.withColumn("dense_query", F.col("query"))
        note = F.lit("")
    if "vector" not in q.columns and mode != "sparse":
        if embedder is None:
            raise ValueError("queries have no vector: give an embedder or use sparse mode")
        q = embed(q, embedder, "dense_query", "query", "vector").drop("embedding_model")

    # the prepared questions and the ranked ids are small and used several
    # times below, so each is written once and read back
    q = settle(q.withColumn("patient_note", note), "questions")
    hits = settle(
        retrieve(chunks, q, mode, k, filtered, prefilter, index=index).select(
            "query_id", "chunk_id", "rank", "score"
        ),
        "hits",
    )
    sources = context.format_sources(context.attach_chunks(hits, chunks))
    out = q.join(context.collect_sources(sources), "query_id", "left").withColumn(
        "context", context.context_text(F.col("sources"))
    )
    if resolved is not None:
        out = out.join(
            resolved.select("query_id", "document_name", "organization"), "query_id", "left"
        )
        target = context.target_note(
            F.col("doc_filter"), F.col("document_name"), F.col("organization")
        )
    else:
        target = context.target_note(F.col("doc_filter"), F.col("doc_filter"), F.lit(""))
    if history is not None and "conv_id" in q.columns:
        past = context.history_window(history).select("conv_id", "history")
        out = out.join(past, "conv_id", "left")
    else:
        out = out.withColumn("history", F.lit(None).cast("string"))
    out = out.withColumn(
        "prompt",
        context.build_prompt(
            F.col("context"), F.col("query"), F.col("patient_note"), F.col("history"), target
        ),
    )
    result = out.select("query_id", "query", "doc_filter", "sources", "context", "prompt")
    return generate(result, generators) if generators else result


__all__ = ["MODES", "ask", "leg_size", "retrieve"]
