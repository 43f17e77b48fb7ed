"""Exact cosine search and embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.vectors import point_id
from . import scoring
from .dense_index import DenseIndex

# vectors are long: 4096 of 3072 doubles are 100 MB
MAX_SHIPPED_VECTORS = 4096


def dense_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K.TOP_K,
    item_id: str = "chunk_id",
    vector: str = "embedding",
    query_vector: str = "vector",
    query_id: str = "query_id",
    index: DenseIndex | None = None,
    **limits,
) -> DataFrame:
    """``query_id, item_id, dense_score, rank``, highest cosine first.

    Rows and queries without a vector are left out.  With a stored ``index``
    the ``vectors`` are not read, and of the index only what can hold a hit.
    """
    if index is not None:
        return index.top_k(queries, k, query_vector, query_id)
    hits = scoring.best_k(
        vectors.where(F.col(vector).isNotNull()).select(item_id, vector),
        queries.where(F.col(query_vector).isNotNull()).select(query_id, query_vector),
        scoring.vector_scorer(query_id, query_vector),
        k,
        item_id,
        query_id,
        **{"max_shipped": MAX_SHIPPED_VECTORS, **limits},
    )
    return hits.withColumnRenamed("score", "dense_score")


def dense_top_k_prefiltered(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K.TOP_K,
    item_id: str = "chunk_id",
    vector: str = "embedding",
    query_vector: str = "vector",
    query_id: str = "query_id",
    **limits,
) -> DataFrame:
    """As ``dense_top_k``, ranking only rows of each query's target document.

    ``vectors`` needs ``document_id`` and ``pdf_file``; ``queries`` need the
    target columns of :func:`targets.target_keys`.
    """
    items = vectors.where(F.col(vector).isNotNull()).select(
        item_id,
        vector,
        F.lower(F.coalesce(F.col("document_id"), F.lit(""))).alias("_document"),
        F.regexp_replace(
            F.lower(F.coalesce(F.col("pdf_file"), F.lit(""))), r"\.pdf", ""
        ).alias("_file"),
    )
    hits = scoring.best_k(
        items,
        queries.where(F.col(query_vector).isNotNull()).select(
            query_id, query_vector, "has_target", "target_id", "target_file", "target_org"
        ),
        scoring.vector_scorer(query_id, query_vector, scoring.document_filter()),
        k,
        item_id,
        query_id,
        **{"max_shipped": MAX_SHIPPED_VECTORS, **limits},
    )
    return hits.withColumnRenamed("score", "dense_score")


def to_points(embedded: DataFrame) -> DataFrame:
    """Embedded chunks as vector points keyed by a stable id."""
    payload = [
        "chunk_id", "document_id", "document_name", "pdf_file", "section_id",
        "section_title", "page_start", "page_end", "token_count", "text",
    ]
    return embedded.select(
        point_id(F.col("chunk_id")).alias("point_id"),
        "embedding",
        F.struct(*payload).alias("payload"),
    )


def zip_embeddings(chunks: DataFrame, vectors: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Pair chunks and vectors by ordinal; a missing partner is an error.

    The check runs inside the join, so no extra pass is needed.
    """
    both = chunks.withColumn("_c", F.lit(1)).join(
        vectors.withColumn("_v", F.lit(1)), ordinal, "full_outer"
    )
    return both.withColumn(
        ordinal,
        F.when(
            F.col("_c").isNull() | F.col("_v").isNull(),
            F.raise_error(
                F.concat(F.lit("chunk and vector do not pair at "), F.col(ordinal).cast("string"))
            ).cast(chunks.schema[ordinal].dataType),
        ).otherwise(F.col(ordinal)),
    ).drop("_c", "_v")
