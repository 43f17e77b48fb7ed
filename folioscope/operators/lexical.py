"""BM25 index and search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.arrays import each
from ..functions.tokens import search_terms
from ..session import new_run_dir
from . import scoring


def corpus_text(title: Column, text: Column) -> Column:
    """Indexed text of a chunk: title, a space, body."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def term_table(
    corpus: DataFrame, item_id: str = "chunk_id", text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """``item_id, terms`` and the columns of ``keep``: every text cut into terms."""
    return corpus.select(item_id, search_terms(F.col(text)).alias("terms"), *keep)


def term_counts(table: DataFrame) -> DataFrame:
    """``term, df, length``: document count per term in one pass.

    The row with a null term counts the documents and sums their lengths; both
    kinds of row are reduced before the shuffle.
    """
    marked = each(
        table.select("terms"),
        [F.size("terms").alias("n")],
        F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string"))),
        "term",
    )
    return marked.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum(F.when(F.col("term").isNull(), F.col("n"))).alias("length"),
    )


def _raw_idf(n_docs: int) -> Column:
    return F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def floored_idf(terms: DataFrame, n_docs: int, floor: float) -> DataFrame:
    """``term, df, idf`` of ``term, df``; negative values are lifted to the floor."""
    raw = _raw_idf(n_docs)
    return terms.select("term", "df", F.when(raw < 0, F.lit(floor)).otherwise(raw).alias("idf"))


@dataclass
class Bm25Index:
    """Stored statistics and term table of a corpus, for searches that scan it.

    ``terms`` is ``term, df``; ``items`` is the :func:`term_table`, so a search
    neither reads nor cuts texts again.
    """

    n_docs: int
    average_length: float
    idf_floor: float
    terms: DataFrame
    items: DataFrame
    path: str

    def idf(self) -> DataFrame:
        """``term, df, idf``; negative values are lifted to the floor."""
        return floored_idf(self.terms, self.n_docs, self.idf_floor)

    def best(
        self, weights: DataFrame, k: int, item_id: str, query_id: str, k1: float, b: float, **limits
    ) -> DataFrame:
        """``query_id, item_id, score, rank`` for ``query_id, term, weight``."""
        scorer = scoring.term_scorer(self.average_length, k1, b, query_id)
        return scoring.best_k(self.items.select(item_id, "terms"), weights, scorer, k, item_id, query_id, **limits)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Bm25Index":
        row = spark.read.parquet(f"{path}/totals").first()
        terms = spark.read.parquet(f"{path}/terms").where(F.col("term").isNotNull()).select("term", "df")
        items = spark.read.parquet(f"{path}/items")
        return Bm25Index(row.n_docs, row.average_length, row.idf_floor, terms, items, path)


def build_index(
    corpus: DataFrame,
    text: str = "text",
    item_id: str = "chunk_id",
    keep: Sequence[str] = (),
    path: str | None = None,
    epsilon: float = K.BM25_EPSILON,
) -> Bm25Index:
    """Cut the corpus into terms once, count them and store both below ``path``
    (a new folder for the run if there is none).

    An index that is there is replaced.  Three numbers reach the driver; they
    are written last, so an index that was cut short cannot be loaded.
    """
    spark = corpus.sparkSession
    path = path or new_run_dir(spark, "bm25")
    none = spark.createDataFrame([], "n_docs bigint, average_length double, idf_floor double")
    none.write.mode("overwrite").parquet(f"{path}/totals")
    term_table(corpus, item_id, text, keep).write.mode("overwrite").parquet(f"{path}/items")
    counted = f"{path}/terms"
    term_counts(spark.read.parquet(f"{path}/items")).write.mode("overwrite").parquet(counted)
    counts = spark.read.parquet(counted)
    totals = counts.where(F.col("term").isNull()).first()
    n_docs = totals.df if totals else 0
    mean = counts.where(F.col("term").isNotNull()).agg(F.avg(_raw_idf(n_docs))).first()[0]
    row = (n_docs, (totals.length or 0) / n_docs if n_docs else 0.0, epsilon * (mean or 0.0))
    spark.createDataFrame([row], none.schema).write.mode("overwrite").parquet(f"{path}/totals")
    return Bm25Index.load(spark, path)


def reload_index(spark: SparkSession, path: str, current: Bm25Index) -> Bm25Index:
    """Load the index written at ``path``; keep the current one if there is none."""
    try:
        found = spark.read.parquet(f"{path}/totals").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return current
    return Bm25Index.load(spark, path) if found else current


def query_weights(
    queries: DataFrame, index: Bm25Index, text: str = "query", query_id: str = "query_id"
) -> DataFrame:
    """``query_id, term, weight``: idf times the number of times it is asked.

    Terms the corpus lacks keep weight 0; queries without terms disappear.
    """
    asked = (
        each(queries, [query_id], search_terms(F.col(text)), "term")
        .groupBy(query_id, "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    found = index.idf().join(asked, "term").select(
        query_id, "term", (F.col("idf") * F.col("times")).alias("weight")
    )
    return asked.join(found, [query_id, "term"], "left").select(
        query_id, "term", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )


def bm25_top_k(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = K.TOP_K,
    item_id: str = "chunk_id",
    text: str = "text",
    query_text: str = "query",
    query_id: str = "query_id",
    index: Bm25Index | None = None,
    k1: float = K.BM25_K1,
    b: float = K.BM25_B,
    **limits,
) -> DataFrame:
    """``query_id, item_id, bm25_score, rank``, highest score first.

    Documents without any query term score 0 and fill the list when fewer than
    ``k`` match; equal scores follow the id order.  With a stored ``index``, a
    :class:`Bm25Index` or a ``postings.PostingIndex``, the ``corpus`` is not
    read; without one it is cut into terms first and scanned.
    """
    index = index or build_index(corpus, text, item_id)
    weights = query_weights(queries, index, query_text, query_id)
    hits = index.best(weights, k, item_id, query_id, k1, b, **limits)
    return hits.withColumnRenamed("score", "bm25_score")


def bm25_top_k_prefiltered(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = K.TOP_K,
    item_id: str = "chunk_id",
    text: str = "text",
    query_text: str = "query",
    query_id: str = "query_id",
    index: Bm25Index | None = None,
    k1: float = K.BM25_K1,
    b: float = K.BM25_B,
    **limits,
) -> DataFrame:
    """As ``bm25_top_k``, ranking only chunks of each query's target document.

    A given ``index`` has to keep ``document_id`` and ``pdf_file``.
    """
    index = index or build_index(corpus, text, item_id, ("document_id", "pdf_file"))
    weights = query_weights(queries, index, query_text, query_id).join(
        queries.select(query_id, "has_target", "target_id", "target_file", "target_org"), query_id
    )
    items = index.items.select(
        item_id,
        "terms",
        F.lower(F.coalesce(F.col("document_id"), F.lit(""))).alias("_document"),
        F.regexp_replace(
            F.lower(F.coalesce(F.col("pdf_file"), F.lit(""))), r"\.pdf", ""
        ).alias("_file"),
    )
    hits = scoring.best_k(
        items,
        weights,
        scoring.term_scorer(index.average_length, k1, b, query_id, scoring.document_filter()),
        k,
        item_id,
        query_id,
        **limits,
    )
    return hits.withColumnRenamed("score", "bm25_score")
