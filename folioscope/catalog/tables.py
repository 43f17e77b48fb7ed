"""The driver tables and the views that queries share.

Each view reads whole tables.  ``*_SQL`` are the same views for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


# -- raw pages: a header line, the text, a bullet artifact and a page number ---

RAW_HEADERS = tuple(f"SRC{i}" for i in range(20))


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select(
        "doc_id",
        F.concat(
            F.col("source"), F.lit("\n"), F.col("text"), F.lit("\n[\n[  "), F.col("lang"),
            F.lit("\t   page \n"), F.col("doc_id").cast("string"),
        ).alias("text"),
    )


RAW_PAGES_SQL = (
    "SELECT doc_id, concat(source, chr(10), text, chr(10), '[', chr(10), '[  ', lang, "
    "chr(9), '   page ', chr(10), doc_id) AS text FROM documents"
)


# -- the same page text twice, as some extractions give it --------------------


def doubled_pages(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("doc_id", F.concat("text", F.lit("\n"), "text").alias("text"))


DOUBLED_SQL = "SELECT doc_id, concat(text, chr(10), text) AS text FROM documents"


# -- search terms in portable SQL ---------------------------------------------

_LATIN = r"_\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"


def terms_sql(column: str) -> str:
    """List of search terms of a text column.

    Words with accented letters are blanked first, since the word boundary of
    the SQL engine knows ASCII only.
    """
    plain = (
        f"regexp_replace(lower({column}), '[a-z0-9{_LATIN}]*[{_LATIN}][a-z0-9{_LATIN}]*', "
        "' ', 'g')"
    )
    found = f"regexp_extract_all({plain}, '[a-z0-9]+(?:[-/][a-z0-9]+)*')"
    return f"list_filter({found}, lambda t: len(t) > 1 OR regexp_matches(t, '^[0-9]$'))"


def upper_sql(expression: str) -> str:
    """Upper case with the sharp s written as two letters."""
    return f"upper(replace({expression}, 'ß', 'ss'))"


def strip_sql(expression: str) -> str:
    return rf"regexp_replace({expression}, '^\s+|\s+$', '', 'g')"


# -- retrieval: benchmark items ask, documents and embeddings answer ----------


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item with the vector of the same number."""
    b = table(spark, folder, "benchmark")
    e = table(spark, folder, "embeddings")
    return b.join(e, b.item_id == e.vec_id).select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.col("embedding").alias("vector"),
    )


def text_questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks: title is the language, file is the source."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("source").alias("document_id"),
        F.concat("source", F.lit(".pdf")).alias("pdf_file"),
        F.col("lang").alias("section_title"),
        "text",
        F.concat("lang", F.lit(" "), "text").alias("index_text"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        "embedding",
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("section_id"),
    )


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Expected section: the label of the query's vector.  Expected chunks: the
    three smallest ids of that label."""
    from ..operators.ordered import top_k

    v = vectors(spark, folder)
    first = top_k(v, ["section_id"], [F.asc("chunk_id")], 3)
    expected = first.groupBy("section_id").agg(
        F.array_sort(F.collect_list("chunk_id")).alias("expected_chunk_ids")
    )
    q = questions(spark, folder).select("query_id")
    own = v.select(F.col("chunk_id").alias("query_id"), "section_id")
    return (
        q.join(own, "query_id")
        .join(expected, "section_id")
        .select(
            "query_id", F.col("section_id").alias("expected_section_id"), "expected_chunk_ids"
        )
    )


QUESTIONS_SQL = (
    "SELECT b.item_id AS query_id, b.text AS query, e.embedding::DOUBLE[] AS vector "
    "FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id"
)
