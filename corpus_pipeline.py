"""Corpus preparation: five stages over the documents table.

Every stage gets what its predecessor kept, reread from Parquet.  A stage's
result is written to the shared folder before the next one starts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from folioscope.session import new_run_dir, prepare, run_scope

# Share of the tokens that reach the mixing stage and go on; no document is
# taken twice, so the weights decide which leaves give way.
MIX_SHARE = 0.95


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the cut go."""
    machine = toxicity.learn(spark, sf_dir, docs)
    return toxicity.keep_below(docs, machine)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    found = near_dedup.near_duplicates(docs)
    dropped = found.where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought nearer to their target weights."""
    return mixing.take(docs, mixing.document_levels(), share=MIX_SHARE, seed=mixing.SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of them and of the text they
    decode to."""
    return bpe.round_trip(
        docs,
        rank_file=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

# Scores, sketches and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = new_run_dir(spark, f"pipeline-{number}")
        with run_scope(spark):  # what a stage settles is not needed after it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
