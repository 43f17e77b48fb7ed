"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .factorization import Machine, fit

TERM_BITS = 24
STEM = 4
MAX_TRAINING_ROWS = 8_000  # bound of the labelled sample that the fit sees
MAX_TRAINING_TERMS = 4_000  # terms of one training text, those of least hash
CUT = 0.7


def hashed_terms(text: Column) -> Column:
    """Distinct hashes of the lower-cased words of a text and of their stems,
    the first letters; none if the text is null."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    whole = F.transform(words, lambda w: F.hash(w))
    stems = F.transform(words, lambda w: F.hash(F.lit("stem"), F.substring(w, 1, STEM)))
    mask = F.lit((1 << TERM_BITS) - 1)
    return F.array_distinct(F.transform(F.concat(whole, stems), lambda h: h.bitwiseAND(mask)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_TRAINING_ROWS,
) -> Machine:
    """A machine fitted on at most ``max_rows`` labelled rows, those of least
    hashed id.

    Only ids and labels of the sample are broadcast, both bounded by
    ``max_rows``; so are the hashed terms that the driver gathers.  An id with
    contradicting labels counts as toxic; null labels and ids are left out.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    sample = (
        known.groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    terms = F.slice(F.array_sort(hashed_terms(F.col("_text"))), 1, MAX_TRAINING_TERMS)
    rows = (
        texts.join(F.broadcast(sample), "_id")
        .select("_id", "_label", terms.alias("_terms"))
        .orderBy("_id", "_label", F.size("_terms"))
        .limit(2 * max_rows)
        .toArrow()
    )
    documents = [np.asarray(t.values, np.int64) for t in rows.column("_terms")]
    return fit(documents, rows.column("_label").to_numpy().astype(np.float64))


def _scored(df: DataFrame, machine: Machine, keep: list[str], text_col: str) -> DataFrame:
    """Columns ``keep``, renamed ``k0``, ``k1`` and so on, and ``score``."""
    names = [f"k{n}" for n in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            rows = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            scores = machine.scores(lists.flatten().to_numpy(), rows, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                batch.columns[: len(names)] + [pa.array(scores)], names=[*names, "score"]
            )

    kinds = [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, keep)]
    kept = [F.col(c).alias(n) for n, c in zip(names, keep)]
    hashed = df.select(*kept, hashed_terms(F.col(text_col)).alias("terms"))
    return hashed.mapInArrow(run, T.StructType([*kinds, T.StructField("score", T.DoubleType())]))


def score(df: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row; the whole text counts.

    A null or empty text gets the score of a text without known terms.  An
    empty table gives no rows.
    """
    return _scored(df, machine, [id_col], text_col).select(F.col("k0").alias(id_col), "score")


def keep_below(df: DataFrame, machine: Machine, *, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows with a score below ``cut``, with all their columns."""
    scored = _scored(df, machine, df.columns, text_col).where(F.col("score") < cut)
    return scored.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(df.columns)))


def held_out(id_col: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def learn(spark, folder, docs: DataFrame) -> Machine:
    """The machine of a test table folder, fitted on rows that are not held out."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~held_out(F.col("doc_id")))
    return train(docs, labels)


def op9_toxicity(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return score(docs, learn(spark, folder, docs)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
