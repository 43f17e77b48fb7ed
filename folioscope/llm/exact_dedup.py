"""Exact deduplication by sorting content."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle

HEAD = 64  # characters of a text that the sampled splitters look at


def _hot(work: DataFrame) -> DataFrame:
    """Hashes of texts with more rows or bytes than a partition holds on average.

    One row per such hash with the number of parts its rows are dealt to.  At
    most two times the partition count of rows can exceed the average, and the
    parts add up to at most four times that count, whatever the input.
    """
    spark = work.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = settle(
        work.groupBy("_hash").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_text")).alias("bytes")
        ),
        "text_counts",
    )
    total = sizes.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).head()
    rows, size = max(total["n"] or 0, partitions), max(total["bytes"] or 0, partitions)
    parts = F.ceil(
        F.greatest(F.col("n") * F.lit(partitions) / rows, F.col("bytes") * F.lit(partitions) / size)
    )
    hot = sizes.where("n > 1").select("_hash", parts.cast("int").alias("_parts")).where("_parts > 1")
    return settle(hot, "hot_texts")


def mark_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept`` and
    ``text_sha256``; the columns of ``carry`` come along in a struct ``carried``,
    the text itself as ``text`` inside it when it is named there.

    Sampled splitters deal the (normalised) texts to ranges, every range is
    sorted by Spark's external sort, and neighbours are compared in full.  The
    splitters look at the first characters and a hash, so a sample of long
    texts stays small; the comparison is of whole texts.

    A text whose copies exceed an average partition is dealt to several parts
    by a salt of the id.  Its parts are merged through one aggregated row per
    such text; their number is bounded by the partition count, so that table
    is broadcast.

    A null text counts as empty.  Of equal texts the row with the smallest id
    (``keep="largest"``: the largest) stays; null ids come last; of rows that
    repeat both id and text one stays.  An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    text = F.col(text_col)
    text = F.coalesce(normalise(text) if normalise else text, F.lit(""))
    carried = [F.col(c).alias(c) for c in carry if c != text_col]
    work = df.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        (F.struct(*carried) if carried else F.lit(None).cast("boolean")).alias("_carried"),
    )
    work = work.withColumn("_hash", F.xxhash64("_text"))
    hot = _hot(work)
    best = F.min if keep == "smallest" else F.max
    merged = settle(
        work.join(F.broadcast(hot), "_hash")
        .groupBy("_text")
        .agg(best("_id").alias("_all_keep"), F.count(F.lit(1)).alias("_all_size"))
        .select(F.sha2("_text", 256).alias("_sha"), "_all_keep", "_all_size"),
        "hot_groups",
    )
    salted = (
        work.join(F.broadcast(hot), "_hash", "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_id"), "_parts"), F.lit(0)))
        .withColumn("_head", F.substring("_text", 1, HEAD))
    )
    keys = ["_head", "_hash", "_salt"]
    dealt = salted.repartitionByRange(*keys)
    first = F.asc_nulls_last("_id") if keep == "smallest" else F.desc_nulls_last("_id")
    run = Window.partitionBy(*keys, "_text").orderBy(first)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = dealt.select(
        "_id",
        "_carried",
        "_salt",
        "_parts",
        *(["_text"] if text_col in carry else []),
        F.sha2("_text", 256).alias("_sha"),
        F.row_number().over(run).alias("_n"),
        F.first("_id").over(whole).alias("_keep"),
        F.count(F.lit(1)).over(whole).alias("_size"),
    )
    done = runs.join(F.broadcast(merged), "_sha", "left")
    split = F.col("_all_size").isNotNull()
    keep_id = F.when(split, F.col("_all_keep")).otherwise(F.col("_keep"))
    columns = [
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.when(split, F.col("_all_size")).otherwise(F.col("_size")).alias("group_size"),
        ((F.col("_n") == 1) & F.col("_id").eqNullSafe(keep_id)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    ]
    if carry:
        fields = [
            F.col("_text").alias(c) if c == text_col else F.col("_carried").getField(c).alias(c)
            for c in carry
        ]
        columns.append(F.struct(*fields).alias("carried"))
    return done.select(*columns)


def drop_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest"
) -> DataFrame:
    """The rows of ``df`` that stay, with all its columns.  Null texts come back
    as empty ones."""
    marked = mark_copies(df, id_col, text_col, keep=keep, carry=df.columns)
    return marked.where("kept").select(*(F.col("carried").getField(c).alias(c) for c in df.columns))


# -- the query ----------------------------------------------------------------


def op5_exact_dedup(spark, folder):
    return mark_copies(spark.read.parquet(f"{folder}/documents.parquet"), keep="largest")


SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE = {"op5_exact_dedup": SQL}
