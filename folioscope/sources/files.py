"""JSON and Parquet files with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schemas
from .pages import list_files


def read_json(
    spark: SparkSession, path: str, schema: str, lines: bool = False
) -> DataFrame:
    """JSON arrays of records, one array per file; ``lines``: one record per line.

    Only the line form can be split, so large data should come as lines (or
    Parquet).
    """
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_json_tolerant(
    spark: SparkSession,
    path: str,
    schema: str,
    wrapper: str = "chunks",
    lines: bool = False,
) -> DataFrame:
    """As :func:`read_json`; also takes ``{"<wrapper>": [...]}``.

    A missing or unreadable file gives no rows.
    """
    empty = spark.createDataFrame([], schema)
    names = empty.columns
    wrapped = f"{schema}, `{wrapper}` array<struct<{_fields(empty)}>>, _bad string"
    try:
        rows = (
            spark.read.schema(wrapped)
            .option("multiLine", not lines)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad")
            .json(path)
        )
        rows.isEmpty()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return empty
        raise
    good = rows.where(F.col("_bad").isNull())
    single = F.array(F.struct(*names))
    items = F.when(F.col(wrapper).isNull(), single).otherwise(F.col(wrapper))
    return good.select(F.explode(items).alias("r")).select("r.*")


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries of a JSON array, with their expected sections and chunks.

    Entries without an id or a query are left out; missing lists are empty.
    """
    rows = read_json_tolerant(spark, path, schemas.TEST_SET, "queries")
    return rows.where("query_id IS NOT NULL AND query IS NOT NULL").withColumns(
        {
            "expected_chunk_ids": F.coalesce("expected_chunk_ids", F.array().cast("array<string>")),
            "expected_pages": F.coalesce("expected_pages", F.array().cast("array<int>")),
        }
    )


def _fields(df: DataFrame) -> str:
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema.fields)


def write_json(df: DataFrame, path: str) -> None:
    """Overwrite a folder with JSON lines (read with ``lines=True``)."""
    df.write.mode("overwrite").json(path)


def registry_listing(spark: SparkSession, registry: str, folder: str) -> DataFrame:
    """``kind, name``: registered documents and the files of a folder."""
    known = read_json_tolerant(spark, registry, schemas.REGISTRY, "documents").select(
        F.lit("registry").alias("kind"), F.col("document_id").alias("name")
    )
    files = list_files(spark, folder).select(F.lit("file").alias("kind"), F.col("file").alias("name"))
    return known.unionByName(files)
