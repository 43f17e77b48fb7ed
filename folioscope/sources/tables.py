"""Stored tables: Parquet folders that Spark partitions by a hash of the key.

A write touches the partitions of its own keys only.  Inserts append to them;
upserts and deletes write them anew, from a settled copy, by Spark's dynamic
partition overwrite.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state, validation
from ..session import settle

PART, LIVE = "_part", "_live"


class StoredTable:
    """Rows of ``schema`` below ``path``, keyed by column ``key``.

    ``parts`` is fixed for the life of a table: choose it so that a partition
    is rewritten in reasonable time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, parts: int = 16) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema
        self.key = key
        self.parts = parts
        self.columns = spark.createDataFrame([], schema).columns

    # -- reading

    def _stored(self) -> DataFrame:
        whole = f"{self.schema}, {LIVE} boolean, {PART} int"
        try:
            return self.spark.read.schema(whole).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], whole)

    def exists(self) -> bool:
        try:
            self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def read(self) -> DataFrame:
        return self._stored().where(LIVE).select(self.columns)

    def count(self) -> int:
        return self.read().count()

    # -- writing

    def _part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _of(self, touched: list[int]) -> DataFrame:
        stored = self._stored().where(LIVE)
        return stored.where(F.col(PART).isin(touched)).select(self.columns)

    def _touched(self, rows: DataFrame) -> list[int]:
        """Partitions of these keys: at most ``parts`` numbers."""
        return [r[0] for r in rows.select(self._part()).distinct().collect()]

    def _write(self, rows: DataFrame, mode: str, touched: list[int] = ()) -> None:
        """Write rows into their partitions.  Overwriting needs a row in every
        touched partition, so each gets one that is not live."""
        placed = rows.select(*self.columns, F.lit(True).alias(LIVE), self._part().alias(PART))
        if touched:
            marks = self.spark.createDataFrame([(n,) for n in touched], f"{PART} int")
            nulls = [F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in self.columns]
            placed = placed.unionByName(marks.select(*nulls, F.lit(False).alias(LIVE), PART))
        placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(
            self.path
        )

    def overwrite(self, rows: DataFrame) -> None:
        """Drop the content and store ``rows``, which may come from the table."""
        self._write(settle(rows.select(self.columns), "stored_rows"), "overwrite", list(range(self.parts)))

    def absent(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is not stored; only their partitions are read.
        Give written rows, since they are read twice."""
        keys = self._of(self._touched(rows)).select(self.key).distinct()
        return rows.join(keys, self.key, "left_anti")

    def present(self, rows: DataFrame) -> DataFrame:
        """The stored rows that have a key of ``rows``; only their partitions
        are read.  Give written rows, since they are read twice."""
        return self._of(self._touched(rows)).join(rows.select(self.key), self.key, "left_semi")

    def append(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def insert_if_absent(self, rows: DataFrame) -> None:
        """First write wins; repeats inside the batch all pass."""
        self.append(self.absent(settle(rows.select(self.columns), "new_rows")))

    def upsert(self, rows: DataFrame, version: str) -> None:
        """Last write wins."""
        batch = settle(rows.select(self.columns), "new_rows")
        touched = self._touched(batch)
        content = state.upsert(self._of(touched), batch, self.key, version)
        self._write(settle(content, "stored_rows"), "overwrite", touched)

    def delete(self, keys: DataFrame, on: list[str]) -> None:
        touched = self._touched(keys) if self.key in on else list(range(self.parts))
        content = state.delete_keys(self._of(touched), keys, on)
        self._write(settle(content, "stored_rows"), "overwrite", touched)


def publish(
    chunks: DataFrame, issues: DataFrame, table: StoredTable, strict: bool = False
) -> bool:
    """Store chunks only when no issue is an error."""
    if validation.has_errors(issues):
        if strict:
            raise RuntimeError("blocking errors found, chunks are not published")
        return False
    table.overwrite(chunks)
    return True


def write_report(chunks: DataFrame, issues: DataFrame, path: str) -> None:
    """Totals and issues as two data sets; the issues are never gathered."""
    issues.write.mode("overwrite").parquet(f"{path}/issues")
    stored = issues.sparkSession.read.parquet(f"{path}/issues")
    validation.summary(chunks, stored).withColumn(
        "created_at", F.current_timestamp()
    ).write.mode("overwrite").json(f"{path}/summary")
