"""Stream of single pages: a document is ingested once all of its pages came.

Pages of unfinished documents wait in a folder of their own, a generation for
each micro-batch: what waited before and what came in, less the documents that
are whole.  A batch that is delivered again starts from the same generation and
writes the same one, and stored tables take a chunk once, so nothing is lost or
doubled when a run is cut anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.chunking import DEFAULT_SIZE, ChunkSize
from ..operators.ordered import first_rows
from ..plans.ingest import Progress, ingest, store
from ..plugins import Embedder
from ..session import delete_dir, settle
from ..sources.tables import StoredTable

PAGE_COUNT = "page_count"
WAITING = f"{schemas.PAGES}, {PAGE_COUNT} int, batch bigint"


def _generation(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    try:
        return spark.read.schema(WAITING).parquet(f"{path}/generation={batch_id}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], WAITING)


def waiting_pages(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Pages that still waited after a batch."""
    return _generation(spark, path, batch_id)


def whole_documents(pages: DataFrame) -> DataFrame:
    """``document_id`` of documents with as many pages as one of them says.

    Different counts: the largest holds.  A page that came twice is one page;
    documents without a count go on waiting.
    """
    return (
        pages.groupBy("document_id")
        .agg(F.count_distinct("page_number").alias("_n"), F.max(PAGE_COUNT).alias("_all"))
        .where((F.col("_n") >= F.col("_all")) & F.col("document_id").isNotNull())
        .select("document_id")
    )


def start_page_ingest(
    pages: DataFrame,
    documents_of: Callable[[DataFrame], DataFrame],
    chunks: StoredTable,
    registry: StoredTable,
    checkpoint: str,
    waiting: str,
    embedder: Embedder | None = None,
    vectors: StoredTable | None = None,
    progress: Progress | None = None,
    size: ChunkSize = DEFAULT_SIZE,
    available_now: bool = True,
) -> StreamingQuery:
    """Stream of ``document_id, page_number, text, page_count`` rows through the
    way of :func:`plans.ingest.ingest`, document by document.

    ``page_count`` may be null on all pages but one.  Pages may come in any
    order and batch.  Of a page that comes again before its document is whole
    the first delivery counts, in one batch the one of least text; after that
    it is late and changes nothing.  Rows without a document id or page number
    are left out.  ``waiting`` belongs to this checkpoint; each batch rewrites
    the pages of unfinished documents only, and finished ones are found by the
    registry.
    """
    spark = pages.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        came = batch.where(F.col("document_id").isNotNull() & F.col("page_number").isNotNull())
        came = came.select("document_id", "page_number", "text", PAGE_COUNT, F.lit(batch_id).cast("bigint").alias("batch"))
        every = settle(came.unionByName(_generation(spark, waiting, batch_id - 1)), "pages")
        done = registry.present(every.select("document_id").distinct()) if registry.exists() else None
        if done is not None:
            every = every.join(done.select("document_id").distinct(), "document_id", "left_anti")
        whole = settle(whole_documents(every), "whole")
        rest = every.join(whole, "document_id", "left_anti")
        if not whole.isEmpty():
            told = every.join(whole, "document_id", "left_semi").drop(PAGE_COUNT)
            raw = settle(first_rows(told, ["document_id", "page_number"], ["batch", "text"]).drop("batch"), "raw_pages")
            documents = documents_of(raw)
            made = ingest(raw, documents, size=size, progress=progress)
            store(made, documents, chunks, registry, embedder, progress=progress, vector_table=vectors)
        rest.write.mode("overwrite").parquet(f"{waiting}/generation={batch_id}")
        delete_dir(spark, f"{waiting}/generation={batch_id - 2}")  # its successor is complete

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
