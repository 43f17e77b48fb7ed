"""File stream of documents into the chunk table.

Each micro-batch runs the batch operators.  Chunk ids are stable, and the table
takes a chunk id once, so a batch delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.chunking import DEFAULT_SIZE, ChunkSize, split_into_chunks
from ..plans.ingest import Progress, ingest, store
from ..plugins import Embedder
from ..session import settle
from ..sources.tables import StoredTable

TEXT_CHUNKS = "chunk_id string, document_id string, chunk_no int, token_count int, text string"


def document_stream(
    spark: SparkSession, path: str, schema: str, files_per_batch: int = 64
) -> DataFrame:
    """New Parquet files of a table as a stream.

    ``path`` is a folder of part files or one file.  A stream takes a single
    file only as a match of a pattern, so the last letter stands in brackets.
    """
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{path[:-1]}[{path[-1]}]")
    )


def text_chunks(documents: DataFrame, size: ChunkSize = DEFAULT_SIZE) -> DataFrame:
    """Chunk rows of ``document_id, text`` rows, with stable ids."""
    chunks = split_into_chunks(documents, size=size, keep=("document_id",))
    return chunks.select(
        F.concat("document_id", F.format_string("_c%03d", "chunk_no")).alias("chunk_id"),
        "document_id",
        "chunk_no",
        "token_count",
        "text",
    )


def start_ingest(
    documents: DataFrame,
    table: StoredTable,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = text_chunks,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream; each batch is prepared and inserted if absent."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch).dropDuplicates(["chunk_id"]).persist()
        try:
            table.insert_if_absent(rows)
        finally:
            rows.unpersist()

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_document_ingest(
    pages: DataFrame,
    documents_of: Callable[[DataFrame], DataFrame],
    chunks: StoredTable,
    registry: StoredTable,
    checkpoint: str,
    embedder: Embedder | None = None,
    vectors: StoredTable | None = None,
    progress: Progress | None = None,
    size: ChunkSize = DEFAULT_SIZE,
    available_now: bool = True,
) -> StreamingQuery:
    """Stream of raw pages through the whole way of :func:`plans.ingest.ingest`.

    Every micro-batch is cleaned, cut into sections and chunks, embedded where
    an embedder is given, stored and registered, with all stages reported.
    All pages of a document have to come in one batch, as they do when a file
    holds whole documents.  A batch that is delivered again adds nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        raw = settle(batch, "raw_pages")
        if raw.isEmpty():
            return
        documents = documents_of(raw)
        done = ingest(raw, documents, size=size, progress=progress)
        store(done, documents, chunks, registry, embedder, progress=progress, vector_table=vectors)

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


class ProgressListener(StreamingQueryListener):
    """Passes stream progress on as ``(stage, message, percent)`` calls."""

    def __init__(self, progress: Callable[[str, str, float], None]) -> None:
        self.progress = progress

    def onQueryStarted(self, event) -> None:
        self.progress("start", f"stream {event.name or event.id} started", 2.0)

    def onQueryProgress(self, event) -> None:
        done = event.progress
        self.progress("index", f"batch {done.batchId}: {done.numInputRows} documents", 88.0)

    def onQueryIdle(self, event) -> None:
        self.progress("idle", "no new documents", 100.0)

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self.progress("error" if failed else "done", event.exception or "stream ended", 100.0)
