"""From page texts to sections and chunks, for many documents at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.text import strip
from ..functions.tokens import Tokenizer
from ..operators import chunking, dense, headings
from ..operators.chunking import ChunkSize
from ..plugins import Embedder, embed
from ..session import settle
from ..sources.pages import clean_pages

Progress = Callable[[str, str, float], None]


@dataclass
class Ingested:
    pages: DataFrame
    sections: DataFrame
    chunks: DataFrame


def _identified(chunks: DataFrame, documents: DataFrame, prefix) -> DataFrame:
    """Chunk schema: ids and document fields added.

    ``documents`` is ``document_id, document_name, pdf_file``.
    """
    joined = chunks.join(documents, "document_id", "left")
    return joined.select(
        chunking.chunk_ids(F.col("section_id"), F.col("chunk_no"), prefix).alias("chunk_id"),
        "document_id",
        F.coalesce("document_name", "document_id").alias("document_name"),
        "pdf_file",
        "section_id",
        "section_title",
        "page_start",
        "page_end",
        "token_count",
        "text",
    )


def _section_chunks(
    paged: DataFrame, size: ChunkSize, tokenizer: Tokenizer | None
) -> DataFrame:
    if tokenizer is None and size.closed_form:
        return chunking.build_chunks(paged, size)
    return tokenized_section_chunks(paged, size, tokenizer)


def tokenized_section_chunks(
    paged: DataFrame, size: ChunkSize, tokenizer: Tokenizer | None
) -> DataFrame:
    """Chunks with a plug-in tokenizer.

    Sub-word tokens are only known after encoding, so a section is encoded as
    one row: sections have to fit in a task here.  The default word tokens have
    no such limit.
    """
    from collections.abc import Iterator

    import pandas as pd

    from ..functions.tokens import WordTokenizer

    tool = tokenizer or WordTokenizer()
    raw = "raw" if "raw" in paged.columns else "text"
    rows = paged.groupBy("document_id", "section_id", "section_title").agg(
        F.array_sort(
            F.collect_list(
                F.struct("page_number", F.col("text").alias("text"), F.col(raw).alias("raw"))
            )
        ).alias("pages")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                pages = list(row.pages)
                body = [
                    p["text"] if raw == "raw" else (p["text"] or "").strip()
                    for p in pages
                    if p["text"] is not None and (p["raw"] or "").strip()
                ]
                parts = chunking.chunk_with(tool, "\n\n".join(body), size)
                spans = page_spans(
                    [(p["page_number"], len(tool.encode(p["raw"] or ""))) for p in pages],
                    [n for _, n in parts],
                    size.overlap,
                )
                for number, ((text, n), (first, last)) in enumerate(zip(parts, spans), 1):
                    out.append(
                        (row.document_id, row.section_id, row.section_title, number,
                         first, last, n, text)
                    )
            yield pd.DataFrame(
                out,
                columns=["document_id", "section_id", "section_title", "chunk_no",
                         "page_start", "page_end", "token_count", "text"],
            )

    return rows.mapInPandas(
        run,
        "document_id string, section_id string, section_title string, chunk_no int, "
        "page_start int, page_end int, token_count int, text string",
    )


def page_spans(
    pages: list[tuple[int, int]], chunks: list[int], overlap: int
) -> list[tuple[int, int]]:
    """Pages of each chunk from token counts of pages and chunks.

    The cursor moves by the chunk size less the overlap and stops at the end.
    """
    import bisect
    from itertools import accumulate

    if not pages:
        return [(0, 0)] * len(chunks)
    ends = list(accumulate(n for _, n in pages))
    total = ends[-1]

    def page_at(index: int) -> int:
        if index < 0 or index >= total:
            return pages[-1][0]
        return pages[bisect.bisect_right(ends, index)][0]

    spans = []
    at = 0
    for n in chunks:
        spans.append((page_at(at), page_at(min(at + n, total) - 1)))
        at = min(total, at + (n - overlap if n > overlap else n))
    return spans


def ingest_profiled(
    pages: DataFrame,
    documents: DataFrame,
    size: ChunkSize = chunking.DEFAULT_SIZE,
    prefix: str = "who_001",
    tokenizer: Tokenizer | None = None,
    skip_pages: tuple[int, ...] = K.TOC_PAGES,
) -> Ingested:
    """The offline way for the profiled document: known section names, excluded
    sections cut at line level.  ``pages`` are cleaned page texts."""
    found = headings.profile_headings(pages, skip_pages)
    sections = headings.profile_sections(found, pages)
    included = sections.where(~P.is_excluded_title(F.col("section_title")))
    paged = chunking.trim_section_lines(chunking.section_pages(pages, included))
    chunks = _section_chunks(paged, size, tokenizer)
    return Ingested(pages, sections, _identified(chunks, documents, F.lit(prefix)))


def ingest(
    raw_pages: DataFrame,
    documents: DataFrame,
    bookmarks: DataFrame | None = None,
    layout: DataFrame | None = None,
    size: ChunkSize = chunking.DEFAULT_SIZE,
    tokenizer: Tokenizer | None = None,
    clean: bool = True,
    progress: Progress | None = None,
) -> Ingested:
    """The way for any document: clean, detect sections, chunk.

    ``documents`` is ``document_id, document_name, pdf_file``.  Cleaned pages,
    headings and chunks are written once each and read from there on.
    """
    tell = _teller(progress)
    tell("extract", "Cleaning pages")
    pages = settle(clean_pages(raw_pages, keep_blank=False), "clean_pages") if clean else raw_pages
    tell("extracted", "Pages are clean")
    tell("sections", "Detecting sections")
    found = headings.detect_headings(pages, bookmarks, layout)
    sections = headings.detected_sections(found, pages)
    tell("sectioned", "Sections are known")
    tell("chunks", "Building chunks")
    included = sections.where(~P.has_excluded_word(F.col("section_title")))
    paged = chunking.section_pages(pages, included).where(strip(F.col("text")) != "")
    chunks = _section_chunks(paged, size, tokenizer)
    chunks = settle(_identified(chunks, documents, F.col("document_id")), "chunks")
    tell("chunked", "Chunks are written")
    return Ingested(pages, sections, chunks)


def _teller(progress: Progress | None) -> Callable[[str, str], None]:
    percent = dict(K.STAGE_PERCENT)

    def tell(stage: str, message: str) -> None:
        if progress:
            progress(stage, message, percent[stage])

    return tell


def registry_rows(
    done: Ingested, documents: DataFrame, organization: str = "Clinical Guideline"
) -> DataFrame:
    """Registry entries of ingested documents with their totals."""
    chunks = done.chunks.groupBy("document_id").agg(
        F.count(F.lit(1)).cast("int").alias("total_chunks")
    )
    pages = done.pages.groupBy("document_id").agg(
        F.count(F.lit(1)).cast("int").alias("total_pages")
    )
    none = F.lit(None).cast("string")
    return (
        documents.join(chunks, "document_id")
        .join(pages, "document_id")
        .select(
            "document_id",
            "document_name",
            F.lit(organization).alias("organization"),
            none.alias("version"),
            none.alias("source_url"),
            none.alias("topic"),
            F.col("pdf_file").alias("local_file"),
            F.lit("indexed").alias("status"),
            "total_chunks",
            "total_pages",
        )
    )


def store(
    done: Ingested,
    documents: DataFrame,
    chunk_table,
    registry_table,
    embedder: Embedder | None = None,
    organization: str = "Clinical Guideline",
    progress: Progress | None = None,
    vector_table=None,
) -> int:
    """Write chunks (first write wins) and registry rows, reporting progress.

    With an embedder the stored chunks carry vectors; only chunks that are not
    stored yet are embedded, once.  With a ``vector_table`` they are upserted
    there as points, with the vectors of chunks stored earlier that have no
    point yet, as after a cut run.  Raises when no chunk came out of the documents.  Returns
    the number of stored chunks.
    """
    tell = _teller(progress)
    tell("start", "Starting ingestion")
    rows = settle(chunk_table.absent(done.chunks), "new_chunks")
    added = rows.count()
    if added and embedder is not None:
        tell("embed", "Embedding chunks")
        rows = settle(embed(rows, embedder), "vectors")
        tell("embedded", "Vectors are written")
    tell("index", "Writing chunks")
    points = None
    if vector_table is not None:
        held = settle(dense.to_points(chunk_table.present(done.chunks)), "held_points")
        points = vector_table.absent(held)
        if added:
            points = points.unionByName(dense.to_points(rows))
        points = settle(points, "points")
    if added:
        chunk_table.append(rows)
    elif done.chunks.isEmpty():
        raise ValueError("no chunk could be made from the documents")
    if points is not None and not points.isEmpty():
        vector_table.upsert(points, "point_id")
    registry_table.insert_if_absent(registry_rows(done, documents, organization))
    tell("done", f"Stored {added} chunks")
    return added
