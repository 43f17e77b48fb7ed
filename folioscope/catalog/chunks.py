"""Chunking, page span and identifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import constants as K
from ..functions.vectors import point_id
from ..operators import chunking, dense, headings
from ..operators.chunking import ChunkSize
from ..plans import evaluate, ingest
from ..sources.pages import conversation_pages
from ..sources.tables import StoredTable
from ..session import new_run_dir
from ..streaming.ingest import (
    TEXT_CHUNKS, document_stream, start_document_ingest, start_ingest, text_chunks,
)
from ..streaming.waiting import start_page_ingest
from .structure import _HEADING_SQL
from .tables import SCHEMAS, strip_sql, table

SMALL = ChunkSize(target=50, maximum=80, minimum=30, overlap=10)


def chunk_windows(spark, d):
    docs = table(spark, d, "documents")
    return chunking.split_into_chunks(docs, keep=("doc_id",))


def windows_sql(source: str, key: str, size: ChunkSize) -> str:
    """Chunks as list slices; ``source`` gives ``key, text``.

    Windows are listed by their start tokens, then the last one is merged.
    """
    t, m, low, s = size.target, size.maximum, size.minimum, size.step
    return rf"""
src AS ({source}),
tok AS (SELECT {key}, {strip_sql('text')} AS body, regexp_extract_all({strip_sql('text')}, '\S+\s*') AS w
        FROM src),
cnt AS (SELECT *, len(w) AS n FROM tok),
starts AS (SELECT {key}, w, n, unnest(range(0, greatest(n - {size.overlap}, 1), {s})) AS st
           FROM cnt WHERE n > {m}),
win AS (SELECT *, least(st + {t}, n) - st AS len FROM starts WHERE st = 0 OR st < n - {t} + {s}),
rk AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY st DESC) AS back,
         first_value(len) OVER (PARTITION BY {key} ORDER BY st DESC) AS tail FROM win),
fix AS (SELECT *, tail < {low} AND tail + {t} <= {m} AS merges FROM rk),
parts AS (SELECT {key}, st, n, w, CASE WHEN merges AND back = 2
      THEN list_concat(list_slice(w, st + 1, st + {t}), list_slice(w, st + {s} + 1, n))
      ELSE list_slice(w, st + 1, st + len) END AS words
    FROM fix WHERE NOT (merges AND back = 1)),
made AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY st) AS chunk_no,
      {strip_sql("array_to_string(words, '')")} AS text, len(words) AS token_count FROM parts
    UNION ALL SELECT {key}, 1, body, n FROM cnt WHERE n BETWEEN 1 AND {m})"""


def chunk_stats(spark, d):
    chunks = evaluate.chunk_configs(table(spark, d, "documents"), ("doc_id",))
    return chunking.chunk_statistics(chunks, ("config_id",))


def _stats_sql() -> str:
    selects = []
    for config_id, _, target, maximum, minimum, overlap in K.CHUNK_CONFIGS:
        body = windows_sql(
            "SELECT doc_id, text FROM documents", "doc_id",
            ChunkSize(target, maximum, minimum, overlap),
        )
        selects.append(
            f"SELECT '{config_id}' AS config_id, token_count FROM (WITH {body} "
            "SELECT * FROM made)"
        )
    union = " UNION ALL ".join(selects)
    return f"""
SELECT config_id, count(*) AS total_chunks, CAST(min(token_count) AS INTEGER) AS min_tokens,
  CAST(max(token_count) AS INTEGER) AS max_tokens,
  CAST(sum(token_count) // count(*) AS INTEGER) AS avg_tokens
FROM ({union}) GROUP BY config_id"""


def _conversation_sections(spark, d):
    pages = conversation_pages(table(spark, d, "conversations"))
    return pages, headings.page_buckets(pages)


def chunk_pages(spark, d):
    """Chunks of page-bucket sections of the conversations, with page spans."""
    pages, sections = _conversation_sections(spark, d)
    paged = chunking.section_pages(pages, sections)
    return chunking.build_chunks(paged, SMALL).drop("section_title")


_BUCKETED = f"""
pg AS (SELECT conv_id::VARCHAR AS document_id, turn + 1 AS page, text,
   printf('sec_%03d', (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 + 1) AS section_id
  FROM conversations),
bounds AS (SELECT document_id || '/' || section_id AS k, page, len(regexp_extract_all(text, '\\S+')) AS c,
   sum(len(regexp_extract_all(text, '\\S+'))) OVER (PARTITION BY document_id, section_id ORDER BY page) AS e
  FROM pg),
"""


_BOUNDS = _BUCKETED[_BUCKETED.index("bounds AS") :]
_INGESTED = f"""
split AS (SELECT conv_id::VARCHAR AS document_id, turn + 1 AS page, generate_subscripts(l, 1) AS i,
    unnest(l) AS x FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations)),
kept AS (SELECT document_id, page, i, regexp_replace({strip_sql('x')}, '\\s+', ' ', 'g') AS line
  FROM split WHERE {strip_sql('x')} <> '' AND NOT regexp_full_match({strip_sql('x')}, '[0-9]+')),
fresh AS (SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY document_id, page ORDER BY i) AS before
  FROM kept) WHERE before IS NULL OR before <> line),
clean AS (SELECT document_id, page, string_agg(line, chr(10) ORDER BY i) AS text FROM fresh GROUP BY 1, 2),
titles AS (SELECT document_id, trim(line, ':-. ') AS title, min((page, i)) AS place FROM fresh
  WHERE {_HEADING_SQL} GROUP BY 1, 2),
ranged AS (SELECT document_id, title, place[1] AS start_page,
    row_number() OVER w AS n, lead(place[1]) OVER w AS nxt,
    count(*) OVER (PARTITION BY document_id) AS total FROM titles
  WINDOW w AS (PARTITION BY document_id ORDER BY place)),
lasts AS (SELECT document_id, max(page) AS lastp FROM clean GROUP BY 1),
grouped AS (SELECT document_id, page,
    (row_number() OVER (PARTITION BY document_id ORDER BY page) - 1) // 5 + 1 AS n FROM clean),
sections AS (
  SELECT document_id, printf('sec_%03d', n) AS section_id, title AS section_title, start_page,
    CASE WHEN nxt IS NULL THEN lastp ELSE greatest(start_page, nxt - 1) END AS end_page
  FROM ranged JOIN lasts USING (document_id) WHERE total >= 2
  UNION ALL
  SELECT document_id, printf('sec_%03d', n),
    printf('Guideline Content (Pages %d-%d)', min(page), max(page)), min(page), max(page)
  FROM grouped WHERE document_id NOT IN (SELECT document_id FROM ranged WHERE total >= 2)
  GROUP BY document_id, n),
pg AS (SELECT c.document_id, page, text, section_id FROM clean c JOIN sections s
    ON c.document_id = s.document_id AND page BETWEEN start_page AND end_page
  WHERE NOT regexp_matches(upper(section_title), '{"|".join(K.EXCLUDED_TITLE_WORDS)}')),
{_BOUNDS}"""


def _documents_of(pages):
    return pages.select("document_id").distinct().select(
        "document_id",
        F.concat(F.lit("Conversation "), F.col("document_id")).alias("document_name"),
        F.concat("document_id", F.lit(".pdf")).alias("pdf_file"),
    )


def build_document_chunks(spark, d):
    """The whole way for any document: clean, detect, chunk."""
    pages = conversation_pages(table(spark, d, "conversations"))
    return ingest.ingest(pages, _documents_of(pages), size=SMALL).chunks


def ingest_and_store(spark, d):
    """The whole way into stored tables, twice; the second run adds nothing."""
    folder = new_run_dir(spark, "ingested")
    pages = conversation_pages(table(spark, d, "conversations"))
    documents = _documents_of(pages)
    chunks = StoredTable(spark, f"{folder}/chunks", schemas.CHUNKS, "chunk_id")
    registry = StoredTable(spark, f"{folder}/registry", schemas.REGISTRY, "document_id")
    done = ingest.ingest(pages, documents, size=SMALL)
    for _ in range(2):
        ingest.store(done, documents, chunks, registry)
    return registry.read().select("document_id", "status", "total_chunks", "total_pages")


def stream_documents(spark, d):
    """The whole way, as a stream of page files into the stored tables."""
    folder = new_run_dir(spark, "streamed")
    turns = document_stream(spark, f"{d}/conversations.parquet", SCHEMAS["conversations"], 1_000_000)
    chunks = StoredTable(spark, f"{folder}/chunks", schemas.CHUNKS, "chunk_id")
    registry = StoredTable(spark, f"{folder}/registry", schemas.REGISTRY, "document_id")
    start_document_ingest(
        conversation_pages(turns), _documents_of, chunks, registry, f"{folder}/progress", size=SMALL
    ).awaitTermination()
    return chunks.read()


def stream_pages(spark, d):
    """The whole way, as a stream of single pages: the turns of a conversation
    stand in different files, each file is a batch, and the first turns come
    once more at the end.  Only the last turn tells how many there are."""
    folder = new_run_dir(spark, "paged")
    pages = conversation_pages(table(spark, d, "conversations"))
    last = pages.groupBy("document_id").agg(F.max("page_number").alias("page_count"))
    told = pages.join(last, "document_id").withColumn(
        "page_count", F.when(F.col("page_number") == F.col("page_count"), F.col("page_count"))
    )
    for n in range(2):
        part = told.where(F.pmod(F.xxhash64("document_id", "page_number"), F.lit(2)) == n)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    late = told.where(F.col("page_number") == 1).withColumn("text", F.reverse("text"))
    late.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    chunks = StoredTable(spark, f"{folder}/chunks", schemas.CHUNKS, "chunk_id")
    registry = StoredTable(spark, f"{folder}/registry", schemas.REGISTRY, "document_id")
    stream = spark.readStream.schema(told.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start_page_ingest(
        stream, _documents_of, chunks, registry, f"{folder}/progress", f"{folder}/waiting", size=SMALL
    ).awaitTermination()
    return chunks.read()


def store_vectors(spark, d):
    """Points by stable id: stored, stored again with other payloads, counted."""
    points = StoredTable(spark, new_run_dir(spark, "points"), schemas.POINTS, "point_id")
    v = table(spark, d, "embeddings").select(
        F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("chunk_id"),
        F.col("label").cast("string").alias("document_id"),
        "embedding",
        F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"),
        F.size("embedding").alias("token_count"),
        *(F.lit("").alias(c) for c in ("document_name", "pdf_file", "section_id", "section_title", "text")),
    )
    stored = dense.to_points(v)
    points.upsert(stored, "point_id")
    again = v.where(F.col("document_id") == "1").withColumn("text", F.lit("again"))
    points.upsert(dense.to_points(again), "point_id")
    return points.read().select(
        "point_id", "payload.chunk_id", "payload.document_id", "payload.text",
        F.size("embedding").alias("dimensions"),
    )


def section_chunks_trimmed(spark, d):
    """Chunks after cutting at an excluded line and dropping title repeats."""
    pages, sections = _conversation_sections(spark, d)
    first = pages.join(
        sections.select("document_id", F.col("start_page").alias("page_number"), "section_id"),
        ["document_id", "page_number"],
    ).select(
        "document_id", "section_id", F.element_at(F.split("text", "\n", -1), 1).alias("title")
    )
    titled = sections.drop("section_title").join(
        first.withColumnRenamed("title", "section_title"), ["document_id", "section_id"]
    )
    paged = chunking.trim_section_lines(
        chunking.section_pages(pages, titled), excluded=TRIM_TITLES
    )
    return chunking.build_chunks(paged, SMALL).select(
        "document_id", "section_id", "chunk_no", "page_start", "page_end", "token_count", "text"
    )


TRIM_TITLES = ("OF.", "AS.", "ES.", "THE.", "LE.", "DE.", "QUE.", "AND.", "IN.", "RE.")


def _trimmed_sql() -> str:
    source = f"""
SELECT k, string_agg(line, chr(10) ORDER BY page, i) AS text FROM (
  SELECT *, count(*) FILTER (WHERE upper({strip_sql('line')}) = title) OVER (PARTITION BY k ORDER BY page, i) AS seen
  FROM (SELECT *, min(CASE WHEN upper({strip_sql('line')}) IN {TRIM_TITLES!r} THEN page * 100000 + i END)
      OVER (PARTITION BY k) AS cut FROM (
    SELECT document_id || '/' || section_id AS k, page, generate_subscripts(l, 1) AS i, unnest(l) AS line,
      upper({strip_sql("first_value(l[1]) OVER (PARTITION BY document_id, section_id ORDER BY page)")}) AS title
    FROM (SELECT *, list_concat(CASE WHEN page > min(page) OVER (PARTITION BY document_id, section_id)
        THEN [''] ELSE [] END, string_split({strip_sql('text')}, chr(10))) AS l FROM pg)))
  WHERE cut IS NULL OR page * 100000 + i < cut)
WHERE upper({strip_sql('line')}) <> title OR seen = 1 GROUP BY k"""
    return source


def point_ids(spark, d):
    chunks = chunk_windows(spark, d)
    name = F.concat(
        F.lit("doc_"), F.col("doc_id").cast("string"), F.format_string("_c%03d", "chunk_no")
    )
    return chunks.select(name.alias("chunk_id"), point_id(name).alias("point_id"))


def stream_ingest(spark, d):
    """Documents through the file stream into a fresh chunk table."""
    folder = new_run_dir(spark, "stream")
    documents = document_stream(spark, f"{d}/documents.parquet", SCHEMAS["documents"]).select(
        F.col("doc_id").cast("string").alias("document_id"), "text"
    )
    chunks = StoredTable(spark, f"{folder}/chunks", TEXT_CHUNKS, "chunk_id")
    start_ingest(documents, chunks, f"{folder}/progress", text_chunks).awaitTermination()
    return chunks.read()


def zip_vectors(spark, d):
    """Vectors paired with texts of the same ordinal."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", "label")
    texts = v.select("ord", F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"))
    paired = dense.zip_embeddings(texts, v.select("ord", "embedding"))
    return paired.select("ord", "text", F.size("embedding").alias("dimensions"))


_SPANS = f"""
pos AS (SELECT *, coalesce(sum(CASE WHEN token_count > {SMALL.overlap} THEN token_count - {SMALL.overlap}
    ELSE token_count END) OVER (PARTITION BY k ORDER BY chunk_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM made),
tot AS (SELECT k, sum(c) AS total FROM bounds GROUP BY k),
idx AS (SELECT pos.*, least(p, total) AS a, least(p + token_count, total) - 1 AS b FROM pos JOIN tot USING (k)),
spans AS (SELECT string_split(k, '/')[1] AS document_id, string_split(k, '/')[2] AS section_id,
  CAST(chunk_no AS INTEGER) AS chunk_no,
  CAST((SELECT min(page) FROM bounds t WHERE t.k = idx.k AND t.e > a AND t.e - t.c <= a) AS INTEGER) AS page_start,
  CAST((SELECT min(page) FROM bounds t WHERE t.k = idx.k AND t.e > b AND t.e - t.c <= b) AS INTEGER) AS page_end,
  CAST(token_count AS INTEGER) AS token_count, text FROM idx)"""

QUERIES = {
    "chunk_windows": chunk_windows,
    "chunk_stats": chunk_stats,
    "chunk_pages": chunk_pages,
    "section_chunks_trimmed": section_chunks_trimmed,
    "build_document_chunks": build_document_chunks,
    "point_ids": point_ids,
    "zip_vectors": zip_vectors,
    "stream_ingest": stream_ingest,
    "stream_documents": stream_documents,
    "stream_pages": stream_pages,
    "ingest_and_store": ingest_and_store,
    "store_vectors": store_vectors,
}

_DOC_WINDOWS = windows_sql("SELECT doc_id, text FROM documents", "doc_id", ChunkSize())
_SECTION_SOURCE = f"""SELECT document_id || '/' || section_id AS k,
  string_agg({strip_sql('text')}, chr(10) || chr(10) ORDER BY page) AS text FROM pg
  WHERE {strip_sql('text')} <> '' GROUP BY 1"""
_CHUNK_POINTS = (
    f"WITH {_DOC_WINDOWS}, ids AS (SELECT concat('doc_', doc_id, printf('_c%03d', chunk_no)) "
    "AS chunk_id FROM made), h AS (SELECT chunk_id, "
    f"sha1(unhex('{K.DNS_NAMESPACE_HEX}') || encode(chunk_id)) AS h FROM ids) "
)

ORACLE = {
    "chunk_windows": f"""
WITH {_DOC_WINDOWS} SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, text,
  CAST(token_count AS INTEGER) AS token_count FROM made""",
    "chunk_stats": _stats_sql(),
    "chunk_pages": f"""
WITH {_BUCKETED} {windows_sql(_SECTION_SOURCE, 'k', SMALL)}, {_SPANS} SELECT * FROM spans""",
    "build_document_chunks": f"""
WITH {_INGESTED} {windows_sql(_SECTION_SOURCE, 'k', SMALL)}, {_SPANS}
SELECT concat(document_id, '_', section_id, printf('_c%03d', chunk_no)) AS chunk_id, document_id,
  concat('Conversation ', document_id) AS document_name, concat(document_id, '.pdf') AS pdf_file,
  section_id, section_title, page_start, page_end, token_count, text
FROM spans JOIN sections USING (document_id, section_id)""",
    "section_chunks_trimmed": f"""
WITH {_BUCKETED} {windows_sql(_trimmed_sql(), 'k', SMALL)}, {_SPANS} SELECT * FROM spans""",
    "point_ids": _CHUNK_POINTS + """
SELECT chunk_id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-',
  ['8','9','a','b'][1 + (instr('0123456789abcdef', h[17]) - 1) % 4], h[18:20], '-', h[21:32]) AS point_id
FROM h""",
    "zip_vectors": """
SELECT vec_id AS ord, concat('label ', label) AS text, CAST(len(embedding) AS INTEGER) AS dimensions
FROM embeddings""",
    "stream_ingest": f"""
WITH {_DOC_WINDOWS} SELECT concat(doc_id, printf('_c%03d', chunk_no)) AS chunk_id,
  doc_id::VARCHAR AS document_id, CAST(chunk_no AS INTEGER) AS chunk_no,
  CAST(token_count AS INTEGER) AS token_count, text FROM made""",
}
ORACLE["stream_documents"] = ORACLE["build_document_chunks"]
ORACLE["stream_pages"] = ORACLE["build_document_chunks"]
ORACLE["ingest_and_store"] = f"""
WITH {_INGESTED} {windows_sql(_SECTION_SOURCE, 'k', SMALL)}, {_SPANS},
c AS (SELECT document_id, CAST(count(*) AS INTEGER) AS total_chunks
  FROM spans JOIN sections USING (document_id, section_id) GROUP BY document_id),
p AS (SELECT document_id, CAST(count(*) AS INTEGER) AS total_pages FROM clean GROUP BY document_id)
SELECT document_id, 'indexed' AS status, total_chunks, total_pages FROM c JOIN p USING (document_id)"""
ORACLE["store_vectors"] = f"""
WITH h AS (SELECT vec_id, label, embedding,
    sha1(unhex('{K.DNS_NAMESPACE_HEX}') || encode(concat('vec_', vec_id))) AS h FROM embeddings)
SELECT concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-',
  ['8','9','a','b'][1 + (instr('0123456789abcdef', h[17]) - 1) % 4], h[18:20], '-', h[21:32]) AS point_id,
  concat('vec_', vec_id) AS chunk_id, label::VARCHAR AS document_id,
  CASE WHEN label = 1 THEN 'again' ELSE '' END AS text, CAST(len(embedding) AS INTEGER) AS dimensions FROM h"""
