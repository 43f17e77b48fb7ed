"""Queries over files, reports and stored application state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import constants as K
from ..operators import dense, lexical, state
from ..plans import ingest
from ..plans.evaluate import timed
from ..session import new_run_dir, settle
from ..sources import tables as stores
from ..sources.chats import open_state
from ..sources.files import read_json, write_json
from ..sources.pages import conversation_pages
from ..sources.tables import StoredTable
from . import chunks as chunk_queries
from . import evaluation, retrieval, validation
from .tables import corpus, questions, table, text_questions, vectors

ARRAY_ROWS = 64


def json_arrays(spark, d):
    """Documents as files of JSON arrays, read with a fixed schema."""
    folder = new_run_dir(spark, "arrays")
    docs = table(spark, d, "documents")
    arrays = docs.groupBy(F.floor(F.col("doc_id") / ARRAY_ROWS)).agg(
        F.to_json(F.collect_list(F.struct("doc_id", "text", "lang"))).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return read_json(spark, folder, "doc_id bigint, text string, lang string")


def replaced_points(spark, d):
    """A vector collection with other content is dropped and made anew; its
    sizes are told."""
    points = StoredTable(spark, new_run_dir(spark, "collection"), schemas.POINTS, "point_id")
    v = vectors(spark, d).select(
        F.concat(F.lit("vec_"), F.col("chunk_id").cast("string")).alias("chunk_id"),
        F.col("section_id").alias("document_id"), F.col("embedding"), F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"), F.size("embedding").alias("token_count"),
        *(F.lit("").alias(c) for c in ("document_name", "pdf_file", "section_id", "section_title", "text")),
    )
    points.overwrite(dense.to_points(v.withColumn("chunk_id", F.concat(F.lit("old_"), "chunk_id"))))
    points.overwrite(dense.to_points(v))
    return points.read().groupBy(F.col("payload.document_id").alias("label")).agg(
        F.count(F.lit(1)).alias("points"), F.max(F.size("embedding")).alias("dimensions")
    )


def validation_summary(spark, d):
    """The report of all checks, written as data sets and read again."""
    path = new_run_dir(spark, "report")
    chunks = settle(validation.faulty_chunks(spark, d), "faulty")
    stores.write_report(chunks, validation._all_issues(spark, d, chunks), path)
    totals = "total_chunks bigint, error_count bigint, warning_count bigint, info_count bigint"
    return read_json(spark, f"{path}/summary", totals, lines=True)


def experiment_results(spark, d):
    """Results of the sweep over k, written as JSON and read again."""
    path = new_run_dir(spark, "sweep")
    found = evaluation.k_sweep(spark, d)
    write_json(found, path)
    return spark.read.schema(found.schema).json(path)


def reloaded_index(spark, d):
    """A missing index leaves the current one in place; a stored one is taken."""
    path = new_run_dir(spark, "reloaded")
    small = lexical.build_index(text_questions(spark, d).withColumnsRenamed({"query_id": "chunk_id", "query": "text"}))
    kept = lexical.reload_index(spark, path, small)
    if kept is not small:
        raise RuntimeError("a missing index was loaded")
    lexical.build_index(corpus(spark, d), "index_text", path=path)
    index = lexical.reload_index(spark, path, kept)
    return lexical.bm25_top_k(None, text_questions(spark, d), K.TOP_K, index=index)


def _customers(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.lower(F.concat("c_name", F.lit("@x.org"))).alias("email"),
        F.lit("h").alias("password_hash"),
        F.col("c_custkey").alias("created_at"),
    )


def find_user(spark, d):
    """The last customer by id, the first by an email typed untidily."""
    users = open_state(spark, new_run_dir(spark, "users"))["users"]
    users.insert_if_absent(_customers(spark, d))
    stored = users.read()
    last = stored.orderBy(F.desc("created_at")).select("id").first()[0]
    first = stored.orderBy("created_at").select("email").first()[0]
    by_id = state.find_user(stored, "id", last)
    return by_id.unionByName(state.find_user(stored, "email", f"  {first.upper()} "))


def append_reports(spark, d):
    """Events as reports, appended in two batches; nothing is replaced."""
    reports = open_state(spark, new_run_dir(spark, "reports"))["patient_reports"]
    events = table(spark, d, "events")
    rows = events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("filename"),
        F.col("props").alias("vitals_json"),
        F.lit("").alias("summary_text"),
        state.now_millis().alias("uploaded_at"),
    )
    started = spark.range(1).select(state.now_millis()).first()[0]
    for half in range(2):
        reports.append(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half))
    return reports.read().select("id", "user_id", "filename", "vitals_json", (F.col("uploaded_at") >= started).alias("dated"))


def state_tables(spark, d):
    """Users, chats and reports in their three tables under one folder."""
    folder = new_run_dir(spark, "state")
    made = open_state(spark, folder)
    made["users"].insert_if_absent(_customers(spark, d))
    events = table(spark, d, "events")
    key = F.col("event_id").cast("string").alias("id")
    owner = F.col("user_id").cast("string").alias("user_id")
    made["user_chats"].insert_if_absent(
        events.select(key, owner, F.col("event_type").alias("title"), F.col("props").alias("data_json"), F.col("event_id").alias("updated_at"))
    )
    made["patient_reports"].append(
        events.select(key, owner, F.col("event_type").alias("filename"), F.col("props").alias("vitals_json"), F.lit("").alias("summary_text"), F.col("event_id").alias("uploaded_at"))
    )
    again = open_state(spark, folder)
    counts = [
        t.read().agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct(t.key).alias("keys"))
        for name, t in again.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def ingest_stages(spark, d):
    """What an ingestion reports on its way, with the chunks it stored."""
    folder = new_run_dir(spark, "staged")
    pages = conversation_pages(table(spark, d, "conversations"))
    documents = chunk_queries._documents_of(pages)
    chunks = StoredTable(spark, f"{folder}/chunks", schemas.CHUNKS, "chunk_id")
    registry = StoredTable(spark, f"{folder}/registry", schemas.REGISTRY, "document_id")
    told: list[tuple[str, float]] = []

    def progress(stage, message, percent):
        told.append((stage, percent))

    done = ingest.ingest(pages, documents, size=chunk_queries.SMALL, progress=progress)
    ingest.store(done, documents, chunks, registry, progress=progress)
    rows = [(n, stage, percent) for n, (stage, percent) in enumerate(told)]
    stages = spark.createDataFrame(rows, "n int, stage string, percent double")
    return stages.select("n", "stage", "percent", F.lit(chunks.count()).cast("bigint").alias("stored"))


def mode_latency(spark, d):
    """Wall time of a search in both modes, and whether one was measured."""
    found = []
    for mode, build in {
        "dense": lambda: dense.dense_top_k(vectors(spark, d), questions(spark, d)),
        "sparse": lambda: retrieval.retrieve_bm25(spark, d),
    }.items():
        counts: list[int] = []
        took = timed(mode, build, lambda df: counts.append(df.count()))
        found.append((mode, counts[0], took["latency_ms"] > 0.0))
    return spark.createDataFrame(found, "mode string, hits bigint, measured boolean")


def attach_given_patient(spark, d):
    """A record given with the question comes first, then the stored report,
    then the session's profile for those without a user."""
    reports = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last")).select(
        F.col("user_id").cast("string").alias("user_id"),
        F.struct(F.col("last").alias("value")).alias("vitals"),
        F.lit("stored").alias("summary"),
    )
    item = F.col("item_id")
    asked = table(spark, d, "benchmark").select(
        item.alias("query_id"),
        F.when(item % 3 != 0, item.cast("string")).alias("user_id"),
        F.when(item % 4 == 0, F.struct((-item).alias("value"))).alias("patient"),
        F.struct((item + 1_000_000).alias("value")).alias("session_patient"),
    )
    found = state.attach_patient(asked, reports)
    return found.select("query_id", "user_id", F.col("vitals.value").alias("value"), "summary")


QUERIES = {
    "json_arrays": json_arrays,
    "replaced_points": replaced_points,
    "validation_summary": validation_summary,
    "experiment_results": experiment_results,
    "reloaded_index": reloaded_index,
    "find_user": find_user,
    "append_reports": append_reports,
    "state_tables": state_tables,
    "ingest_stages": ingest_stages,
    "mode_latency": mode_latency,
    "attach_given_patient": attach_given_patient,
}

_TOLD = ("extract", "extracted", "sections", "sectioned", "chunks", "chunked", "start", "index", "done")
_STAGES = ", ".join(f"({n}, '{stage}', {dict(K.STAGE_PERCENT)[stage]}::DOUBLE)" for n, stage in enumerate(_TOLD))

ORACLE = {
    "json_arrays": "SELECT doc_id, text, lang FROM documents",
    "replaced_points": """
SELECT 'label_' || label AS label, count(*) AS points, CAST(max(len(embedding)) AS INTEGER) AS dimensions
FROM embeddings GROUP BY label""",
    "validation_summary": validation.ORACLE["validation_report"],
    "experiment_results": evaluation.ORACLE["k_sweep"],
    "reloaded_index": retrieval.ORACLE["retrieve_bm25"],
    "find_user": """
SELECT c_custkey::VARCHAR AS id, c_name AS name, lower(c_name || '@x.org') AS email, c_custkey AS created_at
FROM customer WHERE c_custkey IN (SELECT min(c_custkey) FROM customer UNION ALL SELECT max(c_custkey) FROM customer)""",
    "append_reports": """
SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS user_id, event_type AS filename, props AS vitals_json, true AS dated
FROM events""",
    "state_tables": """
SELECT 'users' AS name, count(*) AS n, count(DISTINCT lower(c_name)) AS keys FROM customer
UNION ALL SELECT 'user_chats', count(*), count(DISTINCT event_id) FROM events
UNION ALL SELECT 'patient_reports', count(*), count(DISTINCT event_id) FROM events""",
    "ingest_stages": f"""
SELECT CAST(n AS INTEGER) AS n, stage, percent, (SELECT count(*) FROM ({chunk_queries.ORACLE['build_document_chunks']})) AS stored
FROM (VALUES {_STAGES}) t(n, stage, percent)""",
    "mode_latency": f"""
SELECT 'dense' AS mode, count(*) AS hits, true AS measured FROM ({retrieval.ORACLE['retrieve_dense']})
UNION ALL SELECT 'sparse', count(*), true FROM ({retrieval.ORACLE['retrieve_bm25']})""",
    "attach_given_patient": """
WITH r AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id),
q AS (SELECT item_id, CASE WHEN item_id % 3 <> 0 THEN item_id END AS u FROM benchmark)
SELECT item_id AS query_id, u::VARCHAR AS user_id,
  CASE WHEN item_id % 4 = 0 THEN -item_id WHEN last IS NOT NULL THEN last WHEN u IS NULL THEN item_id + 1000000 END AS value,
  CASE WHEN item_id % 4 <> 0 AND last IS NOT NULL THEN 'stored' END AS summary
FROM q LEFT JOIN r ON user_id = u""",
}
