"""Search, fusion, target, context and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import context, dense, dense_index, fusion, lexical, postings, state, targets
from ..operators.clinical import parse_vitals
from ..plans.ask import ask as ask_plan
from ..plans.ask import leg_size
from ..session import new_run_dir, settle
from .tables import (
    QUESTIONS_SQL,
    corpus,
    questions,
    strip_sql,
    table,
    terms_sql,
    text_questions,
    vectors,
)

# -- sparse -------------------------------------------------------------------


def bm25_idf(spark, d):
    index = lexical.build_index(corpus(spark, d), "index_text")
    return index.idf().select("term", "df", F.round("idf", 6).alias("idf"))


_INDEX = f"""
doc AS (SELECT doc_id, source, lang, {terms_sql("lang || ' ' || text")} AS t FROM documents),
stat AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM doc),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM doc) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, stat),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN {K.BM25_EPSILON} * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)
"""
_SPARSE = f"""
{_INDEX},
ask AS (SELECT item_id AS query_id, term, count(*) AS times FROM (
  SELECT item_id, unnest({terms_sql('text')}) AS term FROM benchmark) GROUP BY 1, 2),
hit AS (SELECT query_id, post.doc_id,
    sum(times * idf * tf * {K.BM25_K1 + 1} / (tf + {K.BM25_K1} * ({1 - K.BM25_B} + {K.BM25_B} * len(t) / avgdl))) AS s
  FROM ask JOIN post USING (term) JOIN idf USING (term) JOIN doc ON doc.doc_id = post.doc_id, stat
  GROUP BY 1, 2),
every AS (SELECT q.query_id, doc.doc_id AS chunk_id, source, round(coalesce(s, 0.0), 6) + 0.0 AS bm25_score
  FROM (SELECT DISTINCT query_id FROM ask) q CROSS JOIN doc
  LEFT JOIN hit ON hit.query_id = q.query_id AND hit.doc_id = doc.doc_id),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS rank
  FROM every)
"""


def bm25_stored_index(spark, d):
    """An index is built and stored, loaded again, and searched without the texts."""
    path = new_run_dir(spark, "stored_bm25")
    lexical.build_index(corpus(spark, d), "index_text", path=path)
    index = lexical.Bm25Index.load(spark, path)
    return lexical.bm25_top_k(None, text_questions(spark, d), K.TOP_K, index=index)


def bm25_postings(spark, d):
    """A posting index is stored, opened and searched block by block."""
    path = new_run_dir(spark, "postings")
    postings.add(corpus(spark, d), path, "index_text")
    index = postings.PostingIndex.open(spark, path)
    return lexical.bm25_top_k(None, text_questions(spark, d), K.TOP_K, index=index)


def bm25_segments(spark, d):
    """An index that grew: every document came first with its language as text,
    together with strangers, then with half of its text, then as it is, in
    three batches; the strangers are taken out again and segments merged."""
    path = new_run_dir(spark, "segments")
    docs = corpus(spark, d).select("chunk_id", "index_text", "section_title")
    early = docs.select("chunk_id", F.col("section_title").alias("index_text"))
    strangers = docs.select((-1 - F.col("chunk_id")).alias("chunk_id"), F.reverse("index_text").alias("index_text"))
    postings.add(early.union(strangers), path, "index_text")
    half = F.col("index_text").substr(F.lit(1), F.floor(F.length("index_text") / 2).cast("int"))
    postings.add(docs.select("chunk_id", half.alias("index_text")), path, "index_text")
    for n in range(3):
        batch = docs.where(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == n)
        postings.add(batch.select("chunk_id", "index_text"), path, "index_text")
    postings.remove(strangers, path)
    postings.merge(spark, path)
    index = postings.PostingIndex.open(spark, path)
    return lexical.bm25_top_k(None, text_questions(spark, d), K.TOP_K, index=index)


def retrieve_bm25(spark, d):
    return lexical.bm25_top_k(
        corpus(spark, d), text_questions(spark, d), K.TOP_K, text="index_text"
    )


# -- targets ------------------------------------------------------------------


def _registry(spark, d):
    """One registry row per source, in order of its first document."""
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(
        F.min("doc_id").alias("ord"), F.min("lang").alias("lang")
    ).select(
        "ord",
        F.col("source").alias("document_id"),
        F.concat(F.lit("Collection of "), F.col("source")).alias("document_name"),
        F.concat(F.lit("Org "), F.col("lang"), F.lit(".)")).alias("organization"),
        F.concat(F.lit("data\\raw\\"), F.col("source"), F.lit(".pdf")).alias("local_file"),
    )


def _targeted(spark, d, asked):
    """Each question targets the source of the document with its number."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("source").alias("doc_filter")
    )
    wanted = asked.join(docs, "query_id", "left")
    return targets.target_keys(wanted, targets.resolve_targets(wanted, _registry(spark, d)))


def _target_rows(spark, d):
    """Target texts in several shapes: file names, mentions, parts, strangers."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    shapes = F.array(
        F.concat(F.lit("@"), F.upper("source"), F.lit(".pdf")),
        F.concat(F.lit("the "), F.col("source"), F.lit(" set")),
        F.replace("source", F.lit("src"), F.lit("rc")),
        F.concat(F.lit(" Collection of "), F.col("source"), F.lit(" ")),
        F.concat(F.lit("org "), F.col("lang")),
        F.concat(F.lit("unknown "), F.col("doc_id").cast("string")),
        F.lit("@"),
    )
    return docs.select("doc_id", F.posexplode(shapes).alias("shape", "doc_filter")).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("shape").cast("string")).alias(
            "query_id"
        ),
        "doc_filter",
    )


def resolve_targets(spark, d):
    return targets.resolve_targets(_target_rows(spark, d), _registry(spark, d))


def retrieve_bm25_filtered(spark, d):
    chunks = corpus(spark, d)
    asked = _targeted(spark, d, text_questions(spark, d))
    wide = lexical.bm25_top_k(chunks, asked, targets.overfetch(K.TOP_K), text="index_text")
    return targets.keep_target_hits(wide, asked, chunks, K.TOP_K).select(
        "query_id", "chunk_id", "bm25_score", "rank"
    )


def retrieve_bm25_prefiltered(spark, d):
    asked = _targeted(spark, d, text_questions(spark, d))
    return lexical.bm25_top_k_prefiltered(corpus(spark, d), asked, K.TOP_K, text="index_text")


# -- dense --------------------------------------------------------------------


def retrieve_dense(spark, d):
    return dense.dense_top_k(vectors(spark, d), questions(spark, d))


def dense_stored_index(spark, d):
    """An index of cells and shells is stored, loaded again and searched."""
    path = new_run_dir(spark, "dense_index")
    dense_index.build_index(vectors(spark, d), path)
    index = dense_index.DenseIndex.load(spark, path)
    return dense.dense_top_k(None, questions(spark, d), index=index)


def _located(spark, d):
    """Vectors with the document fields of the same number."""
    docs = corpus(spark, d).select("chunk_id", "document_id", "pdf_file")
    return vectors(spark, d).join(docs, "chunk_id", "left")


def retrieve_dense_postfilter(spark, d):
    chunks = _located(spark, d)
    asked = _targeted(spark, d, questions(spark, d))
    wide = dense.dense_top_k(chunks, asked, targets.overfetch(K.TOP_K))
    return targets.keep_target_hits(wide, asked, chunks, K.TOP_K).select(
        "query_id", "chunk_id", "dense_score", "rank"
    )


def retrieve_dense_prefilter(spark, d):
    asked = _targeted(spark, d, questions(spark, d))
    return dense.dense_top_k_prefiltered(_located(spark, d), asked)


DENSE_SQL = f"""
q AS ({QUESTIONS_SQL}),
sims AS (SELECT query_id, vec_id AS chunk_id, label,
    round(list_cosine_similarity(vector, embedding::DOUBLE[]), 6) + 0.0 AS dense_score
  FROM q CROSS JOIN embeddings),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS rank
  FROM sims)
"""
SPARSE_SQL = _SPARSE

# -- fusion -------------------------------------------------------------------


def _legs(spark, d):
    n = leg_size(K.TOP_K)
    left = dense.dense_top_k(vectors(spark, d), questions(spark, d), n)
    right = lexical.bm25_top_k(
        corpus(spark, d), text_questions(spark, d), n, text="index_text"
    )
    return left, right


_FUSED = ["query_id", "chunk_id", "rank", "fusion_score", "dense_rank", "sparse_rank"]


def fuse_rrf(spark, d):
    return fusion.reciprocal_rank_fusion(*_legs(spark, d)).select(*_FUSED)


def fuse_relative(spark, d):
    return fusion.relative_score_fusion(*_legs(spark, d)).select(*_FUSED)


LEGS_SQL = f"""
{DENSE_SQL}, {_SPARSE},
l AS (SELECT query_id, chunk_id, rank AS dense_rank, dense_score FROM dense WHERE rank <= 10),
r AS (SELECT query_id, chunk_id, rank AS sparse_rank, bm25_score FROM sparse WHERE rank <= 10),
pair AS (SELECT coalesce(l.query_id, r.query_id) AS query_id, coalesce(l.chunk_id, r.chunk_id) AS chunk_id,
    dense_rank, sparse_rank, dense_score, bm25_score
  FROM l FULL JOIN r ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id),
rrf AS (SELECT *, coalesce(0.5::DOUBLE / (60 + dense_rank), 0.0) + coalesce(0.5::DOUBLE / (60 + sparse_rank), 0.0) AS s
  FROM pair),
rrfr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, dense_rank NULLS LAST,
    sparse_rank) AS rank FROM rrf),
scaled AS (SELECT *,
    CASE WHEN dense_score IS NULL THEN 0.0 WHEN max(dense_score) OVER w = min(dense_score) OVER w THEN 1.0
      ELSE (dense_score - min(dense_score) OVER w) / (max(dense_score) OVER w - min(dense_score) OVER w) END AS d,
    CASE WHEN bm25_score IS NULL THEN 0.0 WHEN max(bm25_score) OVER w = min(bm25_score) OVER w THEN 1.0
      ELSE (bm25_score - min(bm25_score) OVER w) / (max(bm25_score) OVER w - min(bm25_score) OVER w) END AS b
  FROM pair WINDOW w AS (PARTITION BY query_id)),
rsf AS (SELECT *, 0.6::DOUBLE * d + 0.4::DOUBLE * b AS s FROM scaled),
rsfr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM rsf)
"""

# -- mentions, enrichment, context, history, prompt ---------------------------


def extract_mentions(spark, d):
    """Conversation turns that mention a role, with and without more text."""
    turns = table(spark, d, "conversations")
    shapes = F.array(
        F.concat(F.lit('@"'), F.col("role"), F.lit(' 2024" '), F.col("text"), F.lit(" @x.y-z")),
        F.concat(F.col("text"), F.lit(" @"), F.col("role")),
        F.concat(F.lit("@"), F.col("role")),
        F.col("text"),
    )
    asked = turns.select("conv_id", "turn", F.posexplode(shapes).alias("shape", "query"))
    return targets.extract_mentions(asked)


def enrich_query(spark, d):
    """Turns enriched with the vitals of their own number from event values."""
    q = text_questions(spark, d)
    events = table(spark, d, "events").groupBy("user_id").agg(
        F.max("event_type").alias("bp_category"),
        F.array_sort(F.collect_set("event_type")).alias("comorbidities"),
    )
    joined = q.join(events, q.query_id == events.user_id, "left")
    return context.enrich_query(joined).select("query_id", "dense_query")


def _sources(spark, d):
    hits = retrieve_bm25(spark, d).withColumnRenamed("bm25_score", "score")
    chunks = corpus(spark, d).select(
        "chunk_id",
        "document_id",
        "section_title",
        F.length("text").alias("page_start"),
        F.size(F.split("text", "\n", -1)).alias("page_end"),
        "text",
    )
    return context.format_sources(context.attach_chunks(settle(hits, "hits"), chunks))


def format_sources(spark, d):
    return _sources(spark, d).drop("text")


def build_context(spark, d):
    return context.build_context(text_questions(spark, d), _sources(spark, d))


_SOURCES = f"""
{_SPARSE},
src AS (SELECT query_id, rank, chunk_id, d.source AS document_id,
    upper(d.source[1]) || d.source[2:] AS document_name, d.source || '.pdf' AS pdf_file,
    d.lang AS section_title, CAST(len(d.text) AS INTEGER) AS page_start,
    CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS page_end, round(bm25_score, 4) AS score, d.text AS text
  FROM sparse JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 5),
ctx AS (SELECT query_id, string_agg(concat('[', rank, '] Document: ', document_name, ', Section: ',
      section_title, ' | ', CASE WHEN page_start = page_end THEN concat('Page ', page_start)
      ELSE concat('Pages ', page_start, '-', page_end) END, chr(10), text),
      chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n
  FROM src GROUP BY query_id)
"""


def history_window(spark, d):
    return context.history_window(
        context.conversation_pairs(table(spark, d, "conversations"))
    )


_HISTORY = """
pairs AS (SELECT u.conv_id, u.turn, concat('User: ', u.text, chr(10), 'Assistant: ', a.text) AS block
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
recent AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM pairs),
hist AS (SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY turn) AS history, count(*) AS n_turns
  FROM recent WHERE back <= 6 GROUP BY conv_id)
"""


def assemble_prompt(spark, d):
    """Prompt of every question: context, history of the conversation of its
    number and a note on the source it targets."""
    asked = text_questions(spark, d)
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "source", "lang")
    past = history_window(spark, d).select(F.col("conv_id").alias("query_id"), "history")
    rows = (
        build_context(spark, d)
        .join(asked, "query_id")
        .join(wanted, "query_id", "left")
        .join(past, "query_id", "left")
    )
    target = context.target_note(F.col("source"), F.upper("source"), F.col("lang"))
    return rows.select(
        "query_id",
        context.build_prompt(
            F.col("context"), F.col("query"), F.lit(""), F.col("history"), target
        ).alias("prompt"),
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HEAD, _REST = K.TARGET_NOTE.split("{name}")
_MIDDLE, _TAIL = _REST.split("{organization}")


def patient_note(spark, d):
    """Notes from vitals that were extracted as JSON text, one per user."""
    answered = table(spark, d, "events").groupBy("user_id").agg(
        F.max("event_id").cast("int").alias("systolic"),
        F.max_by(F.when(F.col("event_type") != "view", F.col("event_type")), "event_id").alias("kind"),
        F.array_sort(F.collect_set("event_type")).alias("kinds"),
    )
    record = F.struct(
        "systolic",
        F.col("kind").alias("bp_category"),
        F.when(F.col("kind") == "click", F.array().cast("array<string>")).otherwise(
            F.col("kinds")
        ).alias("medications"),
    )
    reports = answered.select(
        F.col("user_id").cast("string").alias("document_id"),
        F.lit("").alias("text"),
        F.to_json(record).alias("json"),
    )
    vitals = parse_vitals(reports)
    return vitals.select(
        "document_id", context.patient_note(F.col("vitals"), F.col("summary")).alias("note")
    )


def attach_patient(spark, d):
    """Every conversation asks for the user of its number; the user's newest
    event is the stored report."""
    reports = state.latest_reports(
        table(spark, d, "events").select(
            F.col("event_id").cast("string").alias("id"),
            F.col("user_id").cast("string").alias("user_id"),
            F.col("event_type").alias("filename"),
            F.col("props").alias("vitals_json"),
            F.col("event_type").alias("summary_text"),
            F.col("event_id").alias("uploaded_at"),
        ),
        "k int",
    )
    asked = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns")
    ).select(F.col("conv_id").cast("string").alias("user_id"), "turns")
    return state.attach_patient(asked, reports).select(
        "user_id", "turns", F.col("vitals.k").alias("k"), "summary"
    )


def ask(spark, d):
    """The whole question plan in hybrid mode with targets, context and prompt.

    All documents are searched by their terms, those with a vector by it as well.
    """
    wanted = table(spark, d, "documents").select(
        F.col("doc_id").alias("query_id"), F.col("source").alias("doc_filter")
    )
    q = questions(spark, d).join(wanted, "query_id", "left")
    docs = corpus(spark, d).select("chunk_id", "document_id", "pdf_file", "section_title", "text")
    chunks = docs.join(vectors(spark, d), "chunk_id", "left").select(
        F.col("chunk_id").cast("string").alias("chunk_id"),
        "document_id",
        "pdf_file",
        "section_id",
        "section_title",
        F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"),
        "text",
        "embedding",
    )
    out = ask_plan(q, chunks, _registry(spark, d), history=None)
    return out.select(
        "query_id",
        "doc_filter",
        F.array_join(F.transform("sources", lambda s: s["chunk_id"]), ",").alias("chunk_ids"),
        "prompt",
    )


QUERIES = {
    "bm25_idf": bm25_idf,
    "retrieve_bm25": retrieve_bm25,
    "bm25_stored_index": bm25_stored_index,
    "bm25_postings": bm25_postings,
    "bm25_segments": bm25_segments,
    "retrieve_bm25_filtered": retrieve_bm25_filtered,
    "retrieve_bm25_prefiltered": retrieve_bm25_prefiltered,
    "retrieve_dense": retrieve_dense,
    "dense_stored_index": dense_stored_index,
    "retrieve_dense_postfilter": retrieve_dense_postfilter,
    "retrieve_dense_prefilter": retrieve_dense_prefilter,
    "fuse_rrf": fuse_rrf,
    "fuse_relative": fuse_relative,
    "resolve_targets": resolve_targets,
    "extract_mentions": extract_mentions,
    "enrich_query": enrich_query,
    "format_sources": format_sources,
    "build_context": build_context,
    "history_window": history_window,
    "assemble_prompt": assemble_prompt,
    "patient_note": patient_note,
    "attach_patient": attach_patient,
    "ask": ask,
}

_WANTED = "w AS (SELECT doc_id AS query_id, source AS wanted FROM documents)"
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, chunk_id) AS INTEGER) AS rank"

ORACLE = {
    "bm25_idf": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "retrieve_bm25": f"""
WITH {_SPARSE} SELECT query_id, chunk_id, bm25_score, CAST(rank AS INTEGER) AS rank
FROM sparse WHERE rank <= 5""",
    "retrieve_bm25_filtered": f"""
WITH {_SPARSE}, {_WANTED},
f AS (SELECT s.query_id, chunk_id, bm25_score, {_RANK.format('bm25_score')}
  FROM sparse s LEFT JOIN w USING (query_id)
  WHERE s.rank <= 40 AND (wanted IS NULL OR contains(source, wanted)))
SELECT * FROM f WHERE rank <= 5""",
    "retrieve_bm25_prefiltered": f"""
WITH {_SPARSE}, {_WANTED},
f AS (SELECT s.query_id, chunk_id, bm25_score, {_RANK.format('bm25_score')}
  FROM sparse s LEFT JOIN w USING (query_id) WHERE wanted IS NULL OR contains(source, wanted))
SELECT * FROM f WHERE rank <= 5""",
    "retrieve_dense": f"""
WITH {DENSE_SQL} SELECT query_id, chunk_id, dense_score, CAST(rank AS INTEGER) AS rank
FROM dense WHERE rank <= 5""",
    "retrieve_dense_postfilter": f"""
WITH {DENSE_SQL}, {_WANTED},
f AS (SELECT s.query_id, chunk_id, dense_score, {_RANK.format('dense_score')}
  FROM dense s LEFT JOIN w USING (query_id) LEFT JOIN documents d ON d.doc_id = chunk_id
  WHERE s.rank <= 40 AND (wanted IS NULL OR contains(coalesce(d.source, ''), wanted)))
SELECT * FROM f WHERE rank <= 5""",
    "retrieve_dense_prefilter": f"""
WITH {DENSE_SQL}, {_WANTED},
f AS (SELECT s.query_id, chunk_id, dense_score, {_RANK.format('dense_score')}
  FROM dense s LEFT JOIN w USING (query_id) LEFT JOIN documents d ON d.doc_id = chunk_id
  WHERE wanted IS NULL OR contains(coalesce(d.source, ''), wanted))
SELECT * FROM f WHERE rank <= 5""",
    "fuse_rrf": f"""
WITH {LEGS_SQL} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(s, 5) AS fusion_score,
  CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank
FROM rrfr WHERE rank <= 5""",
    "fuse_relative": f"""
WITH {LEGS_SQL} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(s, 5) AS fusion_score,
  CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank
FROM rsfr WHERE rank <= 5""",
    "resolve_targets": f"""
WITH reg AS (SELECT min(doc_id) AS ord, source AS document_id, 'Collection of ' || source AS document_name,
    'Org ' || min(lang) || '.)' AS organization, 'data\\raw\\' || source || '.pdf' AS local_file,
    lower(source) AS id, lower(source) AS file, 'org ' || min(lang) AS org,
    lower('Collection of ' || source) AS name FROM documents GROUP BY source),
t AS (SELECT doc_id || '/' || shape AS query_id, doc_filter,
    replace(replace(lower(trim(doc_filter)), '.pdf', ''), '@', '') AS flt FROM (
  SELECT doc_id, 0 AS shape, '@' || upper(source) || '.pdf' AS doc_filter FROM documents
  UNION ALL SELECT doc_id, 1, 'the ' || source || ' set' FROM documents
  UNION ALL SELECT doc_id, 2, replace(source, 'src', 'rc') FROM documents
  UNION ALL SELECT doc_id, 3, ' Collection of ' || source || ' ' FROM documents
  UNION ALL SELECT doc_id, 4, 'org ' || lang FROM documents
  UNION ALL SELECT doc_id, 5, 'unknown ' || doc_id FROM documents
  UNION ALL SELECT doc_id, 6, '@' FROM documents)),
f AS (SELECT DISTINCT flt FROM t WHERE flt <> ''),
e AS (SELECT flt, min(ord) AS o FROM f JOIN reg ON flt IN (id, file, org, name) GROUP BY flt),
p AS (SELECT flt, min(ord) AS o FROM f JOIN reg ON contains(org, flt) OR contains(flt, org)
    OR contains(id, flt) OR contains(flt, id) OR contains(file, flt) OR contains(flt, file) GROUP BY flt),
c AS (SELECT f.flt, coalesce(e.o, p.o) AS o FROM f LEFT JOIN e USING (flt) LEFT JOIN p USING (flt))
SELECT t.query_id, t.doc_filter,
  CASE WHEN c.flt IS NOT NULL AND reg.ord IS NULL THEN c.flt ELSE reg.document_id END AS document_id,
  CASE WHEN c.flt IS NOT NULL AND reg.ord IS NULL THEN c.flt ELSE reg.document_name END AS document_name,
  CASE WHEN c.flt IS NOT NULL AND reg.ord IS NULL THEN '' ELSE reg.organization END AS organization,
  CASE WHEN c.flt IS NOT NULL AND reg.ord IS NULL THEN c.flt || '.pdf' ELSE reg.local_file END AS local_file
FROM t LEFT JOIN c ON t.flt = c.flt LEFT JOIN reg ON reg.ord = c.o""",
    "extract_mentions": rf"""
WITH s AS (
  SELECT conv_id, turn, 0 AS shape, concat('@"', role, ' 2024" ', text, ' @x.y-z') AS query FROM conversations
  UNION ALL SELECT conv_id, turn, 1, concat(text, ' @', role) FROM conversations
  UNION ALL SELECT conv_id, turn, 2, concat('@', role) FROM conversations
  UNION ALL SELECT conv_id, turn, 3, text FROM conversations),
m AS (SELECT *, nullif(coalesce(nullif(regexp_extract(query, '@(?:"([^"]+)"|([\p{{L}}\p{{N}}_.\-]+))', 1), ''),
    regexp_extract(query, '@(?:"([^"]+)"|([\p{{L}}\p{{N}}_.\-]+))', 2)), '') AS doc_filter,
  {strip_sql("""regexp_replace(query, '@(?:"([^"]+)"|([\\p{L}\\p{N}_.\\-]+))', '', 'g')""").replace(chr(92) * 2, chr(92))} AS rest FROM s)
SELECT conv_id, turn, CAST(shape AS INTEGER) AS shape,
  CASE WHEN doc_filter IS NOT NULL AND rest <> '' THEN rest ELSE query END AS query, doc_filter FROM m""",
    "enrich_query": f"""
WITH v AS (SELECT user_id, max(event_type) AS cat, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS more
  FROM events GROUP BY user_id)
SELECT item_id AS query_id, CASE WHEN cat IS NULL THEN text
  ELSE {strip_sql("concat(text, ' ', cat, ' ', more)")} END AS dense_query
FROM benchmark LEFT JOIN v ON user_id = item_id""",
    "format_sources": f"""
WITH {_SOURCES} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, document_id, document_name,
  pdf_file, section_title, page_start, page_end, score FROM src""",
    "build_context": f"""
WITH {_SOURCES} SELECT item_id AS query_id, coalesce(context, {_sql_text(K.EMPTY_CONTEXT)}) AS context,
  coalesce(n, 0) AS n_sources FROM benchmark LEFT JOIN ctx ON query_id = item_id""",
    "history_window": f"WITH {_HISTORY} SELECT conv_id, history, n_turns FROM hist",
    "assemble_prompt": f"""
WITH {_SOURCES}, {_HISTORY}
SELECT item_id AS query_id, concat('CONTEXT:', chr(10), coalesce(context, {_sql_text(K.EMPTY_CONTEXT)}),
  chr(10), chr(10), CASE WHEN history IS NULL THEN '' ELSE concat(history, chr(10), chr(10)) END,
  CASE WHEN d.source IS NULL THEN '' ELSE concat({_sql_text(_HEAD)}, upper(d.source), {_sql_text(_MIDDLE)},
    d.lang, {_sql_text(_TAIL)}) END,
  'QUESTION: ', b.text, chr(10), chr(10), 'ANSWER:') AS prompt
FROM benchmark b LEFT JOIN ctx ON query_id = item_id LEFT JOIN hist ON conv_id = item_id
  LEFT JOIN documents d ON d.doc_id = item_id""",
    "patient_note": f"""
WITH e AS (SELECT user_id, max(event_id) AS systolic, max(event_id) AS m,
    string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS kinds FROM events GROUP BY user_id),
k AS (SELECT e.*, CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM e JOIN events x
    ON x.event_id = e.m)
SELECT user_id::VARCHAR AS document_id, concat({_sql_text(K.PATIENT_HEAD)}, '- Blood Pressure: ', systolic,
  '/Unknown mmHg (', coalesce(kind, 'Hypertension'), ')', chr(10),
  '- Comorbidities / Risk Factors: None specified', chr(10), '- Current Medications: ',
  CASE WHEN kind = 'click' THEN 'None reported' ELSE kinds END, chr(10), '- Report Summary: ',
  {_sql_text(K.DEFAULT_REPORT_SUMMARY)}, chr(10), chr(10), {_sql_text(K.PATIENT_TAIL)}) AS note FROM k""",
    "ask": f"""
WITH q AS ({QUESTIONS_SQL}), w AS (SELECT doc_id AS query_id, source AS wanted FROM documents),
doc AS (SELECT doc_id, source, lang, text, embedding, {terms_sql("lang || ' ' || text")} AS t,
    doc_id::VARCHAR AS chunk_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
stat AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM doc),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM doc) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, stat),
idf AS (SELECT term, CASE WHEN r < 0 THEN {K.BM25_EPSILON} * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asks AS (SELECT query_id, term, count(*) AS times FROM (
  SELECT query_id, unnest({terms_sql('query')}) AS term FROM q) GROUP BY 1, 2),
hit AS (SELECT query_id, post.doc_id,
    sum(times * idf * tf * {K.BM25_K1 + 1} / (tf + {K.BM25_K1} * ({1 - K.BM25_B} + {K.BM25_B} * len(t) / avgdl))) AS s
  FROM asks JOIN post USING (term) JOIN idf USING (term) JOIN doc ON doc.doc_id = post.doc_id, stat GROUP BY 1, 2),
both_ AS (SELECT q.query_id, doc.chunk_id, source, round(coalesce(s, 0.0), 6) + 0.0 AS b,
    round(list_cosine_similarity(vector, embedding::DOUBLE[]), 6) + 0.0 AS c
  FROM q CROSS JOIN doc LEFT JOIN hit ON hit.query_id = q.query_id AND hit.doc_id = doc.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC NULLS LAST, chunk_id) AS cr,
    row_number() OVER (PARTITION BY query_id ORDER BY b DESC, chunk_id) AS br FROM both_),
l AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY cr) AS dr
  FROM ranked LEFT JOIN w USING (query_id) WHERE c IS NOT NULL AND cr <= 60 AND (wanted IS NULL OR contains(source, wanted))),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY br) AS sr
  FROM ranked LEFT JOIN w USING (query_id) WHERE br <= 60 AND (wanted IS NULL OR contains(source, wanted))),
pair AS (SELECT coalesce(l.query_id, r.query_id) AS query_id, coalesce(l.chunk_id, r.chunk_id) AS chunk_id, dr, sr
  FROM (SELECT * FROM l WHERE dr <= 10) l FULL JOIN (SELECT * FROM r WHERE sr <= 10) r
  ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
    coalesce(0.5::DOUBLE / (60 + dr), 0.0) + coalesce(0.5::DOUBLE / (60 + sr), 0.0) DESC, dr NULLS LAST, sr) AS rank
  FROM pair),
ctx AS (SELECT query_id, string_agg(chunk_id, ',' ORDER BY rank) AS chunk_ids,
    string_agg(concat('[', rank, '] Document: ', upper(source[1]) || source[2:], ', Section: ', lang,
      ' | Page 1', chr(10), text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM fused JOIN doc USING (chunk_id) WHERE rank <= 5 GROUP BY query_id),
orgs AS (SELECT source, min(lang) AS lang FROM documents GROUP BY source)
SELECT q.query_id, wanted AS doc_filter, chunk_ids,
  concat('CONTEXT:', chr(10), coalesce(context, {_sql_text(K.EMPTY_CONTEXT)}), chr(10), chr(10),
  CASE WHEN wanted IS NULL THEN '' ELSE concat({_sql_text(_HEAD)}, 'Collection of ', wanted,
    {_sql_text(_MIDDLE)}, 'Org ', orgs.lang, '.)', {_sql_text(_TAIL)}) END,
  'QUESTION: ', query, chr(10), chr(10), 'ANSWER:') AS prompt
FROM q LEFT JOIN w USING (query_id) LEFT JOIN ctx USING (query_id) LEFT JOIN orgs ON orgs.source = wanted""",
    "attach_patient": """
WITH n AS (SELECT user_id, max(event_id) AS m FROM events GROUP BY user_id),
r AS (SELECT e.user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type FROM events e
  JOIN n ON e.event_id = m),
c AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS user_id, turns, k, event_type AS summary
FROM c LEFT JOIN r ON r.user_id = c.conv_id""",
}
for _name in ("bm25_stored_index", "bm25_postings", "bm25_segments"):
    ORACLE[_name] = ORACLE["retrieve_bm25"]
ORACLE["dense_stored_index"] = ORACLE["retrieve_dense"]
