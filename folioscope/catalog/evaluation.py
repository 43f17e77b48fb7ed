"""Experiment queries."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.tokens import word_count
from ..functions.vectors import unit
from ..operators import dense, evaluation, lexical
from ..plans import evaluate
from ..plans.ask import MODES, retrieve
from ..session import settle
from .retrieval import DENSE_SQL, LEGS_SQL
from .tables import corpus, questions, table, terms_sql, text_questions, truth, vectors

DIGITS = 6


def metrics_at_k(spark, d):
    """Per-query metrics of the dense ranking."""
    hits = dense.dense_top_k(vectors(spark, d), questions(spark, d)).join(
        vectors(spark, d).select("chunk_id", "section_id"), "chunk_id"
    )
    out = evaluation.query_metrics(hits, truth(spark, d))
    return out.select(
        "query_id", "k", "hit",
        F.round("precision", DIGITS).alias("precision"),
        F.round("recall", DIGITS).alias("recall"),
        F.round("rr", DIGITS).alias("rr"),
    )


_TRUTH = """
small AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
truth AS (SELECT b.item_id AS query_id, e.label AS want, s.ids, len(s.ids) AS n_expected FROM benchmark b
  JOIN embeddings e ON e.vec_id = b.item_id
  JOIN (SELECT label, list(vec_id) AS ids FROM small WHERE r <= 3 GROUP BY label) s ON s.label = e.label)
"""


def _metrics_sql(ranked: str, ks: tuple, groups: str) -> str:
    """Per-query metrics; ``ranked`` is <groups>, query_id, chunk_id, rank."""
    ks_list = ", ".join(str(k) for k in ks)
    g = f"{groups}, " if groups else ""
    base = (
        f"(SELECT {groups}, query_id, want, ids, n_expected FROM "
        f"(SELECT DISTINCT {groups} FROM ranked) CROSS JOIN truth)"
        if groups
        else "truth"
    )
    on = " AND ".join(f"j.{c} = b.{c}" for c in (*(groups.split(", ") if groups else ()), "query_id"))
    return f"""
ranked AS ({ranked}),
judged AS (SELECT ranked.*, (list_contains(ids, chunk_id) OR coalesce(label = want, false)) AS rel
  FROM ranked JOIN truth USING (query_id) LEFT JOIN embeddings ON vec_id = chunk_id),
per AS (SELECT {', '.join('b.' + c for c in groups.split(', ')) + ', ' if groups else ''}b.query_id, k,
    count(*) FILTER (WHERE rel AND rank <= k) AS m, min(rank) FILTER (WHERE rel AND rank <= {max(ks)}) AS f,
    any_value(n_expected) AS n_expected
  FROM {base} b CROSS JOIN (SELECT unnest([{ks_list}]) AS k) LEFT JOIN judged j ON {on}
  GROUP BY ALL),
met AS (SELECT {g}query_id, k, CASE WHEN m > 0 THEN 1 ELSE 0 END AS hit, m / k AS precision,
    least(1.0, m / greatest(1, n_expected)) AS recall, coalesce(1.0 / f, 0.0) AS rr FROM per)
"""


def mode_comparison(spark, d):
    """Dense, sparse and both fusions: the four-mode experiment."""
    chunks = corpus(spark, d)
    v = vectors(spark, d)
    joined = questions(spark, d)
    hits = evaluate.rank_modes(v, chunks, joined)
    return evaluate.compare_modes(hits, v, truth(spark, d), digits=DIGITS)


def retrieve_modes(spark, d):
    """Every retrieval mode behind one call: dense, sparse and both fusions.

    All documents are in the chunk table, those without a vector as well.
    """
    columns = vectors(spark, d).drop("section_id")
    chunks = settle(corpus(spark, d).join(columns, "chunk_id", "left"), "chunks")
    asked = settle(questions(spark, d), "questions")
    index = lexical.build_index(chunks, "index_text")
    found = [
        retrieve(chunks, asked, mode, K.TOP_K, index=index).select(
            F.lit(MODE_NAMES[mode]).alias("mode"), "query_id", "chunk_id", F.col("rank").cast("int").alias("rank")
        )
        for mode in MODES
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), found)


MODE_NAMES = {
    "dense": "dense", "sparse": "sparse", "hybrid": "hybrid_rrf", "score_fusion": "hybrid_weighted",
}


def model_comparison(spark, d):
    """The stored vectors and their signs, at full length, as two models."""
    v, q = vectors(spark, d), questions(spark, d)

    def signs(column):
        return F.transform(column, lambda x: F.signum(x))

    models = {
        "full": (v, q),
        "signs": (v.withColumn("embedding", signs("embedding")), q.withColumn("vector", signs("vector"))),
    }
    return evaluate.compare_models(models, v, truth(spark, d), digits=DIGITS)


def k_sweep(spark, d):
    """Sweep over k; the size of a chunk is the word count of its document."""
    words = table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), word_count(F.col("text")).alias("token_count")
    )
    info = vectors(spark, d).select("chunk_id", "section_id").join(words, "chunk_id", "left")
    return evaluate.tune_k(
        vectors(spark, d), questions(spark, d), info, truth(spark, d), digits=DIGITS
    )


def chunk_ablation(spark, d):
    """Three chunk sizes, sparse search, relevance by section (the source)."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    chunks = evaluate.chunk_configs(docs, ("doc_id", "source")).select(
        "config_id", "name", "target_tokens", "overlap_tokens", "token_count", "text",
        F.format_string("%08d_%05d", F.col("doc_id"), F.col("chunk_no")).alias("chunk_id"),
        F.col("source").alias("section_id"),
    )
    asked = text_questions(spark, d)
    wanted = asked.join(docs, asked.query_id == docs.doc_id, "left").select(
        "query_id",
        F.col("source").alias("expected_section_id"),
        F.array().cast("array<string>").alias("expected_chunk_ids"),
    )
    return evaluate.ablate_chunk_sizes(
        chunks, asked, wanted, lambda c, q, k: lexical.bm25_top_k(c, q, k), digits=DIGITS
    )


def query_detail(spark, d):
    hits = dense.dense_top_k(vectors(spark, d), questions(spark, d))
    return evaluation.query_detail(hits).select(
        "query_id",
        F.array_join(F.transform("top_retrieved", lambda x: x.cast("string")), ",").alias("top"),
    )


def unit_vectors(spark, d):
    """Vectors scaled to length one, summed up per vector."""
    u = unit(F.col("embedding"))
    total = F.aggregate(u, F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(total, 6).alias("total"))


def latency_summary(spark, d):
    """Mean latency per mode, events standing in for timed searches."""
    timings = table(spark, d, "events").select(
        F.col("event_type").alias("mode"), F.col("value").alias("latency_ms")
    )
    return evaluation.latency_summary(timings)


QUERIES = {
    "metrics_at_k": metrics_at_k,
    "mode_comparison": mode_comparison,
    "model_comparison": model_comparison,
    "retrieve_modes": retrieve_modes,
    "k_sweep": k_sweep,
    "chunk_ablation": chunk_ablation,
    "query_detail": query_detail,
    "unit_vectors": unit_vectors,
    "latency_summary": latency_summary,
}

_MEANS = (
    "round(avg(hit), 6) AS hit_rate, round(avg(precision), 6) AS precision, "
    "round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr"
)


def _ablation_sql() -> str:
    from ..operators.chunking import ChunkSize
    from .chunks import windows_sql

    parts = []
    for config_id, name, target, maximum, minimum, overlap in K.CHUNK_CONFIGS:
        body = windows_sql(
            "SELECT doc_id, text FROM documents", "doc_id",
            ChunkSize(target, maximum, minimum, overlap),
        )
        parts.append(
            f"SELECT '{config_id}' AS config_id, '{name}' AS name, {target} AS target_tokens, "
            f"{overlap} AS overlap_tokens, doc_id, chunk_no, text, token_count "
            f"FROM (WITH {body} SELECT * FROM made)"
        )
    return f"""
WITH ch AS ({' UNION ALL '.join(parts)}),
doc AS (SELECT ch.*, printf('%08d_%05d', doc_id, chunk_no) AS chunk_id, source AS section_id,
    {terms_sql('ch.text')} AS t FROM ch JOIN documents USING (doc_id)),
stat AS (SELECT config_id, count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM doc GROUP BY config_id),
post AS (SELECT config_id, chunk_id, term, count(*) AS tf FROM (
  SELECT config_id, chunk_id, unnest(t) AS term FROM doc) GROUP BY 1, 2, 3),
dfs AS (SELECT config_id, term, count(*) AS df FROM post GROUP BY 1, 2),
raw AS (SELECT config_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs JOIN stat USING (config_id)),
low AS (SELECT config_id, {K.BM25_EPSILON} * avg(r) AS floor_ FROM raw GROUP BY 1),
idf AS (SELECT config_id, term, CASE WHEN r < 0 THEN floor_ ELSE r END AS idf FROM raw JOIN low USING (config_id)),
ask AS (SELECT item_id AS query_id, term, count(*) AS times FROM (
  SELECT item_id, unnest({terms_sql('text')}) AS term FROM benchmark) GROUP BY 1, 2),
hit AS (SELECT p.config_id, query_id, p.chunk_id, sum(times * idf * tf * {K.BM25_K1 + 1} /
    (tf + {K.BM25_K1} * ({1 - K.BM25_B} + {K.BM25_B} * len(t) / avgdl))) AS s
  FROM ask JOIN post p USING (term) JOIN idf i ON i.config_id = p.config_id AND i.term = p.term
  JOIN doc ON doc.config_id = p.config_id AND doc.chunk_id = p.chunk_id
  JOIN stat ON stat.config_id = p.config_id GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY config_id, query_id ORDER BY round(s, 6) DESC, chunk_id) AS rank
  FROM hit),
per AS (SELECT c.config_id, b.item_id AS query_id, count(*) FILTER (WHERE doc.section_id = d.source) AS m
  FROM (SELECT DISTINCT config_id FROM ch) c CROSS JOIN benchmark b
  LEFT JOIN documents d ON d.doc_id = b.item_id
  LEFT JOIN top ON top.config_id = c.config_id AND top.query_id = b.item_id AND top.rank <= 5
  LEFT JOIN doc ON doc.config_id = top.config_id AND doc.chunk_id = top.chunk_id GROUP BY 1, 2),
sc AS (SELECT config_id, round(avg(CASE WHEN m > 0 THEN 1 ELSE 0 END), 6) AS hit_rate_at_5,
    round(avg(m / 5), 6) AS precision_at_5 FROM per GROUP BY 1)
SELECT config_id, name, CAST(target_tokens AS INTEGER) AS target_tokens,
  CAST(overlap_tokens AS INTEGER) AS overlap_tokens, count(*) AS total_chunks,
  CAST(min(token_count) AS INTEGER) AS min_tokens, CAST(max(token_count) AS INTEGER) AS max_tokens,
  CAST(sum(token_count) // count(*) AS INTEGER) AS avg_tokens,
  any_value(hit_rate_at_5) AS hit_rate_at_5, any_value(precision_at_5) AS precision_at_5
FROM ch JOIN sc USING (config_id) GROUP BY ALL"""


_SIGNS = """
hs AS (SELECT q.query_id, vec_id AS chunk_id, round(list_cosine_similarity(
    list_transform(vector, lambda x: sign(x)::DOUBLE), list_transform(embedding, lambda x: sign(x)::DOUBLE)), 6) AS s
  FROM q CROSS JOIN embeddings),
signs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM hs)
"""
_MODES = """
SELECT 'dense' AS mode, query_id, chunk_id, rank FROM dense WHERE rank <= 5
UNION ALL SELECT 'sparse', query_id, chunk_id, rank FROM sparse WHERE rank <= 5
UNION ALL SELECT 'hybrid_rrf', query_id, chunk_id, rank FROM rrfr WHERE rank <= 5
UNION ALL SELECT 'hybrid_weighted', query_id, chunk_id, rank FROM rsfr WHERE rank <= 5"""

ORACLE = {
    "metrics_at_k": f"""
WITH {DENSE_SQL}, {_TRUTH},
{_metrics_sql('SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 5', K.BENCHMARK_KS, '')}
SELECT query_id, CAST(k AS INTEGER) AS k, hit, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(rr, 6) AS rr FROM met""",
    "mode_comparison": f"""
WITH {LEGS_SQL}, {_TRUTH}, {_metrics_sql(_MODES, K.BENCHMARK_KS, 'mode')}
SELECT mode, CAST(k AS INTEGER) AS k, {_MEANS} FROM met GROUP BY mode, k""",
    "retrieve_modes": f"""
WITH {LEGS_SQL.replace('CROSS JOIN embeddings', 'CROSS JOIN embeddings SEMI JOIN documents ON doc_id = vec_id')}
SELECT mode, query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM ({_MODES})""",
    "model_comparison": f"""
WITH {DENSE_SQL}, {_SIGNS}, {_TRUTH}, {_metrics_sql(
    "SELECT 'full' AS model, query_id, chunk_id, rank FROM dense WHERE rank <= 5 "
    "UNION ALL SELECT 'signs', query_id, chunk_id, rank FROM signs WHERE rank <= 5", K.BENCHMARK_KS, 'model')}
SELECT model, CAST(k AS INTEGER) AS k, {_MEANS} FROM met GROUP BY model, k""",
    "k_sweep": f"""
WITH {DENSE_SQL}, {_TRUTH},
{_metrics_sql('SELECT query_id, chunk_id, rank FROM dense WHERE rank <= 10', K.SWEEP_KS, '')},
tk AS (SELECT k, sum(coalesce(len(regexp_extract_all(text, '\\S+')), 600)) // count(DISTINCT query_id) AS tokens
  FROM dense CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 8, 10]) AS k) LEFT JOIN documents ON doc_id = chunk_id
  WHERE rank <= k GROUP BY k),
mm AS (SELECT k, avg(hit) AS h, avg(precision) AS p FROM met GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, round(h, 6) AS hit_rate, round(p, 6) AS precision,
  CAST(tokens AS INTEGER) AS avg_context_tokens, round(h * 0.6::DOUBLE + p * 0.4::DOUBLE, 6) AS tradeoff_score
FROM mm JOIN tk USING (k)""",
    "chunk_ablation": _ablation_sql(),
    "query_detail": f"""
WITH {DENSE_SQL} SELECT query_id, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS top
FROM dense WHERE rank <= 3 GROUP BY query_id""",
    "unit_vectors": """
SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[],
  lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y))))), 6) AS total
FROM embeddings""",
    "latency_summary": """
SELECT event_type AS mode, round(avg(value), 2) AS avg_latency_ms FROM events GROUP BY event_type""",
}
