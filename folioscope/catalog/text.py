"""Cleaning and token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrays import each
from ..functions.tokens import search_terms, word_count
from ..operators import chunking, cleaning, headings
from ..sources.pages import conversation_pages
from .tables import (
    DOUBLED_SQL,
    RAW_HEADERS,
    RAW_PAGES_SQL,
    doubled_pages,
    raw_pages,
    strip_sql,
    table,
    terms_sql,
)

CUT_TITLES = ("OF.", "AS.", "ES.", "AND ORND.", "IETZTE.")
HEADER_DOCUMENTS = 5


def lines_split(spark, d):
    return cleaning.split_lines(table(spark, d, "documents"), keep=["doc_id"])


_LINES = f"""
lines AS (
  SELECT doc_id, idx, line FROM (
    SELECT doc_id, generate_subscripts(l, 1) AS idx, unnest(l) AS line
    FROM (SELECT doc_id, list_transform(string_split(text, chr(10)),
            lambda x: {strip_sql('x')}) AS l FROM documents))
  WHERE line <> ''),
numbered AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS pos,
         line FROM lines)
"""


def clean_lines_stateless(spark, d):
    return cleaning.clean_lines(raw_pages(spark, d), headers=RAW_HEADERS)


_CLEAN_LIST = rf"""
raw AS ({RAW_PAGES_SQL}),
a AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
        lambda x: {strip_sql('x')}), lambda x: x <> '') AS l FROM raw),
b AS (SELECT doc_id, list_filter(l, lambda x: NOT list_contains({list(RAW_HEADERS)!r}, upper(x))
        AND NOT regexp_full_match(x, '[0-9]+')) AS l FROM a),
c AS (SELECT doc_id, list_transform(l, lambda x: regexp_replace(x, '\s+', ' ', 'g')) AS l FROM b),
e AS (SELECT doc_id, list_filter(list_transform(l, lambda x: CASE
        WHEN x[1] <> '[' THEN x
        WHEN {strip_sql("regexp_replace(x, '^[[]+', '')")} <> ''
          THEN '- ' || {strip_sql("regexp_replace(x, '^[[]+', '')")} END),
        lambda x: x IS NOT NULL) AS l FROM c),
f AS (SELECT doc_id, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS l FROM e)
"""


def clean_text(spark, d):
    return cleaning.clean_text(raw_pages(spark, d), headers=RAW_HEADERS)


def dedupe_consecutive_lines(spark, d):
    words = F.split(F.regexp_replace("text", r"\s+", "\n"), "\n", -1)
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(X.drop_repeats(words), "\n").alias("text")
    )


def dedupe_blocks(spark, d):
    return cleaning.dedupe_blocks(doubled_pages(spark, d))


def _block_scan(source: str) -> str:
    """Step by step scan over hashed blocks; ``source`` is doc_id, l."""
    return f"""
p AS ({source}),
hashed AS (SELECT doc_id, len(l) AS n, CASE WHEN len(l) < 3 THEN []::UBIGINT[] ELSE
        list_transform(range(1, len(l) - 1),
          lambda i: hash(l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2])) END AS blocks FROM p),
s(doc_id, n, blocks, i, seen, kept) AS (
  SELECT doc_id, n, blocks, 1::BIGINT, []::UBIGINT[], []::BIGINT[] FROM hashed
  UNION ALL
  SELECT doc_id, n, blocks,
    CASE WHEN i <= len(blocks) AND list_contains(seen, blocks[i]) THEN i + 3 ELSE i + 1 END,
    CASE WHEN i <= len(blocks) AND NOT list_contains(seen, blocks[i])
         THEN list_append(seen, blocks[i]) ELSE seen END,
    CASE WHEN i <= len(blocks) AND list_contains(seen, blocks[i]) THEN kept
         ELSE list_append(kept, i) END
  FROM s WHERE i <= n)
SELECT s.doc_id, array_to_string(list_transform(s.kept, lambda k: p.l[k]), chr(10)) AS text
FROM s JOIN p ON p.doc_id = s.doc_id WHERE s.i > s.n
"""


def running_header_anti_join(spark, d):
    lines = lines_split(spark, d)
    headers = (
        lines.select("doc_id", F.upper("line").alias("header"))
        .distinct()
        .groupBy("header")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > HEADER_DOCUMENTS)
    )
    return cleaning.drop_header_lines(lines, headers)


def truncate_at_marker(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.cut_at_line(F.col("text"), CUT_TITLES).alias("text")
    )


def dedupe_title(spark, d):
    return doubled_pages(spark, d).select(
        "doc_id",
        X.keep_first_title(F.col("text"), F.element_at(F.split("text", "\n", -1), 1)).alias("text"),
    )


def section_text(spark, d):
    pages = conversation_pages(table(spark, d, "conversations"))
    sections = headings.page_buckets(pages)
    return chunking.section_text(chunking.section_pages(pages, sections)).select(
        "document_id", "section_id", "text"
    )


def lexical_tokens(spark, d):
    docs = table(spark, d, "documents")
    return each(docs, ["doc_id"], search_terms(F.col("text")), "term", "pos")


def whitespace_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", word_count(F.col("text")).alias("n_words"))


def token_stats(spark, d):
    counted = table(spark, d, "documents").select(
        "lang", word_count(F.col("text")).alias("token_count")
    )
    return chunking.chunk_statistics(counted, ("lang",))


_WORDS = r"len(regexp_extract_all(text, '\S+'))"

QUERIES = {
    "lines_split": lines_split,
    "clean_lines_stateless": clean_lines_stateless,
    "clean_text": clean_text,
    "dedupe_consecutive_lines": dedupe_consecutive_lines,
    "dedupe_blocks": dedupe_blocks,
    "running_header_anti_join": running_header_anti_join,
    "truncate_at_marker": truncate_at_marker,
    "dedupe_title": dedupe_title,
    "section_text": section_text,
    "lexical_tokens": lexical_tokens,
    "whitespace_counts": whitespace_counts,
    "token_stats": token_stats,
}

ORACLE = {
    "lines_split": f"WITH {_LINES} SELECT doc_id, pos, line FROM numbered",
    "clean_lines_stateless": (
        f"WITH {_CLEAN_LIST} SELECT doc_id, array_to_string(l, chr(10)) AS text FROM f"
    ),
    "clean_text": (
        f"WITH RECURSIVE {_CLEAN_LIST}, " + _block_scan("SELECT doc_id, l FROM f").lstrip()
    ),
    "dedupe_consecutive_lines": r"""
WITH w AS (SELECT doc_id, string_split(regexp_replace(text, '\s+', chr(10), 'g'), chr(10)) AS l
           FROM documents),
e AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM w),
k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM e)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k
WHERE before IS NULL OR before <> line GROUP BY doc_id
""",
    "dedupe_blocks": (
        "WITH RECURSIVE "
        + _block_scan(
            f"SELECT doc_id, string_split(text, chr(10)) AS l FROM ({DOUBLED_SQL})"
        ).lstrip()
    ),
    "running_header_anti_join": f"""
WITH {_LINES},
h AS (SELECT upper(line) AS header FROM numbered GROUP BY 1
      HAVING count(DISTINCT doc_id) > {HEADER_DOCUMENTS})
SELECT doc_id, pos, line FROM numbered
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.header = upper(line))
""",
    "truncate_at_marker": f"""
WITH e AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line, text
           FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)),
m AS (SELECT doc_id, min(i) AS cut FROM e
      WHERE upper({strip_sql('line')}) IN {CUT_TITLES!r} GROUP BY doc_id),
t AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY i) AS text
      FROM e JOIN m USING (doc_id) WHERE i < cut GROUP BY e.doc_id)
SELECT d.doc_id, CASE WHEN m.cut IS NULL THEN d.text
    ELSE coalesce(regexp_replace(t.text, '\\s+$', ''), '') END AS text
FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "dedupe_title": f"""
WITH e AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line,
             upper({strip_sql('l[1]')}) AS title
           FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM ({DOUBLED_SQL}))),
k AS (SELECT *, count(*) FILTER (WHERE upper({strip_sql('line')}) = title)
        OVER (PARTITION BY doc_id ORDER BY i) AS seen FROM e)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k
WHERE upper({strip_sql('line')}) <> title OR seen = 1 GROUP BY doc_id
""",
    "section_text": f"""
WITH p AS (SELECT conv_id::VARCHAR AS document_id, turn + 1 AS page, text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT document_id, printf('sec_%03d', (r - 1) // 5 + 1) AS section_id,
       string_agg({strip_sql('text')}, chr(10) || chr(10) ORDER BY page)
         FILTER (WHERE {strip_sql('text')} <> '') AS text
FROM p GROUP BY 1, 2
""",
    "lexical_tokens": f"""
SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS term
FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)
""",
    "whitespace_counts": f"SELECT doc_id, CAST({_WORDS} AS INTEGER) AS n_words FROM documents",
    "token_stats": f"""
SELECT lang, count(*) AS total_chunks, CAST(min(n) AS INTEGER) AS min_tokens,
       CAST(max(n) AS INTEGER) AS max_tokens, CAST(sum(n) // count(*) AS INTEGER) AS avg_tokens
FROM (SELECT lang, {_WORDS} AS n FROM documents) GROUP BY lang
""",
}
