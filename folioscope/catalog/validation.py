"""Chunk check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import chunking, duplicates, validation
from ..session import settle
from .chunks import SMALL, windows_sql
from .tables import RAW_PAGES_SQL, raw_pages, strip_sql, table, upper_sql

EXCLUDED = ("FR", "OF.", "AS.")
HEADERS = ("OF.", "AS.", "ES.")
PREFIX = "IETZTE"

# -- documents as chunks with faults ------------------------------------------


def faulty_chunks(spark, d):
    """Every document as one chunk; fields are derived so that checks fire."""
    docs = table(spark, d, "documents").drop("text").join(raw_pages(spark, d), "doc_id").join(
        table(spark, d, "labels"), "doc_id", "left"
    )
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.when(
            F.col("lang") == "en",
            F.concat(F.lit("doc_1_section_"), F.col("n_chars").cast("string"), F.lit("_c001")),
        ).otherwise(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"))).alias("chunk_id"),
        F.col("source").alias("document_id"),
        F.when(F.col("lang") != "de", F.col("lang")).alias("document_name"),
        F.lit(None).cast("string").alias("pdf_file"),
        F.concat(F.lit("section_"), F.col("quality").cast("string")).alias("section_id"),
        F.upper("lang").alias("section_title"),
        (F.floor(F.col("n_chars") / 500) - 1).cast("int").alias("page_start"),
        F.floor(F.col("doc_id") / 100).cast("int").alias("page_end"),
        F.when(F.col("lang") != "es", F.floor(F.col("n_chars") / 6).cast("int")).alias("token_count"),
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit("  \n "))
        .when(F.col("toxic") == 1, F.col("source"))
        .otherwise(F.col("text"))
        .alias("text"),
    )


def known_sections(spark, d):
    """One section per source, named after the source, on pages 2 to 5."""
    return (
        table(spark, d, "documents")
        .select(F.col("source").alias("document_id"))
        .distinct()
        .select(
            "document_id",
            F.lit("section_1").alias("section_id"),
            F.upper("document_id").alias("section_title"),
            F.lit(2).alias("start_page"),
            F.lit(5).alias("end_page"),
        )
    )


CHUNKS_SQL = rf"""
rawp AS ({RAW_PAGES_SQL}),
chunks AS (SELECT d.doc_id AS ord,
    CASE WHEN lang = 'en' THEN concat('doc_1_section_', n_chars, '_c001') ELSE concat(source, '-', d.doc_id) END AS chunk_id,
    source AS document_id, CASE WHEN lang <> 'de' THEN lang END AS document_name,
    'section_' || quality AS section_id, upper(lang) AS section_title,
    CAST(floor(n_chars / 500) - 1 AS INTEGER) AS page_start, CAST(floor(d.doc_id / 100) AS INTEGER) AS page_end,
    CASE WHEN lang <> 'es' THEN CAST(floor(n_chars / 6) AS INTEGER) END AS token_count,
    CASE WHEN toxic = 1 AND quality = 0 THEN '  ' || chr(10) || ' ' WHEN toxic = 1 THEN source ELSE r.text END AS text
  FROM documents d JOIN rawp r USING (doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id),
lines AS (SELECT ord, chunk_id, document_id, section_title, i, {strip_sql('x')} AS line FROM (
  SELECT ord, chunk_id, document_id, section_title, generate_subscripts(l, 1) AS i, unnest(l) AS x
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM chunks)) WHERE {strip_sql('x')} <> '')
"""


def _rows(*checks):
    def run(spark, d):
        return validation.row_issues(
            faulty_chunks(spark, d), [pair for check in checks for pair in check()]
        )

    return run


def _sql(level: str, check: str, message: str, where: str, source: str = "chunks") -> str:
    return (
        f"SELECT '{level}' AS level, '{check}' AS \"check\", chunk_id, {message} AS message "
        f"FROM {source} WHERE {where}"
    )


def duplicate_chunk_id(spark, d):
    return validation.duplicate_chunk_id(faulty_chunks(spark, d))


def unknown_section(spark, d):
    return validation.unknown_section(faulty_chunks(spark, d), known_sections(spark, d))


def running_header_leak(spark, d):
    return validation.running_header_leak(
        faulty_chunks(spark, d), known_sections(spark, d), HEADERS, PREFIX
    )


def page_number_type(spark, d):
    """Pages read as text, some of them words."""
    chunks = faulty_chunks(spark, d).withColumn(
        "page_start",
        F.when(F.col("document_name") == "fr", F.concat(F.lit("p"), F.col("page_start").cast("string")))
        .otherwise(F.col("page_start").cast("string")),
    ).withColumn("page_end", F.col("page_end").cast("string"))
    return validation.row_issues(chunks, validation.page_numbers(chunks.schema))


def duplicate_chunk_text(spark, d):
    chunks = table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("chunk_id"),
        "text",
    )
    found = duplicates.near_duplicates(chunks)
    return found.select("chunk_id", "other_id", F.round("ratio", 6).alias("ratio"))


def chunk_overlaps(spark, d):
    """Shared text of neighbouring chunks of every document."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    chunks = chunking.split_into_chunks(docs, size=SMALL, keep=("doc_id", "source")).select(
        F.col("source").alias("document_id"),
        F.col("doc_id").cast("string").alias("section_id"),
        F.col("chunk_no").alias("ord"),
        F.concat(
            F.col("doc_id").cast("string"), F.format_string("_c%03d", "chunk_no")
        ).alias("chunk_id"),
        "token_count",
        "text",
    )
    return validation.overlap_issues(validation.neighbour_overlaps(chunks))


def section_boundary_leak(spark, d):
    return validation.section_boundary_leak(faulty_chunks(spark, d), known_sections(spark, d))


def _all_issues(spark, d, chunks):
    return validation.validate(
        chunks, known_sections(spark, d), excluded=EXCLUDED, headers=HEADERS, prefix=PREFIX
    )


def validation_report(spark, d):
    """Totals of all checks."""
    chunks = faulty_chunks(spark, d)
    return validation.summary(chunks, _all_issues(spark, d, chunks))


def issues_by_check(spark, d):
    """All checks with their counts and first issues; issues are stored once."""
    issues = settle(_all_issues(spark, d, faulty_chunks(spark, d)), "issues")
    return validation.by_check(issues).withColumn("samples", F.array_join("samples", " | "))


def publishing_gate(spark, d):
    """Whether the chunks may be published: no issue of level ERROR."""
    chunks = faulty_chunks(spark, d)
    blocked = validation.has_errors(_all_issues(spark, d, chunks))
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks")).withColumn("blocked", F.lit(blocked))


def validate_chunks(spark, d):
    """Every check together, counted per check and level."""
    issues = _all_issues(spark, d, faulty_chunks(spark, d))
    return issues.groupBy("check", "level").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "missing_field": _rows(validation.missing_field),
    "empty_chunk": _rows(validation.empty_chunk),
    "duplicate_chunk_id": duplicate_chunk_id,
    "chunk_id_format": _rows(validation.chunk_id_format),
    "unknown_section_id": unknown_section,
    "page_number_type": page_number_type,
    "page_numbers": _rows(validation.page_numbers),
    "token_count_mismatch": _rows(validation.token_count_mismatch),
    "token_bounds": _rows(validation.token_bounds),
    "excluded_section_leak": _rows(lambda: validation.excluded_section_leak(EXCLUDED)),
    "running_header_leak": running_header_leak,
    "excluded_content_leak": _rows(lambda: validation.excluded_content_leak(EXCLUDED)),
    "standalone_page_number": _rows(validation.standalone_page_number),
    "broken_bullet_artifact": _rows(validation.broken_bullet),
    "irregular_whitespace": _rows(validation.irregular_whitespace),
    "suspiciously_short_text": _rows(validation.short_text),
    "duplicate_chunk_text": duplicate_chunk_text,
    "chunk_overlaps": chunk_overlaps,
    "section_boundary_leak": section_boundary_leak,
    "validation_report": validation_report,
    "publishing_gate": publishing_gate,
    "issues_by_check": issues_by_check,
    "validate_chunks": validate_chunks,
}

_N = r"len(regexp_extract_all(coalesce(text, ''), '\S+'))"
_DRIFT = f"abs({_N} - token_count) / {_N}"
_NUMBERS = r"regexp_extract_all(text, '(?m)^\s*\d{1,4}\s*$')"
_FIRST_EXCLUDED = (
    "(SELECT arg_min(line, i) FROM lines l WHERE l.ord = chunks.ord AND "
    f"{upper_sql('line')} IN {EXCLUDED!r})"
)
_SQLS = {
    "missing_field": " UNION ALL ".join(
        _sql("ERROR", "missing_field", f"'Missing required field ''{f}'''", f"{f} IS NULL")
        for f in K.REQUIRED_FIELDS
    ),
    "empty_chunk": _sql(
        "ERROR", "empty_chunk", "'Chunk text is empty or whitespace-only'",
        f"{strip_sql('text')} = ''",
    ),
    "chunk_id_format": _sql(
        "WARNING", "chunk_id_format",
        "concat('chunk_id ''', chunk_id, ''' doesn''t match expected pattern "
        "''<doc>_NNN_section_NNN_cNNN''')",
        f"NOT regexp_matches(chunk_id, '{K.CHUNK_ID_PATTERN}')",
    ),
    "page_numbers": _sql(
        "ERROR", "page_number_range", "'page_start/page_end must be >= 1'",
        "page_start < 1 OR page_end < 1",
    )
    + " UNION ALL "
    + _sql(
        "ERROR", "page_order",
        "concat('page_end (', page_end, ') is before page_start (', page_start, ')')",
        "page_end < page_start",
    ),
    "token_count_mismatch": _sql(
        "WARNING", "token_count_mismatch",
        f"concat('stored token_count=', token_count, ' vs recomputed=', {_N}, ' (drift ', "
        f"CAST(round_even({_DRIFT} * 100, 0) AS BIGINT), '%, tolerance 10%)')",
        f"token_count IS NOT NULL AND {_N} > 0 AND {_DRIFT} > 0.1",
    ),
    "token_bounds": _sql(
        "WARNING", "below_min_tokens",
        "concat('token_count=', token_count, ' is below MIN_TOKENS=400')", "token_count < 400",
    )
    + " UNION ALL "
    + _sql(
        "WARNING", "above_max_tokens",
        "concat('token_count=', token_count, ' exceeds MAX_TOKENS=900')", "token_count > 900",
    ),
    "excluded_section_leak": _sql(
        "ERROR", "excluded_section_leak",
        "concat('Chunk belongs to excluded section ''', section_title, ''' "
        "(REFERENCES/ANNEXES should not reach the chunk table)')",
        f"section_title IN {EXCLUDED!r}",
    ),
    "excluded_content_leak": _sql(
        "ERROR", "excluded_content_leak",
        f"concat('Chunk (section ''', section_title, ''') contains a line matching an excluded "
        f"section title (''', {_FIRST_EXCLUDED}, ''') — likely REFERENCES/ANNEXES content bled in "
        "due to page-level boundary rounding')",
        f"section_title NOT IN {EXCLUDED!r} AND {_FIRST_EXCLUDED} IS NOT NULL",
    ),
    "standalone_page_number": _sql(
        "WARNING", "standalone_page_number",
        f"concat('Found ', len({_NUMBERS}), ' standalone numeric line(s) that look like stray page "
        f"numbers: [', array_to_string(list_transform(list_slice({_NUMBERS}, 1, 5), "
        "lambda x: concat('''', replace(x, chr(10), '\\n'), '''')), ', '), ']')",
        f"len({_NUMBERS}) > 0",
    ),
    "broken_bullet_artifact": _sql(
        "WARNING", "broken_bullet_artifact",
        "'Text contains raw ''['' bullet artifacts from PDF extraction'",
        r"regexp_matches(text, '(?m)^\s*\[\s*$') OR regexp_matches(text, '(?m)^\[\s+\S')",
    ),
    "irregular_whitespace": _sql(
        "INFO", "irregular_whitespace",
        "'Chunk contains runs of 4+ spaces/tabs, check for extraction artifacts'",
        r"regexp_matches(text, '[ \t]{4,}')",
    ),
    "suspiciously_short_text": _sql(
        "ERROR", "suspiciously_short_text",
        f"concat('Chunk text is only ', len({strip_sql('text')}), ' characters')",
        f"text <> '' AND len({strip_sql('text')}) < 50",
    ),
}
_DUPLICATE_IDS = (
    "SELECT 'ERROR' AS level, 'duplicate_chunk_id' AS \"check\", chunk_id, "
    "'chunk_id is not unique' AS message FROM (SELECT chunk_id, row_number() OVER "
    "(PARTITION BY chunk_id ORDER BY ord) AS r FROM chunks) WHERE r > 1"
)
_UNKNOWN = _sql(
    "ERROR", "unknown_section_id",
    "concat('section_id ''', section_id, ''' not found in the section table')",
    "section_id <> 'section_1'",
)
_HEADER_LEAK = f"""
SELECT 'WARNING' AS level, 'running_header_leak' AS "check", chunk_id, arg_min(
  CASE WHEN header THEN concat('Possible running header/title leaked into chunk text: ''', line, '''')
  ELSE concat('Heading ''', line, ''' from a different section appears inside this chunk — likely page-header bleed across a section boundary') END, i) AS message
FROM (SELECT *, ({upper_sql('line')} IN {HEADERS!r} OR starts_with({upper_sql('line')}, '{PREFIX}')) AS header FROM lines)
WHERE header OR ({upper_sql('line')} = upper(document_id) AND {upper_sql('line')} <> section_title) GROUP BY ord, chunk_id"""
_BOUNDARY = (
    _sql(
        "WARNING", "section_boundary_leak",
        "concat('Chunk page_start (', page_start, ') precedes its section''s page_start (2) — "
        "possible bleed from previous section')",
        "section_id = 'section_1' AND page_start < 2",
    )
    + " UNION ALL "
    + _sql(
        "WARNING", "section_boundary_leak",
        "concat('Chunk page_end (', page_end, ') exceeds its section''s page_end (5) — "
        "possible bleed into next section')",
        "section_id = 'section_1' AND page_end > 5",
    )
)
_ROW_ISSUES = " UNION ALL ".join(_SQLS.values())


def _alike_sql(source: str) -> str:
    """First earlier alike text, by brute force inside a length band."""
    return f"""
t AS ({source}),
s AS (SELECT ord, chunk_id, {strip_sql('text')} AS text FROM t WHERE {strip_sql('text')} <> ''),
c AS (SELECT ord, ch, count(*) AS n FROM (SELECT ord, unnest(string_split(text, '')) AS ch FROM s) GROUP BY 1, 2),
pairs AS (SELECT a.ord AS o, b.ord AS p, len(a.text) + len(b.text) AS total FROM s a JOIN s b ON b.ord < a.ord
  AND 2 * least(len(a.text), len(b.text)) >= {K.DUPLICATE_RATIO} * (len(a.text) + len(b.text))),
common AS (SELECT o, p, any_value(total) AS total, sum(least(x.n, y.n)) AS m FROM pairs
  JOIN c x ON x.ord = o JOIN c y ON y.ord = p AND y.ch = x.ch GROUP BY o, p),
alike AS (SELECT o, min(p) AS p, arg_min(2.0 * m / total, p) AS ratio FROM common
  WHERE 2.0 * m / total >= {K.DUPLICATE_RATIO} GROUP BY o)"""


def _overlap_text(previous: str) -> str:
    return f"""concat('~', chars, ' chars (~', CAST(round_even(tokens, 0) AS BIGINT), ' tokens, ',
    CAST(round_even(share * 100, 0) AS BIGINT),
    '% of the smaller neighboring chunk) shared between tail of ', chr(39), {previous},
    chr(39), ' and head of this chunk', CASE WHEN share >= 0.5
    THEN ' — well beyond typical overlap, check the overlap setting' ELSE '' END)"""


def _overlap_sql() -> str:
    """Longest common substrings as runs of equal 20-character pieces.

    Pieces that match along one diagonal without a gap form a longer match.
    """
    windows = windows_sql("SELECT doc_id, text FROM documents", "doc_id", SMALL)
    return f"""
WITH {windows},
p AS (SELECT a.doc_id, b.chunk_no, a.chunk_no AS prev, right(a.text, 1500) AS t, left(b.text, 1500) AS h,
    least(a.token_count, b.token_count) AS smaller
  FROM made a JOIN made b ON b.doc_id = a.doc_id AND b.chunk_no = a.chunk_no + 1),
ga AS (SELECT doc_id, chunk_no, i, substring(t, i, 20) AS g FROM (
  SELECT *, unnest(range(1, len(t) - 18)) AS i FROM p)),
gb AS (SELECT doc_id, chunk_no, i, substring(h, i, 20) AS g FROM (
  SELECT *, unnest(range(1, len(h) - 18)) AS i FROM p)),
m AS (SELECT doc_id, chunk_no, gb.i AS i, gb.i - ga.i AS diagonal FROM ga JOIN gb USING (doc_id, chunk_no, g)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, chunk_no, diagonal ORDER BY i) AS run FROM m),
l AS (SELECT doc_id, chunk_no, diagonal, run, count(*) + 19 AS n FROM r GROUP BY ALL),
best AS (SELECT doc_id, chunk_no, max(n) AS chars FROM l GROUP BY 1, 2),
s AS (SELECT doc_id, chunk_no, prev, chars, chars / 4.0::DOUBLE AS tokens,
    chars / 4.0::DOUBLE / greatest(smaller, 1) AS share FROM best JOIN p USING (doc_id, chunk_no))
SELECT CASE WHEN share >= 0.5 THEN 'ERROR' WHEN share >= 0.3 THEN 'WARNING' ELSE 'INFO' END AS level,
  CASE WHEN share >= 0.3 THEN 'excessive_overlap' ELSE 'measured_overlap' END AS "check",
  concat(doc_id, printf('_c%03d', chunk_no)) AS chunk_id,
  {_overlap_text("concat(doc_id, printf('_c%03d', prev))")} AS message
FROM s"""


ORACLE = {name: f"WITH {CHUNKS_SQL} {sql}" for name, sql in _SQLS.items()}
ORACLE.update(
    {
        "duplicate_chunk_id": f"WITH {CHUNKS_SQL} {_DUPLICATE_IDS}",
        "unknown_section_id": f"WITH {CHUNKS_SQL} {_UNKNOWN}",
        "running_header_leak": f"WITH {CHUNKS_SQL} {_HEADER_LEAK}",
        "page_number_type": f"WITH {CHUNKS_SQL} "
        + _sql(
            "ERROR", "page_number_type", "'page_start/page_end must be integers'",
            "document_name = 'fr'",
        )
        + " UNION ALL "
        + _sql(
            "ERROR", "page_number_range", "'page_start/page_end must be >= 1'",
            "coalesce(document_name, '') <> 'fr' AND (page_start < 1 OR page_end < 1)",
        )
        + " UNION ALL "
        + _sql(
            "ERROR", "page_order",
            "concat('page_end (', page_end, ') is before page_start (', page_start, ')')",
            "coalesce(document_name, '') <> 'fr' AND page_end < page_start",
        ),
        "duplicate_chunk_text": f"""
WITH {_alike_sql("SELECT doc_id AS ord, concat('doc_', doc_id) AS chunk_id, text FROM documents")}
SELECT concat('doc_', o) AS chunk_id, concat('doc_', p) AS other_id, round(ratio, 6) AS ratio FROM alike""",
        "chunk_overlaps": _overlap_sql(),
        "section_boundary_leak": f"WITH {CHUNKS_SQL} {_BOUNDARY}",
    }
)

_ALL_ISSUES = f"""
WITH {CHUNKS_SQL},
{_alike_sql("SELECT ord, chunk_id, text FROM chunks")},
pr AS (SELECT *, lag(text) OVER w AS before, lag(chunk_id) OVER w AS prev, lag(coalesce(nullif(token_count, 0), {_N})) OVER w AS bn,
    coalesce(nullif(token_count, 0), {_N}) AS an FROM chunks
  WINDOW w AS (PARTITION BY document_id, section_id ORDER BY ord)),
pp AS (SELECT ord, chunk_id, prev, right(before, 1500) AS t, left(text, 1500) AS h, least(an, bn) AS smaller FROM pr
  WHERE before IS NOT NULL),
ga AS (SELECT ord, i, substring(t, i, 20) AS g FROM (SELECT *, unnest(range(1, len(t) - 18)) AS i FROM pp)),
gb AS (SELECT ord, i, substring(h, i, 20) AS g FROM (SELECT *, unnest(range(1, len(h) - 18)) AS i FROM pp)),
mt AS (SELECT ord, gb.i AS i, gb.i - ga.i AS diagonal FROM ga JOIN gb USING (ord, g)),
rn AS (SELECT *, i - row_number() OVER (PARTITION BY ord, diagonal ORDER BY i) AS run FROM mt),
ln_ AS (SELECT ord, diagonal, run, count(*) + 19 AS n FROM rn GROUP BY ALL),
sh AS (SELECT any_value(chunk_id) AS chunk_id, any_value(prev) AS prev, max(n) AS chars,
    max(n) / 4.0::DOUBLE AS tokens, max(n) / 4.0::DOUBLE / greatest(any_value(smaller), 1) AS share
  FROM ln_ JOIN pp USING (ord) GROUP BY ord),
issues AS ({_ROW_ISSUES} UNION ALL {_DUPLICATE_IDS} UNION ALL {_UNKNOWN} UNION ALL {_HEADER_LEAK}
  UNION ALL {_BOUNDARY}
  UNION ALL SELECT 'ERROR', 'duplicate_chunk_text', a.chunk_id,
    concat('Near-duplicate text (ratio=', printf('%.2f', ratio), ') with chunk ', chr(39), b.chunk_id, chr(39))
    FROM alike JOIN chunks a ON a.ord = o JOIN chunks b ON b.ord = p
  UNION ALL SELECT CASE WHEN share >= 0.5 THEN 'ERROR' WHEN share >= 0.3 THEN 'WARNING' ELSE 'INFO' END,
    CASE WHEN share >= 0.3 THEN 'excessive_overlap' ELSE 'measured_overlap' END, chunk_id, {_overlap_text('prev')} FROM sh)
"""
ORACLE["validate_chunks"] = f'{_ALL_ISSUES} SELECT "check", level, count(*) AS n FROM issues GROUP BY 1, 2'
ORACLE["validation_report"] = f"""{_ALL_ISSUES}
SELECT (SELECT count(*) FROM chunks) AS total_chunks, count(*) FILTER (WHERE level = 'ERROR') AS error_count,
  count(*) FILTER (WHERE level = 'WARNING') AS warning_count, count(*) FILTER (WHERE level = 'INFO') AS info_count
FROM issues"""
ORACLE["publishing_gate"] = f"""{_ALL_ISSUES}
SELECT (SELECT count(*) FROM chunks) AS total_chunks, count(*) FILTER (WHERE level = 'ERROR') > 0 AS blocked
FROM issues"""
ORACLE["issues_by_check"] = f"""{_ALL_ISSUES},
r AS (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY chunk_id, message) AS r FROM issues)
SELECT "check", min(level) AS level, count(*) AS n, greatest(0, count(*) - 5) AS more,
  string_agg(concat('[', chunk_id, '] ', message), ' | ' ORDER BY r) FILTER (WHERE r <= 5) AS samples
FROM r GROUP BY "check" """
