"""Heading and section queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.text import squeeze, strip, stripped_lines
from ..operators import headings
from ..operators.ordered import first_rows
from ..session import settle
from ..sources.pages import conversation_pages, html_blocks, html_bookmarks, html_layout
from .tables import strip_sql, table, upper_sql

# -- line tests ---------------------------------------------------------------


def _sample_lines(spark, d):
    """Lines of the documents, plain, numbered and in capitals, with page urls
    and page-number lines."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.posexplode(stripped_lines(F.col("text"))).alias("pos", "line")
    )
    shapes = F.array(
        F.col("line"),
        F.concat((F.col("pos") + 1).cast("string"), F.lit("."), F.col("doc_id").cast("string"),
                 F.lit(" "), F.col("line")),
        F.rtrim(F.upper("line"), F.lit(".")),
        F.concat(F.lit("page "), F.col("doc_id").cast("string"), F.lit(" "), F.col("line")),
        F.concat(F.lit("Table "), F.col("pos").cast("string"), F.lit(" "), F.col("line")),
        F.concat(F.lit("["), F.col("line"), F.lit("]")),
    )
    lines = docs.select("doc_id", "pos", F.posexplode(shapes).alias("shape", "line"))
    urls = table(spark, d, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.lit(0).alias("pos"),
        F.posexplode(F.array(F.col("url"), F.col("page_id").cast("string"))).alias("shape", "line"),
    )
    return lines.unionByName(urls.withColumn("shape", F.col("shape") + 6))


_SAMPLE = f"""
docs AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (
  SELECT doc_id, generate_subscripts(l, 1) AS i, {strip_sql('unnest(l)')} AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''),
shaped AS (
  SELECT doc_id, pos, 0 AS shape, line FROM docs
  UNION ALL SELECT doc_id, pos, 1, concat(pos + 1, '.', doc_id, ' ', line) FROM docs
  UNION ALL SELECT doc_id, pos, 2, rtrim({upper_sql('line')}, '.') FROM docs
  UNION ALL SELECT doc_id, pos, 3, concat('page ', doc_id, ' ', line) FROM docs
  UNION ALL SELECT doc_id, pos, 4, concat('Table ', pos, ' ', line) FROM docs
  UNION ALL SELECT doc_id, pos, 5, concat('[', line, ']') FROM docs
  UNION ALL SELECT page_id, 0, 6, url FROM pages
  UNION ALL SELECT page_id, 0, 7, page_id::VARCHAR FROM pages)
"""
_PREFIXES = "|".join(K.NOISE_PREFIXES)
_NOISE_SQL = (
    f"(line = '' OR regexp_full_match(line, '[0-9]+') OR (line[1] = '[' AND line[-1] = ']') "
    f"OR regexp_matches(line, '^(?:{_PREFIXES})', 'i'))"
)
_TOPICS = "|".join(t.replace(" ", r"\s+") for t in K.TOPIC_TITLES)
_PREFIX_WORDS = "|".join(t.replace(" ", r"\s+") for t in K.PREFIX_WORDS)
_RULES_SQL = " OR ".join(
    "regexp_matches(line, '{}', 'i')".format(p.replace("'", "''"))
    for p in (
        f"^{K.DECIMAL_NUMBER}",
        f"^{K.ROMAN_NUMBER}",
        rf"^(?:{_PREFIX_WORDS})\s+{K.PREFIX_NUMBER}",
        f"^(?:{_TOPICS})$",
    )
)
_HEADING_SQL = (
    f"(len(line) BETWEEN 3 AND 140 AND NOT {_NOISE_SQL} AND ({_RULES_SQL} OR "
    r"(line = upper(line) AND len(line) BETWEEN 4 AND 60 AND NOT regexp_matches(line, '[.:;]$') "
    r"AND regexp_matches(line, '\p{L}'))))"
)


def noise_lines(spark, d):
    return _sample_lines(spark, d).where(P.is_noise_line(F.col("line"))).select(
        "doc_id", "pos", "shape", "line"
    )


def rule_headings(spark, d):
    return _sample_lines(spark, d).where(P.is_rule_heading(F.col("line"))).select(
        "doc_id", "pos", "shape", "line"
    )


# -- numbered headings and their continuation ---------------------------------


def _recommendation_pages(spark, d):
    """Each conversation is a document, each turn a page; user turns carry
    numbered headings, their lines in capitals."""
    line = F.rtrim(F.upper("x"), F.lit("."))
    turned = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
        "role",
        F.posexplode(F.split("text", "\n", -1)).alias("i", "x"),
    )
    lined = turned.select(
        "document_id",
        "page_number",
        "i",
        F.when(
            F.col("role") == "user",
            F.concat((F.col("i") + 1).cast("string"), F.lit(". RECOMMENDATION ON "), line),
        ).otherwise(line).alias("line"),
    )
    return lined.groupBy("document_id", "page_number").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]),
            "\n",
        ).alias("text")
    )


_REC_LINE = (
    f"CASE WHEN role = 'user' THEN concat(i + 1, '. RECOMMENDATION ON ', "
    f"rtrim({upper_sql('x')}, '.')) ELSE rtrim({upper_sql('x')}, '.') END"
)
_REC_LINES = f"""
turned AS (SELECT conv_id::VARCHAR AS document_id, CAST(turn + 1 AS INTEGER) AS page_number, role,
    generate_subscripts(l, 1) - 1 AS i, unnest(l) AS x
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations)),
lined AS (SELECT document_id, page_number, i, {strip_sql(_REC_LINE)} AS line
  FROM turned),
nexts AS (SELECT *, lead(line) OVER (PARTITION BY document_id, page_number ORDER BY i) AS nxt,
    regexp_matches(line, '^{K.NUMBERED_RECOMMENDATION}', 'i') AS num FROM lined),
m AS (SELECT *, coalesce(num AND NOT regexp_matches(line, '[.:]$') AND nxt <> ''
    AND nxt = upper(nxt) AND len(nxt) < 100, false) AS can FROM nexts),
g AS (SELECT *, coalesce(sum(CASE WHEN can THEN 0 ELSE 1 END) OVER (PARTITION BY document_id,
    page_number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number, grp ORDER BY i) AS place FROM g),
a AS (SELECT *, can AND place % 2 = 1 AS takes FROM r),
b AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY document_id, page_number ORDER BY i), false)
    AS taken FROM a),
merged AS (SELECT document_id, page_number, CAST(row_number() OVER (PARTITION BY document_id, page_number
    ORDER BY i) - 1 AS INTEGER) AS pos,
    CASE WHEN takes THEN line || ' ' || nxt ELSE line END AS line FROM b WHERE NOT taken)
"""


def heading_merge(spark, d):
    pages = _recommendation_pages(spark, d)
    return pages.select(
        "document_id",
        "page_number",
        F.posexplode(headings.merge_continuations(F.split("text", "\n", -1))).alias("pos", "line"),
    )


def profile_headings(spark, d):
    return headings.profile_headings(_recommendation_pages(spark, d), skip_pages=())


SKIPPED_PAGES = (2, 3)


def profile_headings_skipped(spark, d):
    """Headings of all pages but those of the contents list."""
    return headings.profile_headings(_recommendation_pages(spark, d), SKIPPED_PAGES)


_PROFILE = f"""
{_REC_LINES},
found AS (SELECT document_id, page_number, pos, line AS title,
    lag(upper(line)) OVER (PARTITION BY document_id ORDER BY page_number, pos) AS before
  FROM merged WHERE line <> '' AND NOT contains(upper(line), '{K.TITLE_PHRASE}')
    AND upper(line) NOT IN {K.HEADING_RUNNING_HEADERS!r}
    AND ((upper(line) IN {K.MAIN_SECTIONS!r} AND line = upper(line))
      OR regexp_matches(line, '^{K.NUMBERED_RECOMMENDATION}', 'i'))),
profile AS (SELECT document_id, page_number, pos, title FROM found
  WHERE before IS NULL OR before <> upper(title))
"""


def section_ranges(spark, d):
    pages = _recommendation_pages(spark, d)
    found = headings.profile_headings(pages, skip_pages=())
    return headings.profile_sections(found, pages).withColumn("ord", F.col("ord").cast("int"))


# -- clamped ranges, page buckets, first occurrence ---------------------------


def _turn_headings(spark, d):
    """First line of every turn as a heading; two turns share a page."""
    turns = table(spark, d, "conversations")
    pages = turns.select(
        F.col("conv_id").cast("string").alias("document_id"),
        (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page_number"),
        F.element_at(F.split("text", "\n", -1), 1).alias("title"),
        F.struct(
            F.lit(1).alias("source"), F.col("turn").alias("major"),
            F.lit(0).cast("bigint").alias("minor"),
        ).alias("order"),
    )
    return pages


def section_ranges_clamped(spark, d):
    found = _turn_headings(spark, d)
    pages = found.select("document_id", "page_number").distinct()
    return headings.section_ranges(
        found, pages, ["order"], F.floor(F.col("order.major") / 64), True, "sec"
    ).withColumn("ord", F.col("ord").cast("int"))


def page_buckets(spark, d):
    pages = conversation_pages(table(spark, d, "conversations"))
    return headings.page_buckets(pages).withColumn("ord", F.col("ord").cast("int"))


def first_occurrence(spark, d):
    lines = table(spark, d, "documents").select(
        "source", "doc_id", F.posexplode(stripped_lines(F.col("text"))).alias("pos", "line")
    )
    return first_rows(lines, ["source", "line"], ["doc_id", "pos"])


# -- HTML layout --------------------------------------------------------------


def body_size_mode(spark, d):
    return headings.body_font_sizes(html_layout(html_blocks(table(spark, d, "pages"))))


# Each "<" begins an event.  A running count of the tags of block elements tells
# which events stand together; those behind a heading or paragraph are a block.
_REFERENCES = "txt"
for _name, _letter in K.HTML_REFERENCES.items():
    _REFERENCES = f"replace({_REFERENCES}, '&{_name};', chr({ord(_letter)}))"
_LAYOUT = rf"""
events AS (SELECT url, page_id, i, e[i] AS piece, i > 1 AND regexp_matches(e[i], '^/?[a-zA-Z][^>]*>') AS is_tag,
    lower(regexp_extract(e[i], '^(/?[a-zA-Z][a-zA-Z0-9]*)(?:[\s/>])', 1)) AS tag
  FROM (SELECT url, page_id, e, unnest(range(1, len(e) + 1)) AS i FROM (SELECT url, page_id, string_split(
    regexp_replace(html, '(?is)<!--.*?-->|<![^>]*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '<') AS e
    FROM pages))),
told AS (SELECT *, coalesce(is_tag AND ltrim(tag, '/') IN {K.HTML_BLOCK_ELEMENTS!r}, false) AS edge,
    CASE WHEN NOT is_tag THEN CASE WHEN i > 1 THEN '<' ELSE '' END || piece
      ELSE CASE WHEN tag = 'br' THEN ' ' ELSE '' END || substr(piece, strpos(piece, '>') + 1) END AS words FROM events),
islands AS (SELECT *, sum(edge::INT) OVER (PARTITION BY page_id ORDER BY i) AS island FROM told),
joined AS (SELECT url, page_id, island, arg_min(tag, i) AS tag, arg_min(words, i) AS first_words, bool_or(edge) AS edge,
    string_agg(CASE WHEN is_tag AND NOT edge THEN tag END, ' ' ORDER BY i) AS inside,
    string_agg(words, '' ORDER BY i) AS txt FROM islands GROUP BY url, page_id, island),
blocks AS (SELECT url, row_number() OVER (PARTITION BY page_id ORDER BY island) - 1 AS block_no, tag,
    CASE WHEN split_part(inside, ' ', 1) = 'b' AND trim(first_words) = '' THEN 'b' ELSE '' END AS bold,
    regexp_replace(replace({_REFERENCES}, '&amp;', '&'), '^\s+|\s+$', '', 'g') AS txt
  FROM joined WHERE edge AND tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'p')),
sized AS (SELECT *, CASE tag WHEN 'h1' THEN 24.0 WHEN 'h2' THEN 18.0 WHEN 'h3' THEN 14.0
    WHEN 'h4' THEN 12.0 WHEN 'p' THEN 10.0 ELSE 11.0 END::DOUBLE AS size FROM blocks),
w AS (SELECT url, size, sum(len(txt)) AS n, min(block_no) AS place FROM sized WHERE txt <> ''
  GROUP BY url, size),
body AS (SELECT url, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY url
  ORDER BY n DESC, place) AS r FROM w) WHERE r = 1)
"""


def layout_headings(spark, d):
    return headings.layout_headings(html_layout(html_blocks(table(spark, d, "pages")))).select(
        "document_id", "page_number", F.col("order.minor").cast("int").alias("block_no"), "title"
    )


_HEADS = f"""
{_LAYOUT},
lines AS (SELECT s.*, txt AS line, body_size FROM sized s LEFT JOIN body b USING (url)),
heads AS (SELECT url, block_no, trim(regexp_replace(line, '\\s+', ' ', 'g'), ':-. ') AS title
  FROM lines WHERE len(line) >= 3 AND NOT {_NOISE_SQL}
    AND (size >= coalesce(body_size, 10.0) + 2.0 OR (bold <> '' AND size >= coalesce(body_size, 10.0) + 0.5)
      OR {_HEADING_SQL})),
usable AS (SELECT *, row_number() OVER (PARTITION BY url, title ORDER BY block_no) AS r FROM heads
  WHERE title <> '' AND len(title) < 140 AND lower(title) NOT IN {K.STOP_TITLES!r}
    AND NOT regexp_matches(upper(title), '{"|".join(K.EXCLUDED_TITLE_WORDS)}'))
"""


def html_block_text(spark, d):
    """Headings and paragraphs of all pages."""
    blocks = html_blocks(table(spark, d, "pages"))
    return blocks.select("document_id", "block_no", "tag", "bold", strip(F.col("text")).alias("text"))


def _html_pages(blocks):
    """Text of the blocks, one line a block, all on page 1."""
    return blocks.groupBy("document_id", F.lit(1).alias("page_number")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("block_no", strip(F.col("text")).alias("t")))),
                lambda s: s["t"],
            ),
            "\n",
        ).alias("text")
    )


def html_headings(spark, d):
    """The whole cascade on HTML pages: bookmarks, layout, lines, buckets."""
    blocks = settle(html_blocks(table(spark, d, "pages")), "blocks")
    pages = settle(_html_pages(blocks), "pages")
    found = headings.detect_headings(pages, html_bookmarks(blocks), html_layout(blocks))
    return headings.detected_sections(found, pages).withColumn("ord", F.col("ord").cast("int"))


def bookmark_headings(spark, d):
    """Turn openings as bookmark entries."""
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"),
        F.col("turn").cast("int").alias("ord"),
        F.lit(1).alias("level"),
        F.element_at(F.split("text", "\n", -1), 1).alias("title"),
        (F.col("turn") + 1).cast("int").alias("page_number"),
    )
    return headings.bookmark_headings(turns).select(
        "document_id", "page_number", F.col("order.major").cast("int").alias("ord"), "title"
    )


def excluded_titles(spark, d):
    """Titles kept by the word rule, by the exact rule, and their clean form."""
    words = ("ING", "TION", "EAU")
    lines = first_occurrence(spark, d)
    title = P.trim_title(squeeze(strip(F.col("line"))))
    return lines.select(
        "source",
        "line",
        title.alias("title"),
        P.has_excluded_word(title, words).alias("by_word"),
        P.is_excluded_title(title, words).alias("by_title"),
    )


QUERIES = {
    "noise_lines": noise_lines,
    "rule_headings": rule_headings,
    "heading_merge": heading_merge,
    "profile_headings": profile_headings,
    "profile_headings_skipped": profile_headings_skipped,
    "section_ranges": section_ranges,
    "section_ranges_clamped": section_ranges_clamped,
    "page_buckets": page_buckets,
    "first_occurrence": first_occurrence,
    "excluded_titles": excluded_titles,
    "bookmark_headings": bookmark_headings,
    "html_block_text": html_block_text,
    "body_size_mode": body_size_mode,
    "layout_headings": layout_headings,
    "html_headings": html_headings,
}

_FIRST = f"""
docs AS (SELECT source, doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1
    AS INTEGER) AS pos FROM (
  SELECT source, doc_id, generate_subscripts(l, 1) AS i, {strip_sql('unnest(l)')} AS line
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> ''),
firsts AS (SELECT source, doc_id, pos, line FROM (SELECT *, row_number() OVER (PARTITION BY source, line
    ORDER BY doc_id, pos) AS r FROM docs) WHERE r = 1)
"""

ORACLE = {
    "noise_lines": f"""
WITH {_SAMPLE} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(shape AS INTEGER) AS shape, line
FROM shaped WHERE {_NOISE_SQL}""",
    "rule_headings": f"""
WITH {_SAMPLE} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(shape AS INTEGER) AS shape, line
FROM shaped WHERE {_HEADING_SQL}""",
    "heading_merge": f"WITH {_REC_LINES} SELECT document_id, page_number, pos, line FROM merged",
    "profile_headings": (
        f"WITH {_PROFILE} SELECT document_id, page_number, pos, title FROM profile"
    ),
    "profile_headings_skipped": (
        f"WITH {_PROFILE.replace('FROM merged WHERE', f'FROM merged WHERE page_number NOT IN {SKIPPED_PAGES} AND')} "
        "SELECT document_id, page_number, pos, title FROM profile"
    ),
    "section_ranges": f"""
WITH {_PROFILE},
o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, pos) AS n,
    lead(page_number) OVER (PARTITION BY document_id ORDER BY page_number, pos) AS nxt FROM profile),
last AS (SELECT conv_id::VARCHAR AS document_id, max(turn) + 1 AS lastp FROM conversations GROUP BY 1)
SELECT document_id, CAST(n AS INTEGER) AS ord, printf('section_%03d', n) AS section_id,
    title AS section_title, page_number AS start_page,
    CAST(coalesce(nxt - 1, lastp) AS INTEGER) AS end_page
FROM o JOIN last USING (document_id)""",
    "section_ranges_clamped": """
WITH h AS (SELECT conv_id::VARCHAR AS document_id, turn, turn // 2 + 1 AS page,
    string_split(text, chr(10))[1] AS title FROM conversations),
o AS (SELECT *, row_number() OVER w AS n, lead(page) OVER w AS nxt,
    max(page) OVER (PARTITION BY document_id) AS lastp FROM h
  WINDOW w AS (PARTITION BY document_id ORDER BY turn))
SELECT document_id, CAST(n AS INTEGER) AS ord, printf('sec_%03d', n) AS section_id,
    title AS section_title, CAST(page AS INTEGER) AS start_page,
    CAST(CASE WHEN nxt IS NULL THEN lastp ELSE greatest(page, nxt - 1) END AS INTEGER) AS end_page
FROM o""",
    "page_buckets": """
WITH p AS (SELECT conv_id::VARCHAR AS document_id, turn + 1 AS page,
    (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 + 1 AS n FROM conversations)
SELECT document_id, CAST(n AS INTEGER) AS ord, printf('sec_%03d', n) AS section_id,
    printf('Guideline Content (Pages %d-%d)', min(page), max(page)) AS section_title,
    CAST(min(page) AS INTEGER) AS start_page, CAST(max(page) AS INTEGER) AS end_page
FROM p GROUP BY document_id, n""",
    "first_occurrence": f"WITH {_FIRST} SELECT source, doc_id, pos, line FROM firsts",
    "excluded_titles": rf"""
WITH {_FIRST}, t AS (SELECT source, line,
    trim(regexp_replace(line, '\s+', ' ', 'g'), ':-. ') AS title FROM firsts)
SELECT source, line, title, regexp_matches(upper(title), 'ING|TION|EAU') AS by_word,
    upper(title) IN ('ING', 'TION', 'EAU') AS by_title FROM t""",
    "bookmark_headings": rf"""
WITH h AS (SELECT conv_id::VARCHAR AS document_id, turn, count(*) OVER (PARTITION BY conv_id) AS n,
    trim(regexp_replace({strip_sql("string_split(text, chr(10))[1]")}, '\s+', ' ', 'g'), ':-. ') AS title
  FROM conversations),
u AS (SELECT *, row_number() OVER (PARTITION BY document_id, title ORDER BY turn) AS r FROM h
  WHERE n >= 3 AND title <> '' AND len(title) < 140
    AND NOT regexp_matches(upper(title), '{"|".join(K.EXCLUDED_TITLE_WORDS)}'))
SELECT document_id, CAST(turn + 1 AS INTEGER) AS page_number, CAST(turn AS INTEGER) AS ord, title
FROM u WHERE r = 1""",
    "html_block_text": f"""
WITH {_LAYOUT.rstrip().rstrip(',')}
SELECT url AS document_id, CAST(block_no AS INTEGER) AS block_no, tag, bold = 'b' AS bold, txt AS text FROM blocks""",
    "body_size_mode": f"WITH {_LAYOUT} SELECT url AS document_id, body_size FROM body",
    "layout_headings": f"""
WITH {_HEADS} SELECT url AS document_id, CAST(1 AS INTEGER) AS page_number,
    CAST(block_no AS INTEGER) AS block_no, title FROM usable WHERE r = 1""",
    "html_headings": f"""
WITH {_HEADS},
toc AS (SELECT url, block_no AS i, trim(regexp_replace(txt, '\\s+', ' ', 'g'), ':-. ') AS title,
    count(*) OVER (PARTITION BY url) AS n FROM blocks WHERE tag <> 'p'),
s1 AS (SELECT url, 1 AS src, min(i) AS place, title FROM toc WHERE n >= 3 AND title <> ''
    AND len(title) < 140
    AND NOT regexp_matches(upper(title), '{"|".join(K.EXCLUDED_TITLE_WORDS)}') GROUP BY url, title),
settled AS (SELECT url FROM s1 GROUP BY url HAVING count(*) >= 4),
s12 AS (SELECT * FROM s1 UNION ALL SELECT url, 2, block_no, title FROM usable WHERE r = 1
    AND url NOT IN (SELECT url FROM settled)
    AND (url, title) NOT IN (SELECT (url, title) FROM s1)),
n12 AS (SELECT p.url, count(s12.title) AS n FROM (SELECT DISTINCT url FROM pages) p
    LEFT JOIN s12 USING (url) GROUP BY p.url),
s3 AS (SELECT url, 3 AS src, min(block_no) AS place, trim(line, ':-. ') AS title
  FROM lines JOIN n12 USING (url) WHERE n < 3 AND {_HEADING_SQL} AND len(trim(line, ':-. ')) < 140
  GROUP BY url, trim(line, ':-. ')),
s123 AS (SELECT * FROM s12 UNION ALL SELECT * FROM s3
    WHERE (url, title) NOT IN (SELECT (url, title) FROM s12)),
n123 AS (SELECT url, count(*) AS n FROM s123 GROUP BY url)
SELECT url AS document_id, CAST(o AS INTEGER) AS ord, printf('sec_%03d', o) AS section_id,
    title AS section_title, CAST(1 AS INTEGER) AS start_page, CAST(1 AS INTEGER) AS end_page
FROM (SELECT s123.*, row_number() OVER (PARTITION BY url ORDER BY src, place) AS o
      FROM s123 JOIN n123 USING (url) WHERE n >= 2)
UNION ALL
SELECT url, 1, 'sec_001', 'Guideline Content (Pages 1-1)', 1, 1
FROM (SELECT DISTINCT url FROM blocks) LEFT JOIN n123 USING (url) WHERE coalesce(n, 0) < 2
""",
}
