"""Chunk checks.

Every check yields issue rows ``level, check, chunk_id, message``.  Checks that
look at one chunk run in a single pass over the table; the others shuffle only
keys, counts or short lines.

``chunks`` is the chunk schema plus ``ord``, a unique row order.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.arrays import each
from ..functions.text import let, percent, strip, stripped_lines, whole
from ..functions.tokens import word_count
from ..session import settle
from .arrow import map_column
from .duplicates import near_duplicates
from .ordered import lag_in_order, top_k

ISSUE = "struct<level:string,check:string,chunk_id:string,message:string>"
CHUNK_BUCKET = 1024
HASH_BASE = 0x9E3779B97F4A7C15
HASH_BITS = 16


def _issue(level: str, check: str, message: Column, unnamed: str = "<unknown>") -> Column:
    return F.struct(
        F.lit(level).alias("level"),
        F.lit(check).alias("check"),
        F.coalesce("chunk_id", F.lit(unnamed)).alias("chunk_id"),
        message.alias("message"),
    )


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _str(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# -- checks of one row: each returns (condition, issue) pairs -----------------


def missing_field() -> list[tuple[Column, Column]]:
    return [
        (
            F.col(f).isNull(),
            _issue(
                "ERROR", "missing_field", F.lit(f"Missing required field '{f}'"),
                "<missing chunk_id>",
            ),
        )
        for f in K.REQUIRED_FIELDS
    ]


def empty_chunk() -> list[tuple[Column, Column]]:
    return [
        (
            strip(_text()) == "",
            _issue("ERROR", "empty_chunk", F.lit("Chunk text is empty or whitespace-only")),
        )
    ]


def chunk_id_format() -> list[tuple[Column, Column]]:
    name = F.coalesce("chunk_id", F.lit(""))
    return [
        (
            (name != "") & ~name.rlike(K.CHUNK_ID_PATTERN.replace(r"\d", r"\p{Nd}")),
            _issue(
                "WARNING", "chunk_id_format",
                _cat(
                    "chunk_id '", name,
                    "' doesn't match expected pattern '<doc>_NNN_section_NNN_cNNN'",
                ),
            ),
        )
    ]


def page_numbers(schema: T.StructType | None = None) -> list[tuple[Column, Column]]:
    """Type, range and order of pages.  Raw input may hold them as strings."""
    start, end = F.col("page_start"), F.col("page_end")
    given = start.isNotNull() & end.isNotNull()
    raw = schema is not None and isinstance(schema["page_start"].dataType, T.StringType)
    if raw:
        whole = start.rlike(r"^[+-]?\d+$") & end.rlike(r"^[+-]?\d+$")
        start, end = F.expr("try_cast(page_start as int)"), F.expr("try_cast(page_end as int)")
    else:
        whole = F.lit(True)
    return [
        (
            given & ~whole,
            _issue("ERROR", "page_number_type", F.lit("page_start/page_end must be integers")),
        ),
        (
            given & whole & ((start < 1) | (end < 1)),
            _issue("ERROR", "page_number_range", F.lit("page_start/page_end must be >= 1")),
        ),
        (
            given & whole & (end < start),
            _issue(
                "ERROR", "page_order",
                _cat("page_end (", end, ") is before page_start (", start, ")"),
            ),
        ),
    ]


def token_count_mismatch(counted: Column | None = None) -> list[tuple[Column, Column]]:
    """``counted`` is the recount; words by default."""
    def mismatch(actual: Column) -> Column:
        drift = F.abs(actual - F.col("token_count")) / actual
        return F.when(
            F.col("token_count").isNotNull() & (actual > 0) & (drift > K.TOKEN_DRIFT),
            _issue(
                "WARNING", "token_count_mismatch",
                _cat(
                    "stored token_count=", F.col("token_count"), " vs recomputed=", actual,
                    " (drift ", percent(drift), ", tolerance 10%)",
                ),
            ),
        )

    actual = counted if counted is not None else word_count(_text())
    # The text is counted once, not for each place the count is used in.
    return [(F.col("token_count").isNotNull(), let(actual, mismatch))]


def token_bounds(
    minimum: int = K.MIN_TOKENS, maximum: int = K.MAX_TOKENS
) -> list[tuple[Column, Column]]:
    n = F.col("token_count")
    return [
        (
            n < minimum,
            _issue(
                "WARNING", "below_min_tokens",
                _cat("token_count=", n, f" is below MIN_TOKENS={minimum}"),
            ),
        ),
        (
            n > maximum,
            _issue(
                "WARNING", "above_max_tokens",
                _cat("token_count=", n, f" exceeds MAX_TOKENS={maximum}"),
            ),
        ),
    ]


def excluded_section_leak(
    excluded: Iterable[str] = K.EXCLUDED_SECTIONS,
) -> list[tuple[Column, Column]]:
    title = F.upper(strip(F.coalesce("section_title", F.lit(""))))
    return [
        (
            title.isin(list(excluded)),
            _issue(
                "ERROR", "excluded_section_leak",
                _cat(
                    "Chunk belongs to excluded section '", title,
                    "' (REFERENCES/ANNEXES should not reach the chunk table)",
                ),
            ),
        )
    ]


def excluded_content_leak(
    excluded: Iterable[str] = K.EXCLUDED_SECTIONS,
) -> list[tuple[Column, Column]]:
    names = list(excluded)
    line = F.get(F.filter(stripped_lines(_text()), lambda x: F.upper(x).isin(names)), 0)
    title = F.coalesce("section_title", F.lit(""))

    def leak(found: Column) -> Column:
        return F.when(
            found.isNotNull(),
            _issue(
                "ERROR", "excluded_content_leak",
                _cat(
                    "Chunk (section '", title, "') contains a line matching an excluded "
                    "section title ('", found, "') — likely REFERENCES/ANNEXES content bled "
                    "in due to page-level boundary rounding",
                ),
            ),
        )

    return [(~F.upper(title).isin(names), let(line, leak))]


def standalone_page_number() -> list[tuple[Column, Column]]:
    found = F.regexp_extract_all(_text(), F.lit(r"(?mdU)^\s*\d{1,4}\s*$"), 0)
    shown = F.transform(
        F.slice(found, 1, 5),
        lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("'")),
    )
    return [
        (
            F.size(found) > 0,
            _issue(
                "WARNING", "standalone_page_number",
                _cat(
                    "Found ", F.size(found), " standalone numeric line(s) that look like "
                    "stray page numbers: [", F.array_join(shown, ", "), "]",
                ),
            ),
        )
    ]


def broken_bullet() -> list[tuple[Column, Column]]:
    text = _text()
    return [
        (
            text.rlike(r"(?mdU)^\s*\[\s*$") | text.rlike(r"(?mdU)^\[\s+\S"),
            _issue(
                "WARNING", "broken_bullet_artifact",
                F.lit("Text contains raw '[' bullet artifacts from PDF extraction"),
            ),
        )
    ]


def irregular_whitespace() -> list[tuple[Column, Column]]:
    return [
        (
            _text().rlike(r"[ \t]{4,}"),
            _issue(
                "INFO", "irregular_whitespace",
                F.lit("Chunk contains runs of 4+ spaces/tabs, check for extraction artifacts"),
            ),
        )
    ]


def short_text() -> list[tuple[Column, Column]]:
    size = F.length(strip(_text()))
    return [
        (
            (_text() != "") & (size < K.SHORT_TEXT_CHARS),
            _issue(
                "ERROR", "suspiciously_short_text",
                _cat("Chunk text is only ", size, " characters"),
            ),
        )
    ]


def row_issues(chunks: DataFrame, checks: list[tuple[Column, Column]]) -> DataFrame:
    """Run checks of one row in one pass; rows without issues emit nothing.

    An issue may be null where its condition is not the whole test.
    """
    found = F.array_compact(F.array(*[F.when(cond, issue) for cond, issue in checks]))
    return each(chunks, [], found, "i").select("i.*")


# -- checks across rows -------------------------------------------------------


def duplicate_chunk_id(chunks: DataFrame) -> DataFrame:
    """One issue for the second and every later row of an id.

    Only repeated ids (one row each, reduced before the shuffle) are joined
    back, so the rows of a repeated id need not meet in one task: the join can
    be a broadcast, and adaptive execution can split a hot id.
    """
    rows = chunks.where(F.coalesce("chunk_id", F.lit("")) != "").select("chunk_id", "ord")
    repeated = (
        rows.groupBy("chunk_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("_first"))
        .where(F.col("n") > 1)
    )
    later = rows.join(repeated, "chunk_id").where(F.col("ord") > F.col("_first"))
    return later.select(
        F.lit("ERROR").alias("level"),
        F.lit("duplicate_chunk_id").alias("check"),
        "chunk_id",
        F.lit("chunk_id is not unique").alias("message"),
    )


def unknown_section(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    named = chunks.where(F.coalesce("section_id", F.lit("")) != "").select(
        "document_id", "section_id", "chunk_id"
    )
    lost = named.join(
        sections.select("document_id", "section_id").distinct(),
        ["document_id", "section_id"],
        "left_anti",
    )
    return lost.select(
        _issue(
            "ERROR", "unknown_section_id",
            _cat("section_id '", F.col("section_id"), "' not found in the section table"),
        ).alias("i")
    ).select("i.*")


def running_header_leak(
    chunks: DataFrame,
    sections: DataFrame | None,
    headers: Iterable[str] = K.HEADING_RUNNING_HEADERS,
    prefix: str = K.TITLE_PREFIX,
) -> DataFrame:
    """First line that is a known header or the title of another section."""
    names = list(headers)
    lines = stripped_lines(_text())

    def is_header(x: Column) -> Column:
        test = F.upper(x).isin(names)
        return test | F.upper(x).startswith(prefix) if prefix else test

    if sections is None:
        marked = F.filter(
            F.transform(lines, lambda x, i: F.when(is_header(x), F.struct(i.alias("pos"), x.alias("line")))),
            lambda s: s.isNotNull(),
        )
        known = (
            chunks.select("ord", "chunk_id", F.get(marked, 0).alias("m"))
            .where(F.col("m").isNotNull())
            .select(
                "ord", "chunk_id", F.col("m.pos").alias("pos"), F.lit(0).alias("kind"),
                F.col("m.line").alias("line"),
            )
        )
    else:
        titles = sections.select(
            "document_id",
            F.upper(strip(F.coalesce("section_title", F.lit("")))).alias("_upper"),
        ).distinct().withColumn("_titled", F.lit(True))
        own = F.upper(strip(F.coalesce("section_title", F.lit(""))))
        # The lines are cut once for both tests.
        exploded = each(
            chunks, ["ord", "chunk_id", "document_id", own.alias("_own")], lines, "line", "pos"
        ).withColumn("_upper", F.upper("line"))
        other = F.col("_titled") & (F.col("_upper") != F.col("_own"))
        known = (
            exploded.join(titles, ["document_id", "_upper"], "left")
            .withColumn("kind", F.when(is_header(F.col("line")), 0).when(other, 1))
            .where(F.col("kind").isNotNull())
            .select("ord", "chunk_id", "pos", "kind", "line")
        )
    first = known.groupBy("ord", "chunk_id").agg(
        F.min(F.struct("pos", "kind", "line")).alias("m")
    )
    message = F.when(
        F.col("m.kind") == 0,
        _cat("Possible running header/title leaked into chunk text: '", F.col("m.line"), "'"),
    ).otherwise(
        _cat(
            "Heading '", F.col("m.line"), "' from a different section appears inside this "
            "chunk — likely page-header bleed across a section boundary",
        )
    )
    return first.select(_issue("WARNING", "running_header_leak", message).alias("i")).select("i.*")


def duplicate_text(chunks: DataFrame, **options) -> DataFrame:
    found = near_duplicates(chunks, **options)
    return found.select(
        _issue(
            "ERROR", "duplicate_chunk_text",
            _cat(
                "Near-duplicate text (ratio=", F.format_string("%.2f", "ratio"),
                ") with chunk '", F.coalesce("other_id", F.lit("<unknown>")), "'",
            ),
        ).alias("i")
    ).select("i.*")


def _piece_hashes(text: str, size: int) -> np.ndarray:
    """A hash of each piece of ``size`` characters, joined from halves."""
    made = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    whole_, done = None, 0
    width = 1
    while True:
        if size & width:
            if whole_ is None:
                whole_, done = made, width
            else:
                count = len(text) - done - width + 1
                whole_ = whole_[:count] * _power(width) + made[done : done + count]
                done += width
        width *= 2
        if width > size:
            return whole_
        half = width // 2
        made = made[: len(made) - half] * _power(half) + made[half:]


def _power(width: int) -> np.uint64:
    return np.uint64(pow(HASH_BASE, width, 1 << 64))


def _longest_common(a: str, b: str, least: int) -> int:
    """Length of the longest common substring, 0 when below ``least``.

    A common substring begins with a common piece of ``least`` characters, so
    only starts of pieces with a hash that ``a`` may have are tried, each for a
    match that is longer than the best so far.
    """
    if len(a) < least or len(b) < least:
        return 0
    known = np.zeros(1 << HASH_BITS, dtype=bool)
    known[_piece_hashes(a, least) >> np.uint64(64 - HASH_BITS)] = True
    starts = np.flatnonzero(known[_piece_hashes(b, least) >> np.uint64(64 - HASH_BITS)])
    best = least - 1
    for start in starts.tolist():
        while start + best < len(b) and (at := a.find(b[start : start + best + 1])) >= 0:
            best += 1
            while at + best < len(a) and start + best < len(b) and a[at + best] == b[start + best]:
                best += 1
    return best if best >= least else 0


def neighbour_overlaps(chunks: DataFrame, bucket_rows: int = CHUNK_BUCKET) -> DataFrame:
    """Shared text of neighbouring chunks of a section:
    ``document_id, section_id, chunk_id, previous_id, chars, tokens, share``."""
    window = K.OVERLAP_WINDOW_CHARS
    ends = chunks.select(
        "document_id",
        "section_id",
        "ord",
        "chunk_id",
        F.left(_text(), F.lit(window)).alias("_head"),
        F.struct(
            "chunk_id",
            F.right(_text(), F.lit(window)).alias("tail"),
            F.coalesce(F.nullif("token_count", F.lit(0)), word_count(_text())).alias("n"),
        ).alias("_me"),
        F.floor(F.col("ord") / bucket_rows).alias("_bucket"),
    )
    paired = lag_in_order(
        ends, ["document_id", "section_id"], "_bucket", ["ord"], "_me", "_previous",
        null_keys=True,
    ).where(F.col("_previous").isNotNull())
    measured = map_column(
        paired.select(
            "document_id",
            "section_id",
            "chunk_id",
            F.col("_previous.chunk_id").alias("previous_id"),
            F.least("_me.n", "_previous.n").alias("_smaller"),
            F.col("_previous.tail").alias("_tail"),
            "_head",
        ),
        "chars",
        T.IntegerType(),
        ["_tail", "_head"],
        lambda tail, head: _longest_common(tail, head, K.OVERLAP_MIN_CHARS),
    ).where(F.col("chars") >= K.OVERLAP_MIN_CHARS)
    smaller = F.greatest(F.col("_smaller"), F.lit(1))
    tokens = F.col("chars") / K.CHARS_PER_TOKEN
    return measured.select(
        "document_id",
        "section_id",
        "chunk_id",
        "previous_id",
        "chars",
        tokens.alias("tokens"),
        (tokens / smaller).alias("share"),
    )


def overlap_issues(overlaps: DataFrame) -> DataFrame:
    share = F.col("share")
    level = (
        F.when(share >= K.OVERLAP_ERROR, "ERROR")
        .when(share >= K.OVERLAP_WARNING, "WARNING")
        .otherwise("INFO")
    )
    message = _cat(
        "~", F.col("chars"), " chars (~", whole(F.col("tokens")), " tokens, ",
        percent(share), " of the smaller neighboring chunk) shared between tail of '",
        F.col("previous_id"), "' and head of this chunk",
        F.when(
            share >= K.OVERLAP_ERROR,
            " — well beyond typical overlap, check the overlap setting",
        ).otherwise(""),
    )
    return overlaps.select(
        level.alias("level"),
        F.when(share >= K.OVERLAP_WARNING, "excessive_overlap")
        .otherwise("measured_overlap")
        .alias("check"),
        F.coalesce("chunk_id", F.lit("<unknown>")).alias("chunk_id"),
        message.alias("message"),
    )


def section_boundary_leak(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunk pages outside the pages of their section."""
    bounds = sections.select("document_id", "section_id", "start_page", "end_page")
    joined = chunks.select("chunk_id", "document_id", "section_id", "page_start", "page_end").join(
        bounds, ["document_id", "section_id"]
    )
    return row_issues(
        joined,
        [
            (
                F.col("page_start") < F.col("start_page"),
                _issue(
                    "WARNING", "section_boundary_leak",
                    _cat(
                        "Chunk page_start (", F.col("page_start"),
                        ") precedes its section's page_start (", F.col("start_page"),
                        ") — possible bleed from previous section",
                    ),
                ),
            ),
            (
                F.col("page_end") > F.col("end_page"),
                _issue(
                    "WARNING", "section_boundary_leak",
                    _cat(
                        "Chunk page_end (", F.col("page_end"),
                        ") exceeds its section's page_end (", F.col("end_page"),
                        ") — possible bleed into next section",
                    ),
                ),
            ),
        ],
    )


# -- all checks, report and gate ----------------------------------------------


def validate(
    chunks: DataFrame,
    sections: DataFrame | None = None,
    minimum: int = K.MIN_TOKENS,
    maximum: int = K.MAX_TOKENS,
    excluded: Iterable[str] = K.EXCLUDED_SECTIONS,
    headers: Iterable[str] = K.HEADING_RUNNING_HEADERS,
    prefix: str = K.TITLE_PREFIX,
    boundary_check: bool = True,
) -> DataFrame:
    """All issues of a chunk table.

    Section checks are skipped when there are no sections (one row is read to
    find out).  ``boundary_check=False`` leaves out the section page check.
    Each check reads the chunks, so they are written once first.
    """
    chunks = settle(chunks, "chunks")
    sections = settle(sections, "sections") if sections is not None else None
    local = (
        missing_field() + empty_chunk() + chunk_id_format() + page_numbers(chunks.schema)
        + token_count_mismatch() + token_bounds(minimum, maximum)
        + excluded_section_leak(excluded) + excluded_content_leak(excluded)
        + standalone_page_number() + broken_bullet() + irregular_whitespace() + short_text()
    )
    known = sections if sections is not None and not sections.isEmpty() else None
    issues = (
        row_issues(chunks, local)
        .unionByName(duplicate_chunk_id(chunks))
        .unionByName(running_header_leak(chunks, known, headers, prefix))
        .unionByName(duplicate_text(chunks))
        .unionByName(overlap_issues(neighbour_overlaps(chunks)))
    )
    if known is not None:
        issues = issues.unionByName(unknown_section(chunks, known))
        if boundary_check:
            issues = issues.unionByName(section_boundary_leak(chunks, known))
    return issues


def summary(chunks: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: ``total_chunks, error_count, warning_count, info_count``."""
    counts = chunks.select(F.lit("total").alias("level")).unionByName(issues.select("level"))

    def count(level: str, name: str) -> Column:
        return F.count(F.when(F.col("level") == level, 1)).alias(name)

    return counts.agg(
        count("total", "total_chunks"),
        count("ERROR", "error_count"),
        count("WARNING", "warning_count"),
        count("INFO", "info_count"),
    )


def by_check(issues: DataFrame, samples: int = 5) -> DataFrame:
    """``check, level, n, more, samples``: the first issues of each check."""
    counts = issues.groupBy("check").agg(
        F.count(F.lit(1)).alias("n"), F.min("level").alias("level")
    )
    first = top_k(issues, ["check"], [F.asc("chunk_id"), F.asc("message")], samples, "_rank")
    shown = first.groupBy("check").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", "chunk_id", "message"))),
            lambda s: F.concat(F.lit("["), s["chunk_id"], F.lit("] "), s["message"]),
        ).alias("samples")
    )
    return counts.join(shown, "check").select(
        "check",
        "level",
        "n",
        F.greatest(F.lit(0).cast("bigint"), F.col("n") - samples).alias("more"),
        "samples",
    )


def has_errors(issues: DataFrame) -> bool:
    """Whether any issue blocks publishing; stops at the first one found."""
    return not issues.where(F.col("level") == "ERROR").isEmpty()
