"""Token-bounded chunks with page spans.

Windows over ``n`` tokens have a closed form, so nothing is scanned in order:
window ``j`` covers tokens ``[S*j, S*j + T)`` with ``S = T - overlap``, and only
the last window can be short.  When the last one is below the minimum and fits,
it is appended to its predecessor (overlap included).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.arrays import each
from ..functions.text import let, strip
from ..functions.tokens import Tokenizer, WordTokenizer, word_count, word_pieces
from .arrow import map_column
from .ordered import running_sums

PAGE_BUCKET = 256
CHUNK_LIST = T.ArrayType(
    T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("n_tokens", T.IntegerType())]
    )
)


@dataclass(frozen=True)
class ChunkSize:
    target: int = K.TARGET_TOKENS
    maximum: int = K.MAX_TOKENS
    minimum: int = K.MIN_TOKENS
    overlap: int = K.OVERLAP_TOKENS

    @property
    def step(self) -> int:
        return self.target - self.overlap if self.overlap < self.target else self.target

    @property
    def advance(self) -> int:
        """How far the page cursor moves after a full window."""
        return self.target - self.overlap if self.overlap < self.target else self.target

    @property
    def closed_form(self) -> bool:
        """A target below the minimum lets merges cascade; then windows are scanned."""
        return self.target >= self.minimum

    def windows(self, n: Column) -> Column:
        """Windows before merging (1 when the text fits one chunk)."""
        more = F.ceil((n - self.target) / F.lit(float(self.step))).cast("bigint") + 1
        return F.when(n <= self.maximum, F.lit(1)).otherwise(
            F.greatest(more, F.lit(1))
        ).cast("bigint")

    def merged(self, n: Column, windows: Column) -> Column:
        """Whether the last window joins its predecessor."""
        tail = n - (windows - 1) * self.step
        return (
            (windows > 1) & (tail < self.minimum) & (tail + self.target <= self.maximum)
        )


DEFAULT_SIZE = ChunkSize()


def _window_slices(pieces: Column, n: Column, size: ChunkSize) -> Column:
    def slices(k: Column) -> Column:
        merged = size.merged(n, k)
        last = k - F.when(merged, 2).otherwise(1)

        def one(j: Column) -> Column:
            start = (j * size.step + 1).cast("int")
            base = F.slice(pieces, start, size.target)
            tail = F.slice(pieces, (start + size.step).cast("int"), size.target)
            return F.when(merged & (j == last), F.concat(base, tail)).otherwise(base)

        return F.transform(F.sequence(F.lit(0).cast("bigint"), last), one)

    return let(size.windows(n), slices)


def chunk_array(text: Column, size: ChunkSize = DEFAULT_SIZE) -> Column:
    """``array<struct<text, n_tokens>>`` of one text, words as tokens.

    Evaluated inside the JVM; the text is one row, so this is for texts that
    are rows anyway.  Sections that span many pages use ``build_chunks``.
    """

    return let(word_pieces(text), lambda pieces: _chunked(text, pieces, size))


def _chunked(text: Column, pieces: Column, size: ChunkSize) -> Column:
    n = F.size(pieces)
    whole = F.array(
        F.struct(strip(text).alias("text"), n.cast("int").alias("n_tokens"))
    )
    many = F.transform(
        _window_slices(pieces, n.cast("bigint"), size),
        lambda w: F.struct(
            strip(F.array_join(w, "")).alias("text"), F.size(w).alias("n_tokens")
        ),
    )
    return (
        F.when(n == 0, F.array().cast("array<struct<text:string,n_tokens:int>>"))
        .when(n <= size.maximum, whole)
        .otherwise(many)
    )


def _cut(tokens: list[int], size: ChunkSize) -> list[list[int]]:
    """Windows of any tokens.

    Window k begins at k times the step, and the first one that reaches the end
    is the last.  From the right, a window below the minimum joins its left
    neighbour if both fit into the maximum.
    """
    if not tokens:
        return []
    steps = max(0, -(-(len(tokens) - size.target) // size.step))
    windows = [tokens[k * size.step : k * size.step + size.target] for k in range(steps + 1)]
    for at in range(steps, 0, -1):
        left, right = windows[at - 1 : at + 1]
        if len(right) < size.minimum and len(left) + len(right) <= size.maximum:
            windows[at - 1 : at + 1] = [left + right]
    return windows


def chunk_with(tokenizer: Tokenizer, text: str, size: ChunkSize) -> list[tuple[str, int]]:
    tokens = tokenizer.encode(text)
    if not tokens:
        return []
    if len(tokens) <= size.maximum:
        parts = [text.strip()]
    else:
        parts = [tokenizer.decode(w).strip() for w in _cut(tokens, size)]
    return [(p, len(tokenizer.encode(p))) for p in parts]


def split_into_chunks(
    df: DataFrame,
    text: str = "text",
    size: ChunkSize = DEFAULT_SIZE,
    tokenizer: Tokenizer | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per chunk of each text: ``keep..., chunk_no (from 1), text, token_count``."""
    if tokenizer is None and size.closed_form:
        rows = df.select(*keep, chunk_array(F.col(text), size).alias("_chunks"))
    else:
        tool = tokenizer or WordTokenizer()
        rows = map_column(
            df.select(*keep, F.col(text).alias("_text")),
            "_chunks",
            CHUNK_LIST,
            ["_text"],
            lambda t: [{"text": p, "n_tokens": n} for p, n in chunk_with(tool, t or "", size)],
        )
    return each(rows, keep, "_chunks", "_chunk").select(
        *keep,
        (F.col("_pos") + 1).alias("chunk_no"),
        F.col("_chunk.text").alias("text"),
        F.col("_chunk.n_tokens").alias("token_count"),
    )


def split_into_sizes(
    df: DataFrame, sizes: Sequence[ChunkSize], text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """As :func:`split_into_chunks` for several sizes at once, words as tokens:
    adds ``size_no``, the place of a chunk's size (from 0).

    A text is cut into words once for all sizes.
    """
    if not all(size.closed_form for size in sizes):
        parts = [split_into_chunks(df, text, s, keep=keep).withColumn("size_no", F.lit(n)) for n, s in enumerate(sizes)]
        return reduce(DataFrame.unionByName, parts)
    whole = F.col(text)

    def chunked(pieces: Column) -> Column:
        def numbered(size_no: int, size: ChunkSize) -> Column:
            return F.transform(
                _chunked(whole, pieces, size),
                lambda c, i: F.struct(F.lit(size_no).alias("size_no"), (i + 1).alias("chunk_no"), c.alias("c")),
            )

        return F.concat(*(numbered(n, size) for n, size in enumerate(sizes)))

    rows = df.select(*keep, let(word_pieces(whole), chunked).alias("_chunks"))
    return each(rows, keep, "_chunks", "_chunk").select(
        *keep,
        F.col("_chunk.chunk_no").alias("chunk_no"),
        F.col("_chunk.c.text").alias("text"),
        F.col("_chunk.c.n_tokens").alias("token_count"),
        F.col("_chunk.size_no").alias("size_no"),
    )


PAGE_BUCKET = 64


def section_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Each section with its pages: equality on the document and on a bucket of
    pages, then the range.

    A section is repeated for each bucket it reaches into, so a page meets the
    sections near it only, and a document with very many pages and sections is
    spread over its buckets.
    """
    s = sections.where(F.col("start_page") <= F.col("end_page")).select(
        "document_id",
        "section_id",
        "section_title",
        "start_page",
        "end_page",
        F.explode(
            F.sequence(
                F.floor(F.col("start_page") / PAGE_BUCKET), F.floor(F.col("end_page") / PAGE_BUCKET)
            )
        ).alias("_bucket"),
    )
    p = pages.withColumn("_bucket", F.floor(F.col("page_number") / PAGE_BUCKET))
    inside = F.col("page_number").between(F.col("start_page"), F.col("end_page"))
    return (
        p.join(s, ["document_id", "_bucket"])
        .where(inside)
        .select("document_id", "section_id", "section_title", "page_number", "text")
    )


def trim_section_lines(
    paged: DataFrame, excluded: tuple[str, ...] = K.EXCLUDED_SECTIONS
) -> DataFrame:
    """Cut each section at its first excluded line and drop title repeats.

    Works page by page: two minima per section are reduced first, so a section
    is never put together for it.  Column ``text`` is replaced; ``raw`` keeps
    the page text, which the page cursor counts.  Pages past the cut have a
    null ``text``.
    """
    lines = F.split(strip(F.col("text")), "\n", -1)
    upper = F.transform(lines, lambda x: F.upper(strip(x)))
    title = F.upper(strip(F.col("section_title")))
    marked = paged.withColumn("_lines", lines).withColumn("_upper", upper)
    keys = ["document_id", "section_id"]
    first_cut = F.array_position(
        F.transform("_upper", lambda x: x.isin(list(excluded))), True
    )
    first_title = F.array_position("_upper", title)
    marks = marked.select(
        *keys,
        F.when(first_cut > 0, F.struct("page_number", first_cut.alias("at"))).alias("cut"),
        F.when(first_title > 0, F.struct("page_number", first_title.alias("at"))).alias("title"),
    )
    marks = marks.where(F.col("cut").isNotNull() | F.col("title").isNotNull())
    bounds = marks.groupBy(*keys).agg(F.min("cut").alias("_cut"), F.min("title").alias("_title"))
    joined = marked.join(bounds, keys, "left")
    here = F.col("page_number")
    limit = F.when(
        F.col("_cut").isNull() | (here < F.col("_cut.page_number")), F.size("_lines")
    ).otherwise(F.col("_cut.at") - 1)
    kept = F.filter(
        F.arrays_zip(F.col("_lines").alias("line"), F.col("_upper").alias("upper")),
        lambda x, i: (i < F.col("_limit"))
        & (
            (x["upper"] != title)
            | ((here == F.col("_title.page_number")) & (i + 1 == F.col("_title.at")))
        ),
    )
    past = F.coalesce(here > F.col("_cut.page_number"), F.lit(False))
    return joined.withColumn("_limit", limit).select(
        *keys,
        "section_title",
        "page_number",
        F.when(~past, F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("text"),
        F.col("text").alias("raw"),
    )


def section_text(paged: DataFrame) -> DataFrame:
    """One row per section with its text, for sections that fit a row.

    ``build_chunks`` does not use it; it serves plug-in tokenizers and readers
    that want the text itself.
    """
    pages = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return paged.groupBy("document_id", "section_id", "section_title").agg(
        F.array_join(
            F.filter(F.transform(pages, lambda p: strip(p["text"])), lambda t: t != ""), "\n\n"
        ).alias("text")
    )


def build_chunks(
    paged: DataFrame,
    size: ChunkSize = DEFAULT_SIZE,
    page_bucket: int = PAGE_BUCKET,
) -> DataFrame:
    """Chunks of sections that may be any number of pages long.

    ``paged`` is ``document_id, section_id, section_title, page_number, text``
    (+ ``raw``, the page text counted by the page cursor; default ``text``).

    Every page finds its token offset by a bucketed running sum and hands the
    part of its words that lies in each window to that window, so the largest
    group is one chunk.  Result: ``document_id, section_id, section_title,
    chunk_no, page_start, page_end, token_count, text``.
    """
    if not size.closed_form:
        raise ValueError("target below minimum: use split_into_chunks on section texts")
    keys = ["document_id", "section_id"]
    trimmed = "raw" in paged.columns
    raw = F.col("raw") if trimmed else F.col("text")
    body = F.col("text") if trimmed else strip(F.col("text"))
    # pages are joined by a blank line; blank pages are left out
    spaced = F.when(F.col("text").isNull() | (strip(raw) == ""), F.lit("")).otherwise(
        F.concat(body, F.lit("\n\n"))
    )
    pages = paged.select(
        *keys,
        "section_title",
        "page_number",
        spaced.alias("_spaced"),
        word_count(spaced).cast("bigint").alias("_n"),
        word_count(raw).cast("bigint").alias("_raw"),
        (F.col("page_number") / page_bucket).cast("int").alias("_bucket"),
    )
    placed = running_sums(pages, keys, "_bucket", ["page_number"], {"tok": "_n", "raw": "_raw"})
    n, total = F.col("tok_total"), F.col("raw_total")
    k, last = F.col("_k"), F.col("_last")
    step, target = size.step, size.target
    laid = (
        placed.where(n > 0)
        .withColumn("_k", size.windows(n))
        .withColumn("_merged", size.merged(n, F.col("_k")))
        .withColumn("_last", k - F.when(F.col("_merged"), 2).otherwise(1))
        .withColumn("_pieces", word_pieces(F.col("_spaced")))
    )
    single = k == 1
    start, end = F.col("tok_before"), F.col("tok_before") + F.col("_n")
    none = F.array().cast("array<bigint>")

    def numbers(low: Column, high: Column) -> Column:
        low = F.greatest(F.lit(0).cast("bigint"), low)
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    def part(j: Column) -> Column:
        """Words of this page inside window ``j``."""
        low = F.when(single, F.lit(0).cast("bigint")).otherwise(j * step)
        high = F.when(single, n).otherwise(F.least(j * step + target, n))
        from_, to = F.greatest(low, start), F.least(high, end)
        words = F.array_join(
            F.slice(
                "_pieces",
                (from_ - start + 1).cast("int"),
                F.greatest(to - from_, F.lit(0)).cast("int"),
            ),
            "",
        )
        blank_between = (F.col("_n") == 0) & (low < start) & (start < high)
        return F.struct(
            F.least(j, last).alias("chunk"),
            F.when(
                (words != "") | blank_between,
                F.struct(
                    j.alias("window"),
                    F.col("page_number").alias("page"),
                    F.when(blank_between, F.col("_spaced")).otherwise(words).alias("words"),
                ),
            ).alias("words"),
            F.lit(None).cast("int").alias("start"),
            F.lit(None).cast("int").alias("end"),
        )

    windows = F.when(single, F.array(F.lit(0).cast("bigint"))).otherwise(
        numbers(
            F.ceil((start - target + 1) / F.lit(float(step))),
            F.least(k - 1, F.floor((F.greatest(end, start + 1) - 1) / F.lit(float(step)))),
        )
    )

    # The page cursor moves by a fixed amount per chunk, so each page knows
    # which chunks start or end inside it.
    raw_start, raw_end = F.col("raw_before"), F.col("raw_before") + F.col("_raw")
    adv = float(size.advance)

    def tokens_of(j: Column) -> Column:
        tail = n - (k - 1) * step
        return (
            F.when(single, n)
            .when((j == last) & F.col("_merged"), tail + target)
            .when(j == k - 1, tail)
            .otherwise(F.lit(target))
        )

    def span(j: Column) -> Column:
        at = F.least(total, j * size.advance)
        final = F.least(at + tokens_of(j) - 1, total - 1)
        page = F.col("page_number")
        return F.struct(
            j.alias("chunk"),
            F.lit(None).cast("struct<window:bigint,page:int,words:string>").alias("words"),
            F.when((at >= raw_start) & (at < raw_end), page).alias("start"),
            F.when((final >= raw_start) & (final < raw_end), page).alias("end"),
        )

    reach = target + size.maximum  # no chunk is longer
    cursors = F.when(F.col("_raw") == 0, none).otherwise(
        numbers(F.floor((raw_start - reach) / adv), F.least(last, F.floor(raw_end / adv)))
    )
    given = each(
        laid,
        [*keys, "section_title", F.col("page_number").alias("_page")],
        F.concat(F.transform(windows, part), F.transform(cursors, span)),
        "_p",
    ).where(
        F.col("_p.words").isNotNull() | F.col("_p.start").isNotNull() | F.col("_p.end").isNotNull()
    )
    words = F.array_sort(F.collect_list("_p.words"))
    chunks = given.groupBy(*keys, "section_title", F.col("_p.chunk").alias("_chunk")).agg(
        strip(F.array_join(F.transform(words, lambda w: w["words"]), "")).alias("text"),
        F.coalesce(F.min("_p.start"), F.max("_page")).alias("page_start"),
        F.coalesce(F.min("_p.end"), F.max("_page")).alias("page_end"),
    )
    return chunks.select(
        *keys,
        "section_title",
        (F.col("_chunk") + 1).cast("int").alias("chunk_no"),
        "page_start",
        "page_end",
        word_count(F.col("text")).cast("int").alias("token_count"),
        "text",
    )


def chunk_ids(section_id: Column, chunk_no: Column, prefix: Column) -> Column:
    """``<prefix>_<section>_c001``; wider numbers are not cut."""
    return F.concat(prefix, F.lit("_"), section_id, F.format_string("_c%03d", chunk_no))


def chunk_statistics(chunks: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Count, minimum, maximum and whole-number mean of chunk sizes."""
    return chunks.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.floor(F.sum("token_count") / F.count(F.lit(1))).cast("int").alias("avg_tokens"),
    )
