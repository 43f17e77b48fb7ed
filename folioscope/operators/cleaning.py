"""Page cleaning."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import text as X
from ..functions.arrays import each
from .arrow import map_column


def _repeated_spans(lines: list[str], size: int) -> list[int]:
    """Starts of the spans of ``size`` lines to drop.

    A span goes when a line that stays begins an equal span further up.  Only
    starts of spans that occur further up at all can be such; they are taken
    from the top, and those inside a dropped span are passed over.
    """
    spans = list(zip(*(lines[k:] for k in range(size))))
    if len(set(spans)) == len(spans):
        return []
    places: dict[tuple[str, ...], list[int]] = {}
    for at, span in enumerate(spans):
        places.setdefault(span, []).append(at)
    twins = {at: found[:n] for found in places.values() for n, at in enumerate(found) if n}
    gone: set[int] = set()
    starts: list[int] = []
    for at in sorted(twins):
        if at not in gone and not gone.issuperset(twins[at]):
            starts.append(at)
            gone.update(range(at, at + size))
    return starts


def _without_repeats(text: str, size: int) -> str:
    lines = text.split("\n")
    for start in reversed(_repeated_spans(lines, size)):
        del lines[start : start + size]
    return "\n".join(lines)


def dedupe_blocks(df: DataFrame, text: str = "text", size: int = K.BLOCK_LINES) -> DataFrame:
    """Drop a block of lines that was seen before on the page.

    Whether a block goes depends on which of the blocks above it went: this is
    the one cleaning step that needs Python.  Pages without two equal blocks
    cost a set of their blocks only.
    """

    def scan(value: str | None) -> str | None:
        return None if value is None else _without_repeats(value, size)

    return map_column(df, text, T.StringType(), [text], scan)


def clean_lines(
    df: DataFrame, text: str = "text", headers: Iterable[str] = K.RUNNING_HEADERS
) -> DataFrame:
    """All steps but the block step, inside the JVM."""
    return df.withColumn(text, F.array_join(X.cleaned_lines(F.col(text), headers), "\n"))


def clean_text(
    df: DataFrame,
    text: str = "text",
    headers: Iterable[str] = K.RUNNING_HEADERS,
    block_lines: int = K.BLOCK_LINES,
) -> DataFrame:
    """Full page cleaning of column ``text``; no shuffle."""
    return dedupe_blocks(clean_lines(df, text, headers), text, block_lines)


def drop_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(X.strip(F.col(text)) != "")


def split_lines(df: DataFrame, text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """One row per non-blank stripped line, with ``pos`` from 0."""
    return each(df, list(keep), X.stripped_lines(F.col(text)), "line", "pos")


def drop_header_lines(lines: DataFrame, headers: DataFrame, header: str = "header") -> DataFrame:
    """Remove lines found in a header table (compared in upper case)."""
    names = headers.select(F.upper(F.col(header)).alias("_upper")).distinct()
    return lines.join(names, F.upper("line") == F.col("_upper"), "left_anti")
