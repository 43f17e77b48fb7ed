"""Line and title tests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import strip

# Python matches without regard to case over all of Unicode.
NOCASE = "(?iU)"
DIGIT_CHARS = r"[\d\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"


def _words(names: Iterable[str]) -> str:
    return "|".join(n.replace(" ", r"\s+") for n in names)


NOISE = rf"{NOCASE}\A(?:{'|'.join(K.NOISE_PREFIXES)})"
RULES = (
    rf"{NOCASE}\A(?:{K.DECIMAL_NUMBER}|{K.ROMAN_NUMBER}"
    rf"|(?:{_words(K.PREFIX_WORDS)})\s+{K.PREFIX_NUMBER}"
    rf"|(?:{_words(K.TOPIC_TITLES)})\n?\z)"
)


def is_noise_line(c: Column) -> Column:
    """Blank, digits only, bracketed, or publication metadata."""
    line = strip(c)
    return (
        (line == "")
        | line.rlike(rf"(?U)\A{DIGIT_CHARS}+\z")
        | (line.startswith("[") & line.endswith("]"))
        | line.rlike(NOISE)
    )


def is_capitals(line: Column) -> Column:
    """Short all-capitals line with a letter and no closing mark."""
    return (
        (line == F.upper(line))
        & F.length(line).between(K.CAPS_MIN_CHARS, K.CAPS_MAX_CHARS)
        & ~line.rlike(r"[.:;]\z")
        & line.rlike(r"\p{L}")
    )


def is_rule_heading(c: Column) -> Column:
    line = strip(c)
    return (
        F.length(line).between(K.HEADING_MIN_CHARS, K.HEADING_MAX_CHARS)
        & ~is_noise_line(line)
        & (line.rlike(RULES) | is_capitals(line))
    )


def is_numbered_recommendation(c: Column) -> Column:
    return c.rlike(rf"{NOCASE}\A{K.NUMBERED_RECOMMENDATION}")


def is_profile_heading(c: Column) -> Column:
    """Heading test of the profiled document."""
    line = strip(c)
    upper = F.upper(line)
    return (
        (line != "")
        & ~upper.isin(list(K.HEADING_RUNNING_HEADERS))
        & ~upper.contains(K.TITLE_PHRASE)
        & F.when(upper.isin(list(K.MAIN_SECTIONS)), line == upper).otherwise(
            is_numbered_recommendation(line)
        )
    )


def has_excluded_word(title: Column, words: Iterable[str] = K.EXCLUDED_TITLE_WORDS) -> Column:
    """Any of the words occurs inside the upper-cased title."""
    return F.upper(title).rlike("|".join(words))


def is_excluded_title(title: Column, titles: Iterable[str] = K.EXCLUDED_SECTIONS) -> Column:
    return F.upper(title).isin(list(titles))


def is_bold(font: Column) -> Column:
    return F.coalesce(font.rlike("|".join(K.BOLD_MARKERS)), F.lit(False))


def trim_title(c: Column) -> Column:
    """Remove colons, hyphens, dots and spaces at both ends."""
    return F.btrim(c, F.lit(":-. "))
