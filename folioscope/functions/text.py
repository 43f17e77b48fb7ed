"""Line and string expressions.

All of them run inside the JVM.  Lines of one text stay together in an array,
so cleaning a text needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Python's str methods see it.  Java's \\s knows the six ASCII
# characters only; the others are mapped to a space first, which is much faster
# than a regular expression that lists them all.
SPACE_CHARACTERS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
RARE_SPACES = "".join(c for c in SPACE_CHARACTERS if c not in " \t\n\x0b\x0c\r")
RARE_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACE_CHARACTERS) + "]"
NOT_WS = "[^" + WS[1:]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove white space at both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACE_CHARACTERS))


def plain_spaces(c: Column) -> Column:
    """Rare white space as spaces, so that Java's own class covers the rest."""
    return F.translate(c, RARE_SPACES, " " * len(RARE_SPACES))


def has_rare_space(c: Column) -> Column:
    return F.length(F.translate(c, RARE_SPACES, "")) < F.length(c)


def squeeze(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(plain_spaces(c), r"\s+", " ")


def lines_of(c: Column) -> Column:
    """Split at every Unicode line boundary."""
    return F.split(F.translate(c, RARE_BREAKS, "\n" * len(RARE_BREAKS)), r"\r?\n|\r", -1)


def stripped_lines(c: Column) -> Column:
    """Lines without surrounding white space and without blank lines."""
    return F.filter(F.transform(lines_of(c), strip), lambda x: x != "")


def is_number_line(c: Column) -> Column:
    return c.rlike(r"(?U)\A\d+\z")


def unbullet(c: Column) -> Column:
    """A line with leading ``[`` marks becomes a ``- item``; null when empty.

    Neighbouring lines do not matter: a lone mark disappears, and any other
    marked line is a bullet of its own.
    """
    item = strip(F.regexp_replace(c, r"\A\[+", ""))
    return (
        F.when(~c.startswith("["), c)
        .when(item != "", F.concat(F.lit("- "), item))
        .otherwise(F.lit(None).cast("string"))
    )


def collapse_bullets(lines: Column) -> Column:
    return F.filter(F.transform(lines, unbullet), lambda x: x.isNotNull())


def drop_repeats(lines: Column) -> Column:
    """Keep a line only when it differs from the line before it."""
    return let(
        lines,
        lambda a: F.filter(
            a,
            lambda x, i: (i == 0) | (x != F.get(a, i - 1)),
        ),
    )


def drop_headers(lines: Column, headers: Iterable[str]) -> Column:
    names = [h for h in headers]
    if not names:
        return lines
    return F.filter(lines, lambda x: ~F.upper(x).isin(names))


def cleaned_lines(c: Column, headers: Iterable[str]) -> Column:
    """All cleaning steps that look at one line or its predecessor."""
    kept = drop_headers(stripped_lines(c), headers)
    kept = F.filter(kept, lambda x: ~is_number_line(x))
    kept = F.transform(kept, squeeze)
    return drop_repeats(collapse_bullets(kept))


def cut_at_line(text: Column, titles: Iterable[str]) -> Column:
    """Text before the first line that equals one of ``titles``."""
    names = list(titles)

    def cut(lines: Column) -> Column:
        marks = F.transform(lines, lambda x: F.upper(strip(x)).isin(names))
        at = F.array_position(marks, True)
        return F.when(at == 0, F.array_join(lines, "\n")).otherwise(
            rstrip(F.array_join(F.slice(lines, 1, (at - 1).cast("int")), "\n"))
        )

    return let(F.split(text, "\n", -1), cut)


def keep_first_title(text: Column, title: Column) -> Column:
    """Drop every line equal to ``title`` except the first one."""
    wanted = F.upper(strip(title))

    def keep(lines: Column) -> Column:
        def kept(marks: Column) -> Column:
            first = F.array_position(marks, True)
            return F.array_join(
                F.filter(
                    lines,
                    lambda x, i: ~F.get(marks, i) | (i + 1 == first),
                ),
                "\n",
            )

        return let(F.transform(lines, lambda x: F.upper(strip(x)) == wanted), kept)

    return let(F.split(text, "\n", -1), keep)


def file_name(path: Column) -> Column:
    """Last path part, for both kinds of slash."""
    return F.regexp_extract(path, r"[^/\\]*\z", 0)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+\z", "")


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\p{L}+|\P{L}+"), 0)
    return F.array_join(
        F.transform(
            pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))
        ),
        "",
    )


def document_id_of(path: Column) -> Column:
    stem = F.regexp_replace(file_stem(path), r"[^a-zA-Z0-9_-]", "_")
    return F.concat(F.lit("doc_"), F.lower(stem))


def document_name_of(path: Column) -> Column:
    return title_case(F.regexp_replace(file_stem(path), "_", " "))


def whole(c: Column) -> Column:
    """Nearest whole number as text, halves to even."""
    return F.bround(c, 0).cast("bigint").cast("string")


def percent(c: Column) -> Column:
    return F.concat(whole(c * 100), F.lit("%"))
