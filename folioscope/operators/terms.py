"""Search terms of many texts at once, cut by whole-array steps over their bytes.

The same terms as :func:`folioscope.functions.tokens.search_terms`.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_TERM = np.zeros(256, bool)
_TERM[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_HYPHEN, _SLASH, _UNDERSCORE, _NINE = b"-/_9"


@functools.cache
def word_characters(spark: SparkSession) -> list[tuple[int, int]]:
    """From where to where characters behind ASCII are parts of a word, as
    Spark's expressions have it.  Runs one small job."""
    code = F.lpad(F.hex("id"), 8, "0")
    known = spark.range(0x80, 0x110000).where(~F.col("id").between(0xD800, 0xDFFF))
    found = known.where(F.decode(F.unhex(code), "UTF-32").rlike(r"(?U)\w"))
    codes = np.sort(found.toArrow().column("id").to_numpy())
    first = np.append(True, np.diff(codes) > 1)
    return list(zip(codes[first].tolist(), (codes[np.append(first[1:], True)] + 1).tolist()))


def word_table(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for start, end in ranges:
        table[start:end] = True
    return table


def lowered(text: Column) -> Column:
    """What :func:`cut_terms` reads: the text in lower case with a space after it."""
    return F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def values_of(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in a column of bytes: those of all rows in a line, and where each row's begin and end."""
    size = np.dtype(kind).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, kind), np.zeros(len(column) + 1, np.int64)
    line = np.frombuffer(data, kind, (ends[-1] - ends[0]) // size, ends[0])
    return line, (ends.astype(np.int64) - ends[0]) // size


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of strings of bytes that follow each other."""
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _code_points(line: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Of the characters of two to four bytes that begin at ``lead``."""
    first, second = line[lead].astype(np.int32), line[lead + 1] & 0x3F
    codes = (first & 0x1F) << 6 | second
    long = np.flatnonzero(first >= 0xE0)
    if len(long):
        codes[long] = (first[long] & 0xF) << 12 | second[long].astype(np.int32) << 6 | line[lead[long] + 2] & 0x3F
        four = long[first[long] >= 0xF0]
        third, last = (line[lead[four] + n].astype(np.int32) & 0x3F for n in (2, 3))
        codes[four] = (first[four] & 7) << 18 | second[four].astype(np.int32) << 12 | third << 6 | last
    return codes


def cut_terms(texts: pa.Array, words: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Terms of :func:`lowered` texts in their order, and their number in each
    text; ``words`` is the :func:`word_table`."""
    line, borders = values_of(texts, "u1")
    inside = _TERM[line]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(line) and inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[0::2], edges[1::2]  # the last byte is a space
    word = line == _UNDERSCORE
    lead = np.flatnonzero(line >= 0xC0)
    if len(lead):
        mine = words[_code_points(line, lead)]
        word[lead] = mine
        for n, least in enumerate((0xC0, 0xE0, 0xF0), 1):  # the last byte stands beside the next run
            longer = line[lead] >= least
            word[lead[longer] + n] = mine[longer]
    # Runs beside another part of a word are no terms.
    whole = ~(word[starts - 1] | word[ends])
    starts, ends = starts[whole], ends[whole]
    after = line[ends[:-1]]
    joined = (starts[1:] - ends[:-1] == 1) & ((after == _HYPHEN) | (after == _SLASH))
    starts, ends = starts[np.append(True, ~joined)[: len(starts)]], ends[np.append(~joined, True)[: len(ends)]]
    long = (ends - starts > 1) | (line[starts] <= _NINE)
    starts, ends = starts[long], ends[long]
    turn = np.zeros(len(line) + 1, np.int8)
    turn[starts], turn[ends] = 1, -1
    data = line[np.cumsum(turn[:-1], dtype=np.int8).view(bool)]
    return strings(data, np.append(0, np.cumsum(ends - starts))), np.diff(np.searchsorted(starts, borders))
