"""Runs of repeated word sequences, by suffix trees and Lyndon roots."""

from __future__ import annotations

import contextlib
import gc
import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import pieces
from .suffix_tree import Extensions

MIN_LENGTH = 12
RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False
)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: an odd multiplier, 2 ** 64 over the golden ratio


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def repeating(words: Sequence[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of a text that can hold a run.

    A run of ``least`` words or more agrees with itself, shifted by its
    period, over half of ``least`` words at each of its places.  So each of its
    words stands in a sequence of that many words which occurs twice in the
    run.  Parts without such sequences are cut out until nothing changes; each
    run, and what stops it from being longer, is left.  Sequences of equal hash
    count as equal, which at most leaves more.
    """
    size, span = len(words), max(1, least // 2)
    starts, ends = np.array([0]), np.array([size])
    while True:
        wide = ends - starts >= least
        starts, ends = starts[wide], ends[wide]
        if not len(starts):
            return starts, ends
        lengths = ends - starts
        if lengths.sum() == size:  # first round
            place = np.arange(size)
            coded = np.fromiter(map(hash, words), np.int64, size).view(np.uint64)
        else:
            place = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        part = np.repeat(np.arange(len(starts)), lengths)
        count = len(place) - span + 1
        values = coded[place]
        key = part[:count].astype(np.uint64)
        for k in range(span):
            key = key * _MIX
            key ^= key >> np.uint64(29)
            key += values[k : k + count]
        inside = part[:count] == part[span - 1 :]
        order = np.argsort(key)
        ranked = key[order]
        equal = ranked[1:] == ranked[:-1]
        again = np.zeros(count, bool)
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        again &= inside
        opened = np.zeros(len(place) + 1, np.int64)
        opened[:count] += again
        opened[span : span + count] -= again
        flags = np.zeros(size, bool)
        flags[place] = np.cumsum(opened)[:-1] > 0
        was, (starts, ends) = int(lengths.sum()), _stretches(flags)
        if int((ends - starts).sum()) == was:
            return starts, ends


def _next_lower(rank: list[int]) -> list[int]:
    """Next place with a lower value, the size if there is none."""
    size = len(rank)
    found = [size] * size
    open_places: list[int] = []
    for at, value in enumerate(rank):
        while open_places and rank[open_places[-1]] > value:
            found[open_places.pop()] = at
        open_places.append(at)
    return found


def runs_of(symbols: Sequence[int], least: int) -> np.ndarray:
    """All runs of at least ``least`` symbols, as rows start, length, period.

    ``symbols`` ends with one that occurs nowhere else and is the smallest.
    The longest Lyndon word at a place, in one of the two opposite orders of
    the symbols, is the root of each run that has such a word there (runs
    theorem); it ends where the next suffix is smaller.  Candidates are
    extended both ways by the trees of the sequence and of its reversal.
    """
    size = len(symbols) - 1
    ahead = Extensions(symbols)
    behind = Extensions([*symbols[size - 1 :: -1], symbols[-1]])
    rank = ahead.rank.tolist()
    top = len(rank)
    lower = np.array(_next_lower(rank))
    higher = np.array(_next_lower([top - r for r in rank]))
    places = np.arange(size)
    at = np.concatenate([places, places])
    root_end = np.concatenate([lower[:size], higher[:size]])
    whole = root_end < size
    at, root_end = at[whole], root_end[whole]
    period = root_end - at
    right = ahead.lengths(at, root_end)
    left = np.zeros(len(at), np.int64)
    inner = at > 0
    left[inner] = behind.lengths(size - at[inner], size - root_end[inner])
    start, length = at - left, left + period + right
    long_enough = length >= np.maximum(least, 2 * period)
    found = np.stack([start, length, period], axis=1)[long_enough]
    return np.unique(found, axis=0) if len(found) else found


def text_runs(words: Sequence[bytes], least: int = MIN_LENGTH) -> np.ndarray:
    """Runs of a text's words by start, then period: rows start, length, period."""
    starts, ends = repeating(words, least)
    if not len(starts):
        return np.empty((0, 3), np.int64)
    number: dict[bytes, int] = {}
    symbols: list[int] = []
    for k, (start, end) in enumerate(zip(starts.tolist(), ends.tolist())):
        symbols.extend([number.setdefault(w, len(number)) for w in words[start:end]])
        symbols.append(-2 - k)  # no run crosses a symbol of its own
    symbols[-1] = min(symbols) - 1
    found = runs_of(symbols, least)
    # From places among the parts to places in the text.
    opens = np.cumsum([0, *(ends - starts + 1)[:-1]])
    part = np.searchsorted(opens, found[:, 0], side="right") - 1
    found[:, 0] += (starts - opens)[part]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(words: Sequence[bytes], runs: np.ndarray) -> Sequence[bytes]:
    """The words that no run repeats: a run's first period stays, unless
    another run drops it."""
    if not len(runs):
        return words
    opened = np.zeros(len(words) + 1, np.int64)
    np.add.at(opened, runs[:, 0] + runs[:, 2], 1)
    np.add.at(opened, runs[:, 0] + runs[:, 1], -1)
    return list(itertools.compress(words, (np.cumsum(opened)[:-1] == 0).tolist()))


@contextlib.contextmanager
def _no_cycle_search() -> Iterator[None]:
    """Trees are many small objects without cycles; searching them takes a
    quarter of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def find_runs(
    df: DataFrame,
    text_col: str,
    *,
    keep: Sequence[str],
    runs_col: str = "runs",
    collapsed_col: str = "collapsed",
    least: int = MIN_LENGTH,
) -> DataFrame:
    """Columns ``keep``; ``runs_col``, an array of start, length and period by
    start, then period; ``collapsed_col``, the text without repetitions, its
    words joined by one space.

    Words are parted by ASCII white space.  A run is a stretch with smallest
    period q, of at least ``least`` words and 2 q, that cannot be extended.  A
    null text counts as empty: no runs, an empty collapsed text.  Runs that
    share words are all given.  Each row is worked on by itself, so repeated
    rows and ids, null ids and columns of any name outside ``keep`` have no
    effect; an empty table gives no rows.  A text's trees are held one after
    the other, about half a kilobyte for each word of the parts that repeat.
    """
    names = [f"k{n}" for n in range(len(keep))]
    kinds = [T.StructField(n, df.schema[c].dataType) for n, c in zip(names, keep)]
    made = [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    members = [pa.field(f.name, pa.int64(), f.nullable) for f in RUNS.elementType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found, texts = [], []
            with _no_cycle_search():
                for text in batch.column(len(names)):
                    words = (text.as_py() or b"").split()
                    runs = text_runs(words, least)
                    found.append(runs)
                    texts.append(b" ".join(kept_words(words, runs)))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            rows = np.concatenate(found)
            columns = [pa.array(np.ascontiguousarray(rows[:, n])) for n in range(3)]
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=members))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], listed, pa.array(texts, pa.binary()).cast(pa.string())],
                names=[*names, "runs", "collapsed"],
            )

    chosen = df.select(
        *(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text_col).cast("binary").alias("_text")
    )
    out = chosen.mapInArrow(run, T.StructType([*kinds, *made]))
    return out.select(
        *(F.col(n).alias(c) for c, n in zip(keep, names)),
        F.col("runs").alias(runs_col),
        F.col("collapsed").alias(collapsed_col),
    )


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of such the first, then of least period; null
    without runs."""
    return F.get(
        F.array_sort(
            runs,
            lambda a, b: F.when(a["length"] != b["length"], b["length"] - a["length"])
            .when(a["start"] != b["start"], a["start"] - b["start"])
            .otherwise(a["period"] - b["period"])
            .cast("int"),
        ),
        0,
    )


# -- the query ----------------------------------------------------------------


def planted(text: Column, doc_id: Column) -> Column:
    """The text, made periodic from some word on where the checksum of the id
    says so."""
    checksum = F.crc32(doc_id.cast("string"))
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    size = F.size(words)
    seed = F.floor(checksum / 10)
    start = (seed % size).cast("int")
    period = (1 + F.floor((size - start) / (3 + seed % 8))).cast("int")
    unit = F.slice(words, start + 1, period)
    times = F.ceil((size - start) / period).cast("int")
    again = F.slice(F.concat(F.slice(words, F.lit(1), start), F.flatten(F.array_repeat(unit, times))), F.lit(1), size)
    chosen = (checksum % 10 == 0) & (F.length(bare) > 0)
    return F.when(chosen, F.array_join(again, " ")).otherwise(text)


def op11_periodic_runs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(texts, "text", keep=["doc_id"]).withColumn("best", longest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLE: dict[str, str] = {}
