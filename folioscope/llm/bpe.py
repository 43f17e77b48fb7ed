"""Byte-level BPE: encoding with a rank queue, decoding by table.

Ids are those the rank file gives, each match of the split pattern is encoded
by itself, and no special tokens are known.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import kept

CACHED_PIECES = 400_000  # encoded pre-tokens in each half of a worker's cache, about 80 MB
PIECE_BYTES = 4_000_000
GROUP_BITS = 8  # a second-level bitmap has 2 ** GROUP_BITS ranks, and there are as many of them at most

# Letters and numbers that the split pattern of the rank files
# does not count as such, because they came after Unicode 16.
LATER_RANGES = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f "
    "12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda "
    "18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 "
    "1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed "
    "1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f "
)
LATER_THAN_UNICODE_16 = "".join(
    "-".join(chr(int(end, 16)) for end in span.split("-")) for span in LATER_RANGES.split()
)


class Splitter:
    """Pre-tokens of a text by a pattern."""

    def __init__(self, pattern: str):
        self.plain = regex.compile(pattern)
        for kind in (r"\p{L}", r"\p{N}"):
            pattern = pattern.replace(kind, f"[{kind}--[{LATER_THAN_UNICODE_16}]]")
        self.careful = regex.compile("(?V1)" + pattern)
        self.later = re.compile(f"[{LATER_THAN_UNICODE_16}]")

    def pattern_for(self, text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.later.search(text):
                return self.careful
        return self.plain

    def __call__(self, text: str) -> list[str]:
        return self.pattern_for(text).findall(text)


BITS = [1 << n for n in range(1 << GROUP_BITS)]
LOW = (1 << GROUP_BITS) - 1


class RankQueue:
    """Positions in order of merge rank, then of place.

    A two-level bitmap marks the ranks that have waiting positions; the first
    set bit of either level is found with one subtraction.  Each marked rank
    has a bucket of positions.  Entries are never removed when a merge makes
    them stale; the reader skips them.
    """

    __slots__ = ("top", "groups", "buckets")

    def __init__(self, ranks: Iterable[int | None] = ()):
        """``ranks`` of the positions from 0 on; None waits for nothing."""
        top, groups, buckets = 0, {}, {}
        for position, rank in enumerate(ranks):
            if rank is None:
                continue
            if rank in buckets:
                buckets[rank].append(position)
                continue
            buckets[rank] = [position]
            group = rank >> GROUP_BITS
            if group in groups:
                groups[group] |= BITS[rank & LOW]
            else:
                groups[group] = BITS[rank & LOW]
                top |= 1 << group
        self.top: int = top
        self.groups: dict[int, int] = groups
        self.buckets: dict[int, list[int]] = buckets

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            heapq.heappush(self.buckets[rank], position)
            return
        self.buckets[rank] = [position]
        group = rank >> GROUP_BITS
        if group in self.groups:
            self.groups[group] |= BITS[rank & LOW]
        else:
            self.groups[group] = BITS[rank & LOW]
            self.top |= 1 << group

    def pop(self) -> tuple[int, int]:
        top = self.top
        group = (top & -top).bit_length() - 1
        bits = self.groups[group]
        least = bits & -bits
        rank = group << GROUP_BITS | least.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        if bits == least:
            del self.groups[group]
            self.top = top ^ (1 << group)
        else:
            self.groups[group] = bits ^ least
        return rank, bucket[0]


def byte_pairs(ranks: dict[bytes, int]) -> list[list[int | None]]:
    """Ranks of the pairs of bytes, by first and second byte."""
    return [[ranks.get(bytes((a, b))) for b in range(256)] for a in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[list[int | None]] | None = None) -> list[int]:
    """Ids of one pre-token; ``pairs`` are the :func:`byte_pairs` of the ranks.

    Symbols are a linked list over byte positions.  The waiting pair of lowest
    rank, the leftmost of equals, is merged until no neighbouring pair has a
    rank.  Time grows with n log n, also for very long pre-tokens.  The steps of
    ``RankQueue`` are written out here, since their calls took most of the time.
    """
    known = ranks.get(piece)
    if known is not None:
        return [known]
    size = len(piece)
    after = list(range(1, size + 1))  # start of the next symbol
    before = list(range(-1, size - 1))
    rank_of = ranks.get
    # of the pair that begins here
    if pairs is None:
        waiting = [rank_of(piece[i : i + 2]) for i in range(size - 1)]
    else:
        waiting = [pairs[a][b] for a, b in zip(piece, piece[1:])]
    waiting.append(None)
    bits, low, shift, push = BITS, LOW, GROUP_BITS, heapq.heappush
    queue = RankQueue(waiting)
    top, groups, buckets = queue.top, queue.groups, queue.buckets
    while top:
        group = (top & -top).bit_length() - 1
        marked = groups[group]
        least = marked & -marked
        rank = group << shift | least.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heapq.heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            if marked == least:
                del groups[group]
                top ^= 1 << group
            else:
                groups[group] = marked ^ least
        if waiting[i] != rank:
            continue
        gone = after[i]
        end = after[gone]
        after[i] = end
        waiting[gone] = waiting[i] = None
        if end < size:
            before[end] = i
            rank = rank_of(piece[i : after[end]])
            if rank is not None:
                waiting[i] = rank
                if rank in buckets:
                    push(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    group = rank >> shift
                    if group in groups:
                        groups[group] |= bits[rank & low]
                    else:
                        groups[group] = bits[rank & low]
                        top |= 1 << group
        left = before[i]
        if left >= 0:
            rank = waiting[left] = rank_of(piece[left:end])
            if rank is not None:
                if rank in buckets:
                    push(buckets[rank], left)
                else:
                    buckets[rank] = [left]
                    group = rank >> shift
                    if group in groups:
                        groups[group] |= bits[rank & low]
                    else:
                        groups[group] = bits[rank & low]
                        top |= 1 << group
    ids = []
    i = 0
    while i < size:
        end = after[i]
        ids.append(ranks[piece[i:end]])
        i = end
    return ids


class Encoder(dict):
    """Encodes texts; keeps the packed ids of recent pre-tokens.

    When the cache is full it becomes the old one, from which entries that are
    needed again come back; so frequent pre-tokens are never lost.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int | None = None):
        super().__init__()
        self.cached = cached or CACHED_PIECES
        self.old: dict[str, bytes] = {}
        self.ranks = ranks
        self.pairs = byte_pairs(ranks)
        self.split = Splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.cached:
            self.old = dict(self)
            self.clear()
        packed = self.old.get(piece)
        if packed is None:
            packed = array("i", merge(piece.encode(), self.ranks, self.pairs)).tobytes()
        self[piece] = packed
        return packed

    def rest(self) -> None:
        """Give back the old half, at the end of a task: other stages need the
        memory."""
        self.old = {}

    def packed(self, text: str) -> bytes:
        """The ids as packed 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ranks of a rank file (base64, white space, number)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}


def encoder(path: str, pattern: str, cached: int | None = None) -> Encoder:
    """The encoder of this worker for a rank file."""
    return kept(("bpe", path, pattern, cached), lambda: Encoder(read_ranks(path), pattern, cached))


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, which bounds what is
    held in Python besides a batch."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _schema(df: DataFrame, keep: Sequence[str], made: Sequence[tuple[str, str]]) -> str:
    kept_fields = [(c, df.schema[c].dataType.simpleString()) for c in keep]
    return ", ".join(f"`{name}` {kind}" for name, kind in [*kept_fields, *made])


def _word_of(rank_file: str) -> dict[int, bytes]:
    return kept(("words", rank_file), lambda: {r: word for word, r in read_ranks(rank_file).items()})


def _decoded(ids: pa.ListArray, rank_file: str) -> pa.Array:
    word_of = _word_of(rank_file)
    return pa.array(
        [b"".join(map(word_of.__getitem__, i.values.to_numpy().tolist())) if i.is_valid else b"" for i in ids],
        pa.binary(),
    )


def encode(
    df: DataFrame,
    text_col: str,
    ids_col: str,
    *,
    rank_file: str,
    pattern: str,
    keep: Sequence[str],
    decoded_col: str | None = None,
    cached: int | None = None,
) -> DataFrame:
    """Columns ``keep`` and ``ids_col``, the token ids of the whole text; with
    ``decoded_col`` also the bytes that the ids decode to, as a check.
    ``cached`` bounds the pre-tokens in each half of a worker's cache.

    A null text counts as empty and has no ids.  The rank file has to be
    readable at this path on every executor.
    """
    names = [*keep, ids_col, *([decoded_col] if decoded_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file, pattern, cached)
        packed = own.packed
        for batch in pieces(batches):
            parts = [packed(t) if t else b"" for t in batch.column(len(keep)).to_pylist()]
            ends = np.cumsum([0, *map(len, parts)]) // 4
            made = pa.ListArray.from_arrays(
                pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32))
            )
            more = [_decoded(made, rank_file)] if decoded_col else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made, *more], names=names)
        own.rest()

    chosen = df.select(*keep, F.col(text_col).alias("_text"))
    kinds = [(ids_col, "array<int>"), *([(decoded_col, "binary")] if decoded_col else [])]
    return chosen.mapInArrow(run, _schema(df, keep, kinds))


def decode(df: DataFrame, ids_col: str, bytes_col: str, *, rank_file: str, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` and ``bytes_col``, the bytes that the ids stand for.

    Null ids count as none.  An id that the rank file lacks is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = _decoded(batch.column(len(keep)), rank_file)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=[*keep, bytes_col])

    chosen = df.select(*keep, F.col(ids_col).alias("_ids"))
    return chosen.mapInArrow(run, _schema(df, keep, [(bytes_col, "binary")]))


def round_trip(df: DataFrame, *, rank_file: str, pattern: str, cached: int | None = None) -> DataFrame:
    """Per document of ``doc_id, text``: token count and digests of the ids and
    of the bytes they decode to.

    Ids and bytes are made in one pass, so that an executor runs one Python
    worker per core.
    """
    encoded = encode(
        df, "text", "ids", rank_file=rank_file, pattern=pattern, keep=["doc_id"], decoded_col="decoded", cached=cached
    )
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


# -- the query ----------------------------------------------------------------


def op1_byte_bpe(spark, folder):
    import public_tokenizers

    return round_trip(
        spark.read.parquet(f"{folder}/documents.parquet"),
        rank_file=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
        cached=2 * CACHED_PIECES,  # nothing else needs the worker's memory here
    )


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLE: dict[str, str] = {}
