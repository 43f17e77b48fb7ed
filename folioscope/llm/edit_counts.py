"""Edit-aware token counts: a tree of pre-token segments per document.

A document's pre-tokens are gathered into leaves of a few.  A leaf knows
its characters and its tokens, and a sum tree over the leaves leads from a
place in the text to the leaf that holds it.  An edit re-encodes the leaves it
touches and as much context around them as the split pattern can see; all
other leaves keep their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, encoder, pieces

LEAF = 8  # pre-tokens of a new leaf
CACHED_PIECES = 600_000  # of each half of a worker's cache: regions are encoded again and again


class SumTree:
    """Character and token sums over leaves, leaves in an array of a power of two."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(tokens), 1] = tokens
        for level in range(self.size.bit_length() - 2, -1, -1):
            span = slice(1 << level, 2 << level)
            below = self.sums[2 << level : 4 << level]
            self.sums[span] = below[0::2] + below[1::2]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place``, and where it begins."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            chars = int(self.sums[node, 0])
            if place - before >= chars:
                before += chars
                node += 1
        return node - self.size, before

    def add(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        while node:
            self.sums[node, 0] += chars
            self.sums[node, 1] += tokens
            node //= 2


class CountedText:
    """A text with its segment tree."""

    def __init__(self, text: str, encode: Encoder, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.encode = encode
        self.text = text
        self.encoded = 0  # characters that were encoded for edits
        if chars is None:
            chars, tokens = self._leaves(encode.split(text))
        self.chars, self.leaf_tokens = list(chars), list(tokens)
        self.tree = SumTree(self.chars, self.leaf_tokens)

    def _leaves(self, found: list[str]) -> tuple[list[int], list[int]]:
        if not found:
            return [], []
        starts = np.arange(0, len(found), LEAF)
        chars = np.fromiter(map(len, found), np.int64, len(found))
        sizes = np.fromiter(map(len, map(self.encode.__getitem__, found)), np.int64, len(found))
        return np.add.reduceat(chars, starts).tolist(), (np.add.reduceat(sizes, starts) // 4).tolist()

    @property
    def tokens(self) -> int:
        return self.tree.tokens

    def edit(self, place: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters at ``place``.  Both are cut to the text.

        A pre-token depends on its own characters and the two that follow it at
        most.  So encoding starts again with the leaf that holds the second
        character before the edit, and may stop at the first old leaf boundary
        behind the edit where a new pre-token begins as well.
        """
        old = self.text
        place = min(max(place, 0), len(old))
        end = min(place + max(removed, 0), len(old))
        new = old[:place] + inserted + old[end:]
        shift = len(new) - len(old)
        if not old:
            self.__init__(new, self.encode)
            self.encoded += len(new)
            return
        first, start = self.tree.find(min(max(place - 2, 0), len(old) - 1))
        last, before = self.tree.find(min(end, len(old) - 1))
        border = before + self.chars[last]  # an old leaf boundary behind the edit
        pattern = self.encode.split.pattern_for(new)
        found = []
        if pattern is not self.encode.split.pattern_for(old):
            # Another pattern applies to the whole text from now on.
            first = start = 0
            last, border = len(self.chars) - 1, len(old)
        at = start
        for match in pattern.finditer(new, start):
            while border < match.start() - shift:
                last += 1
                border += self.chars[last]
            if border == match.start() - shift and border >= end:
                break
            found.append(match[0])
            at = match.end()
        else:
            last, border = len(self.chars) - 1, len(old)
        self.encoded += at - start
        chars, tokens = self._leaves(found)
        self.text = new
        if len(chars) == last - first + 1:
            for leaf, c, t in zip(range(first, last + 1), chars, tokens):
                self.tree.add(leaf, c - self.chars[leaf], t - self.leaf_tokens[leaf])
            self.chars[first : last + 1], self.leaf_tokens[first : last + 1] = chars, tokens
        else:
            self.chars[first : last + 1], self.leaf_tokens[first : last + 1] = chars, tokens
            self.tree = SumTree(self.chars, self.leaf_tokens)


EDITS = "array<struct<place:bigint,removed:bigint,inserted:string>>"
STATE = "leaf_chars array<int>, leaf_tokens array<int>"


def count(docs: DataFrame, *, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The state of every document: ``doc_id, n_tokens`` and its leaves.

    A null text counts as empty.  The state is a few numbers per dozen words;
    write it to keep it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(rank_file, pattern, CACHED_PIECES)
        for batch in pieces(batches):
            counted = [CountedText(t or "", encode) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([c.tokens for c in counted], pa.int64()),
                    pa.array([c.chars for c in counted], pa.list_(pa.int32())),
                    pa.array([c.leaf_tokens for c in counted], pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_tokens", "leaf_chars", "leaf_tokens"],
            )

    return _renamed(docs, id_col, text_col).mapInArrow(run, f"doc_id bigint, n_tokens bigint, {STATE}")


def _renamed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def apply_edits(df: DataFrame, *, rank_file: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens_before, n_tokens, n_edits, encoded_chars, n_chars`` and
    the new state and text of rows ``doc_id, text, edits`` with or without a
    state (``leaf_chars, leaf_tokens``).

    Edits of a document are applied in order, each to the text the one before
    left.  Places and lengths outside the text are cut to it, nulls count as 0
    or as an empty insertion, null edits as none.  A row without a state, or
    whose state does not fit its text's length, is counted first.
    """
    stateful = {"leaf_chars", "leaf_tokens"} <= set(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(rank_file, pattern, CACHED_PIECES)
        for batch in pieces(batches):
            rows = []
            for doc_id, text, edits, chars, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if chars is None or tokens is None or sum(chars) != len(text):
                    chars = tokens = None
                kept = CountedText(text, encode, chars, tokens)
                before = kept.tokens
                for e in edits or ():
                    if e is not None:
                        kept.edit(e["place"] or 0, e["removed"] or 0, e["inserted"] or "")
                rows.append((doc_id, before, kept.tokens, len(edits or ()), kept.encoded, len(kept.text),
                             kept.chars, kept.leaf_tokens, kept.text))
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "n_tokens_before", "n_tokens", "n_edits", "encoded_chars", "n_chars",
             "leaf_chars", "leaf_tokens", "text"]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())] * 2 + [pa.string()]
    missing = F.lit(None).cast("array<int>")
    chosen = df.select(
        F.col("doc_id").cast("bigint"),
        "text",
        F.col("edits").cast(EDITS),
        *(("leaf_chars", "leaf_tokens") if stateful else (missing.alias("leaf_chars"), missing.alias("leaf_tokens"))),
    )
    return chosen.mapInArrow(
        run,
        "doc_id bigint, n_tokens_before bigint, n_tokens bigint, n_edits bigint, encoded_chars bigint, "
        f"n_chars bigint, {STATE}, text string",
    )


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` (with a ``doc_id``) and the edits of each document in order of
    ``seq``; ``edits`` has ``doc_id, seq, place, removed, inserted``.

    Edits of one document are applied one after the other, so they meet in one
    row; documents without edits keep null.
    """
    gathered = edits.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "place", "removed", "inserted"))).alias("_all")
    )
    shaped = gathered.select("doc_id", F.col("_all").cast(
        "array<struct<seq:bigint,place:bigint,removed:bigint,inserted:string>>").alias("_all"))
    shaped = shaped.select("doc_id", F.transform("_all", lambda e: F.struct(
        e["place"].alias("place"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))
    return docs.join(shaped, "doc_id", "left")


# -- the query ----------------------------------------------------------------


def revision(text: Column, row_id: Column) -> Column:
    """Edits that make a revision of a document: its first characters go, a
    stamp is put in at a place that depends on the id, and the last characters
    are replaced."""
    size = F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")

    def one(place: Column, removed: int, inserted: Column) -> Column:
        return F.struct(
            place.cast("bigint").alias("place"), F.lit(removed).cast("bigint").alias("removed"), inserted.alias("inserted")
        )

    middle = F.pmod(F.xxhash64(row_id), size + 1)
    stamp = F.concat(F.lit(" [rev "), F.coalesce(row_id.cast("string"), F.lit("")), F.lit("]"))
    return F.array(
        one(F.lit(0), 3, F.lit("")),
        one(middle, 7, stamp),
        one(F.greatest(size - 12, F.lit(0)), 40, F.lit(" the end.\n")),
    )


def op8_edit_aware_counts(spark, folder):
    """Token counts of all documents before and after a revision of each."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    edited = docs.select("doc_id", "text", revision(F.col("text"), F.col("doc_id")).alias("edits"))
    return apply_edits(
        edited,
        rank_file=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        pattern=public_tokenizers.PATTERN,
    ).select("doc_id", "n_tokens_before", "n_tokens", "n_edits", "encoded_chars", "n_chars")


QUERIES = {"op8_edit_aware_counts": op8_edit_aware_counts}
ORACLE: dict[str, str] = {}
