"""Near-duplicate texts by character counts.

Two texts are alike when ``2 * common / (len a + len b)`` reaches the
threshold, ``common`` being the size of the multiset intersection of their
characters.  Each text is reported once, with the first earlier text it is
alike to.

Copies (texts with equal counts, however many) are reduced to one row first,
so a large group of copies costs one comparison row.  What is left is compared
exactly in blocks: only texts of matching length bands meet, a band is cut into
blocks of bounded size, and a block pair returns one row per text at most.

In a block pair the sums of groups of characters bound what two texts share, so
most pairs are settled by a few sums.  Candidates come by their order, and a
text that has found one is done.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.arrays import each
from ..functions.text import strip
from ..session import settle
from .arrow import small_batches

BLOCK_ROWS = 16384
MAX_TASKS = 2000
GROUPS = 16  # groups of characters whose sums bound what two texts share
LEFT_ROWS = 64
RIGHT_ROWS = 2048
PART_CELLS = 1 << 24  # entries of a count matrix that are held at once
GATHERED = 1 << 16  # pairs compared at once
GATHER_SHARE = 0.15  # of the pairs of a tile; beyond it the whole tile is compared

COUNTED = "ord bigint, chunk_id string, n int, letters string, counts array<int>, sig binary"


def _counted(text: str) -> tuple[str, np.ndarray, bytes]:
    """Characters of a text in order, how often each occurs, a digest of both."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if codes.max() < 1 << 16:
        found = np.bincount(codes)
        letters = np.flatnonzero(found).astype("<u4")
        counts = found[letters].astype("<i4")
    else:
        letters, counts = np.unique(codes, return_counts=True)
        counts = counts.astype("<i4")
    raw = letters.tobytes()
    return raw.decode("utf-32-le"), counts, hashlib.sha256(raw + counts.tobytes()).digest()


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        made = [_counted(text) for text in batch.column("_t").to_pylist()]
        ends = np.cumsum([0, *(len(c) for _, c, _ in made)]).astype(np.int32)
        counts = np.concatenate([c for _, c, _ in made])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("ord"),
                batch.column("chunk_id"),
                batch.column("n"),
                pa.array([letters for letters, _, _ in made], pa.string()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(counts)),
                pa.array([sig for _, _, sig in made], pa.binary()),
            ],
            names=["ord", "chunk_id", "n", "letters", "counts", "sig"],
        )


FOUND = pa.schema(
    [("sig", pa.binary()), ("ord", pa.int64()), ("other", pa.string()), ("ratio", pa.float64())]
)


class _Texts:
    """Count rows of a cell, in the order of the texts."""

    def __init__(self, cell: pa.Table, threshold: float):
        lists = cell.column("counts").combine_chunks()
        letters = "".join(cell.column("letters").to_pylist())
        codes = np.frombuffer(letters.encode("utf-32-le"), "<u4")
        self.values = lists.flatten().to_numpy()
        offsets = lists.offsets.to_numpy()
        self.starts = offsets - offsets[0]
        known, self.columns = np.unique(codes, return_inverse=True)
        self.width = len(known)
        rows = np.repeat(np.arange(len(lists)), np.diff(self.starts))
        self.sizes = np.bincount(rows, self.values, len(lists)).astype(np.int64)
        self.order = cell.column("ord").to_numpy()
        self.dtype = np.uint16 if self.sizes.max() < 1 << 16 else np.uint32
        self.threshold = threshold
        # A lower bound of each text's part of what a pair has to share.
        self.need = np.maximum(np.floor(self.sizes * (threshold / 2)) - 1, 0).astype(self.dtype)
        groups = self._groups()[self.columns]
        sums = np.bincount(rows * GROUPS + groups, self.values, len(lists) * GROUPS)
        self.sums = np.ascontiguousarray(sums.astype(self.dtype).reshape(-1, GROUPS).T)

    def _groups(self) -> np.ndarray:
        """Group of each character; groups are about equally frequent."""
        total = np.bincount(self.columns, self.values, self.width)
        group = np.zeros(self.width, dtype=np.int64)
        load = [(0.0, g) for g in range(GROUPS)]
        for c in np.argsort(-total, kind="stable").tolist():
            size, g = heapq.heappop(load)
            group[c] = g
            heapq.heappush(load, (size + total[c], g))
        return group

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        """Rows x characters."""
        made = np.zeros((len(rows), self.width), dtype=self.dtype)
        spans = [slice(self.starts[r], self.starts[r + 1]) for r in rows.tolist()]
        for n, span in enumerate(spans):
            made[n, self.columns[span]] = self.values[span]
        return made

    def first_earlier(self, left: np.ndarray, right: np.ndarray):
        """``rows, others, ratios``: for rows of ``left`` the first row of
        ``right`` that comes before and is alike.  Both ascend by order."""
        other = np.full(len(left), -1, dtype=np.int64)
        ratio = np.zeros(len(left))
        part = max(LEFT_ROWS, PART_CELLS // self.width)
        for at in range(0, len(right), part):
            there = right[at : at + part]
            b = self.matrix(there)
            turned = np.ascontiguousarray(b.T)
            for start in range(0, len(left), LEFT_ROWS):
                tile = np.arange(start, min(start + LEFT_ROWS, len(left)))
                tile = tile[(other[tile] < 0) & (self.order[left[tile]] > self.order[there[0]])]
                if len(tile):
                    self._scan(left, tile, there, b, turned, other, ratio)
        found = np.flatnonzero(other >= 0)
        return left[found], other[found], ratio[found]

    def _scan(self, left, tile, there, b, turned, other, ratio) -> None:
        a = self.matrix(left[tile])
        end = int(np.searchsorted(self.order[there], self.order[left[tile]].max()))
        start, step = 0, RIGHT_ROWS // 8
        while start < end and len(tile):
            stop = min(start + step, end)
            rows, cols = left[tile], there[start:stop]
            r, c, common = self._shared(rows, cols, a, b[start:stop], turned[:, start:stop])
            if len(r):
                share = 2.0 * common / (self.sizes[rows[r]] + self.sizes[cols[c]])
                good = (share >= self.threshold) & (self.order[cols[c]] < self.order[rows[r]])
                r, c, share = r[good], c[good], share[good]
                # Pairs ascend by row, then by the order of the other text.
                r, first = np.unique(r, return_index=True)
                other[tile[r]] = cols[c[first]]
                ratio[tile[r]] = share[first]
                open_ = np.ones(len(tile), dtype=bool)
                open_[r] = False
                tile, a = tile[open_], a[open_]
            start, step = stop, RIGHT_ROWS

    def _shared(self, rows, cols, a, b, turned):
        """Pairs that may be alike, with the number of characters they share."""
        need = np.add.outer(self.need[rows], self.need[cols])
        hopeful = _common(self.sums[:, rows], self.sums[:, cols]) >= need
        count = int(np.count_nonzero(hopeful))
        if count > GATHER_SHARE * hopeful.size:
            common = _common(np.ascontiguousarray(a.T), turned)
            r, c = np.nonzero(common >= need)
            return r, c, common[r, c].astype(np.int64)
        r, c = np.nonzero(hopeful)
        common = np.zeros(count, dtype=np.int64)
        some = max(1, GATHERED * 128 // self.width)
        for at in range(0, count, some):
            few = slice(at, at + some)
            common[few] = np.minimum(a[r[few]], b[c[few]]).sum(axis=1, dtype=np.int64)
        return r, c, common


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all columns of ``a`` and ``b``."""
    total = np.zeros((a.shape[1], b.shape[1]), dtype=a.dtype)
    least = np.empty_like(total)
    for x, y in zip(a, b):
        np.minimum(x[:, None], y[None, :], out=least)
        total += least
    return total


def _compare_cell(threshold: float):
    """Compare the rows of one block pair; keep each row's first earlier match."""

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("ord").combine_chunks()
        kind, i, j = (cell.column(c)[0].as_py() for c in ("kind", "i", "j"))
        side = cell.column("side").to_numpy()
        if kind == 0 and i == j:
            every = np.arange(len(side))  # a block against itself
            ways = [(every, every)]
        else:
            left, right = np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]
            if not len(left) or not len(right):
                return FOUND.empty_table()
            ways = [(left, right), (right, left)]
        texts = _Texts(cell, threshold)
        rows, others, ratios = (
            np.concatenate(parts) for parts in zip(*(texts.first_earlier(*way) for way in ways))
        )
        return pa.table(
            [
                cell.column("sig").take(pa.array(rows)),
                pa.array(texts.order[others]),
                cell.column("chunk_id").take(pa.array(others)),
                pa.array(ratios),
            ],
            schema=FOUND,
        )

    return run


def near_duplicates(
    chunks: DataFrame,
    text: str = "text",
    threshold: float = K.DUPLICATE_RATIO,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``ord, chunk_id, other_ord, other_id, ratio`` for each repeated text.

    ``chunks`` needs a unique ``ord`` (the order of the rows).  The counts are
    written once, a list of characters and one of numbers; a small job reads the number of distinct texts per length
    band (some hundred numbers).
    """
    rows = (
        chunks.select("ord", "chunk_id", strip(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
        .where(F.col("_t") != "")
        .select("ord", "chunk_id", F.length("_t").alias("n"), "_t")
    )
    rows = settle(rows.mapInArrow(_count_batches, COUNTED), "counts")
    distinct = rows.groupBy("sig").agg(
        F.min(F.struct("ord", "chunk_id")).alias("first"),
        F.any_value("n").alias("n"),
        F.any_value(F.struct("letters", "counts")).alias("c"),
    )
    base = (2.0 - threshold) / threshold * (1 + 1e-9)
    banded = distinct.select(
        "sig",
        F.col("first.ord").alias("ord"),
        F.col("first.chunk_id").alias("chunk_id"),
        "c.letters",
        "c.counts",
        F.floor(F.log(F.col("n")) / math.log(base)).alias("band"),
    )
    sizes = {
        r.band: max(1, math.ceil(r["count"] / block_rows))
        for r in banded.groupBy("band").count().collect()
    }
    if sizes:
        blocks = F.create_map(*[F.lit(x) for b, m in sizes.items() for x in (b, m)])
    else:
        blocks = F.create_map().cast("map<bigint,int>")

    def blocks_of(band: Column) -> Column:
        return F.coalesce(F.element_at(blocks, band), F.lit(0))

    own = F.pmod(F.xxhash64("sig"), blocks_of(F.col("band"))).cast("int")

    def upto(count: Column) -> Column:
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
            F.array().cast("array<int>")
        )

    def cell(kind: int, band: Column, i: Column, j: Column, side: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), band.alias("band"), i.alias("i"), j.alias("j"),
            side.cast("int").alias("side"),
        )

    band = F.col("band")
    block = F.col("block")
    same = F.transform(
        upto(blocks_of(band)),
        lambda j: cell(0, band, F.least(block, j), F.greatest(block, j), (block > j)),
    )
    above = F.transform(
        upto(blocks_of(band + 1)), lambda j: cell(1, band, block, j, F.lit(0))
    )
    below = F.transform(
        upto(blocks_of(band - 1)), lambda i: cell(1, band - 1, i, block, F.lit(1))
    )
    placed = (
        each(
            banded.withColumn("block", own),
            ["sig", "ord", "chunk_id", "letters", "counts"],
            F.concat(same, above, below),
            "cell",
        )
        .select("sig", "ord", "chunk_id", "letters", "counts", "cell.*")
    )
    # Cells are small and take long: without a number they would be merged.
    cells = sum(m * (m + 1) // 2 + m * sizes.get(b + 1, 0) for b, m in sizes.items())
    placed = placed.repartition(min(max(cells, 1), MAX_TASKS), "kind", "band", "i", "j")
    alike = placed.groupBy("kind", "band", "i", "j").applyInArrow(
        _compare_cell(threshold), "sig binary, ord bigint, other string, ratio double"
    )
    own_first = distinct.select(
        "sig",
        F.col("first.ord").alias("ord"),
        F.col("first.chunk_id").alias("other"),
        F.lit(1.0).alias("ratio"),
    )
    best = (
        alike.unionByName(own_first)
        .groupBy("sig")
        .agg(F.min(F.struct("ord", "other", "ratio")).alias("m"))
    )
    return (
        rows.select("ord", "chunk_id", "sig")
        .join(best, "sig")
        .where(F.col("m.ord") < F.col("ord"))
        .select(
            "ord",
            "chunk_id",
            F.col("m.ord").alias("other_ord"),
            F.col("m.other").alias("other_id"),
            F.col("m.ratio").alias("ratio"),
        )
    )
