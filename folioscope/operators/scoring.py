"""Exact best-k search of many queries over a large table.

Pairs of (query, row) are never emitted.  Each task scores Arrow batches
against a block of queries with matrix products and keeps the ``k`` best rows
per query, so ``tasks x queries x k`` rows at most are shuffled; a group-limited
row number then picks the final ``k``.

The query block reaches the tasks in one of two ways:

* when the query side is proven small (it is counted first), it is shipped
  with the task and the large table is not shuffled at all;
* otherwise both sides are hashed into blocks by unique row id, and every
  (row block, query block) cell is co-grouped.  Each row visits every query
  block once; block sizes are chosen from the counts, so a cell fits in memory
  whatever the data looks like.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from ..session import settle
from .arrow import small_batches
from .ordered import top_k

MAX_SHIPPED_QUERY_ROWS = 200_000
ROWS_PER_BLOCK = 20_000
SCORES = 1_000_000  # scores that are computed at once

# make_scorer(query table) -> scorer; scorer(batch) -> (scores [n, q], allowed or None)
Scorer = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]]


class BestK:
    """The ``k`` best (score, id) per query seen so far."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.kept: list[tuple[np.ndarray, np.ndarray] | None] = [None] * n_queries
        self.least = np.full(n_queries, -np.inf)  # k-th best score of each query so far

    def add(self, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray | None) -> None:
        if not len(ids):
            return
        # Queries for which no row reaches the k-th best score are passed over.
        for q in np.flatnonzero(scores.max(axis=0) >= self.least).tolist():
            column = scores[:, q]
            row_ids = ids
            if allowed is not None:
                column = column[allowed[:, q]]
                row_ids = ids[allowed[:, q]]
            if len(column) > self.k:
                # every row that ties with the k-th best stays a candidate
                kth = np.partition(column, len(column) - self.k)[len(column) - self.k]
                near = column >= kth
                column, row_ids = column[near], row_ids[near]
            if self.kept[q] is not None:
                column = np.concatenate([self.kept[q][0], column])
                row_ids = np.concatenate([self.kept[q][1], row_ids])
            order = np.lexsort((row_ids, -column))[: self.k]
            self.kept[q] = (column[order], row_ids[order])
            if len(order) == self.k:
                self.least[q] = column[order[-1]]

    def table(self, query_ids: list, schema: pa.Schema) -> pa.Table:
        qs, ids, scores = [], [], []
        for query_id, kept in zip(query_ids, self.kept):
            if kept is not None and len(kept[0]):
                qs.extend([query_id] * len(kept[0]))
                scores.append(kept[0])
                ids.append(kept[1])
        if not qs:
            return schema.empty_table()
        return pa.table(
            [
                pa.array(qs, schema.field(0).type),
                pa.array(np.concatenate(ids).tolist(), schema.field(1).type),
                pa.array(np.concatenate(scores), pa.float64()),
            ],
            schema=schema,
        )


def _id_array(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.array(column.to_pylist(), dtype=str)


def _search(
    batches: Iterator[pa.RecordBatch], queries: pa.Table, make_scorer, k: int, digits: int,
    schema: pa.Schema,
) -> pa.Table:
    query_ids, scorer = make_scorer(queries)
    best = BestK(len(query_ids), k)
    step = max(1, min(4096, SCORES // max(1, len(query_ids))))
    for batch in small_batches(batches):
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            scores, allowed = scorer(part)
            best.add(_id_array(part.column(0)), np.round(scores, digits) + 0.0, allowed)
    return best.table(query_ids, schema)


def best_k(
    items: DataFrame,
    queries: DataFrame,
    make_scorer,
    k: int,
    item_id: str,
    query_id: str = "query_id",
    digits: int = 6,
    max_shipped: int = MAX_SHIPPED_QUERY_ROWS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """``query_id, item_id, score, rank`` of the ``k`` best items per query.

    ``item_id`` must be the first column of ``items`` and unique.  Ranks follow
    the score rounded to ``digits`` and then the id, so the result does not
    depend on how rows are spread over tasks.  Runs one job: the query side is
    read (up to its bound) to choose the way.
    """
    id_type = items.schema[item_id].dataType.simpleString()
    query_type = queries.schema[query_id].dataType.simpleString()
    out = f"{query_id} {query_type}, {item_id} {id_type}, score double"
    arrow_out = pa.schema(
        [
            (query_id, to_arrow_type(queries.schema[query_id].dataType)),
            (item_id, to_arrow_type(items.schema[item_id].dataType)),
            ("score", pa.float64()),
        ]
    )

    small = queries.limit(max_shipped + 1).toArrow()
    if not small.num_rows:
        items = items.limit(0)
    if small.num_rows <= max_shipped:

        def shipped(batches):
            yield from _search(batches, small, make_scorer, k, digits, arrow_out).to_batches()

        found = items.mapInArrow(shipped, out)
    else:
        queries = settle(queries, "queries")
        n_items = items.select(item_id).count()
        n_queries = queries.count()
        item_blocks = max(1, math.ceil(n_items / rows_per_block))
        query_blocks = max(1, math.ceil(n_queries / max_shipped))
        left = items.withColumn(
            "_ib", F.pmod(F.xxhash64(item_id), F.lit(item_blocks)).cast("int")
        ).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        right = queries.withColumn(
            "_qb", F.pmod(F.xxhash64(query_id), F.lit(query_blocks)).cast("int")
        ).withColumn("_ib", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))))

        def cell(rows: pa.Table, block: pa.Table) -> pa.Table:
            if not rows.num_rows or not block.num_rows:
                return arrow_out.empty_table()
            return _search(
                rows.combine_chunks().to_batches(), block, make_scorer, k, digits, arrow_out
            )

        found = (
            left.groupBy("_ib", "_qb").cogroup(right.groupBy("_ib", "_qb")).applyInArrow(cell, out)
        )
    return top_k(found, [query_id], [F.desc("score"), F.asc(item_id)], k)


def vector_scorer(query_id: str = "query_id", vector: str = "vector", matches=None):
    """Cosine scorer.  Items are (id, vector [, extra columns for ``matches``])."""

    def make(queries: pa.Table):
        ids = queries.column(query_id).to_pylist()
        q = _matrix(queries.column(vector).combine_chunks())
        q = q / _lengths(q)
        allow = matches(queries, list(range(len(ids)))) if matches else None

        def score(batch: pa.RecordBatch):
            rows = _matrix(batch.column(1))
            if rows.shape[1] != q.shape[1]:
                raise ValueError(f"vectors of {rows.shape[1]} and of {q.shape[1]} numbers cannot be compared")
            return (rows @ q.T) / _lengths(rows), allow(batch) if allow else None

        return ids, score

    return make


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().unique()
    if column.null_count or len(sizes) > 1:
        raise ValueError(f"vectors must not be null and have one length, not {sizes.to_pylist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lengths(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    size[size == 0.0] = 1.0
    return size


def term_scorer(
    average_length: float, k1: float, b: float, query_id: str = "query_id", matches=None
):
    """BM25 scorer.

    Query rows are (query_id, term, weight), weight = idf times multiplicity;
    items are (id, terms [, extra columns]).
    """

    def make(queries: pa.Table):
        import pyarrow.compute as pc

        ids = pc.unique(queries.column(query_id)).to_pylist()
        at = {q: n for n, q in enumerate(ids)}
        vocabulary = pc.unique(queries.column("term"))
        q_index = np.array([at[q] for q in queries.column(query_id).to_pylist()])
        first_row = np.unique(q_index, return_index=True)[1].tolist()
        t_index = pc.index_in(queries.column("term"), vocabulary).to_numpy()
        weights = np.array(queries.column("weight").to_pylist(), dtype=np.float64)
        order = np.argsort(t_index, kind="stable")
        t_index, q_index, weights = t_index[order], q_index[order], weights[order]
        n_terms = len(vocabulary)
        allow = matches(queries, first_row) if matches else None

        def score(batch: pa.RecordBatch):
            terms = batch.column(1)
            sizes = np.diff(terms.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), sizes)
            found = pc.index_in(terms.flatten(), vocabulary)
            hit = found.is_valid().to_numpy(zero_copy_only=False)
            term = found.drop_null().to_numpy().astype(np.int64)
            pairs, tf = np.unique(doc[hit].astype(np.int64) * n_terms + term, return_counts=True)
            doc, term = pairs // n_terms, pairs % n_terms
            length = sizes[doc] if average_length else sizes[doc] * 0.0
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / (average_length or 1.0)))
            scores = np.zeros((batch.num_rows, len(ids)))
            # term by term blocks of the sparse product; dense only over used terms
            used, column = np.unique(term, return_inverse=True)
            for start in range(0, len(used), 1024):
                block = used[start : start + 1024]
                left = np.zeros((batch.num_rows, len(block)))
                inside = (column >= start) & (column < start + len(block))
                left[doc[inside], column[inside] - start] = part[inside]
                right = np.zeros((len(block), len(ids)))
                low = np.searchsorted(t_index, block, "left")
                high = np.searchsorted(t_index, block, "right")
                for n, (i, j) in enumerate(zip(low, high)):
                    np.add.at(right[n], q_index[i:j], weights[i:j])
                scores += left @ right
            return scores, allow(batch) if allow else None

        return ids, score

    return make


def document_filter(first_item_column: int = 2):
    """Match function for queries that name a target document.

    Query rows carry ``has_target, target_id, target_file, target_org``; items
    carry their lower-case document id and file from ``first_item_column`` on.
    Distinct item documents are compared once per batch.
    """

    def make(queries: pa.Table, rows: list[int]):
        names = ["has_target", "target_id", "target_file", "target_org"]
        columns = [queries.column(c).to_pylist() for c in names]
        targets = [tuple(c[r] for c in columns) for r in rows]

        def allow(batch: pa.RecordBatch) -> np.ndarray:
            documents = list(
                zip(
                    batch.column(first_item_column).to_pylist(),
                    batch.column(first_item_column + 1).to_pylist(),
                )
            )
            known = {d: [_matches(t, d) for t in targets] for d in set(documents)}
            return np.array([known[d] for d in documents], dtype=bool).reshape(
                len(documents), len(targets)
            )

        return allow

    return make


def _matches(target: tuple, document: tuple) -> bool:
    present, wanted_id, wanted_file, wanted_org = target
    if not present:
        return True
    name, file = (document[0] or ""), (document[1] or "")
    return bool(
        (wanted_id and wanted_id in name)
        or (wanted_file and wanted_file in file)
        or (wanted_org and (wanted_org in name or wanted_org in file))
    )
