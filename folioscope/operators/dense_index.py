"""Stored vector index with exact cosine search.

Vectors are grouped by the nearest of some centres, and within a group by the
angle to it: a shell holds the vectors between two angles.  The angle between a
query and any vector of a shell is at least the difference of their angles to
the centre, so a search visits shells in order of the cosine they can reach and
stops at the k-th score.  Unlike a graph, that loses nothing; how many shells
are passed over depends on how well the vectors cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import constants as K
from ..session import settle
from .ordered import top_k
from .scoring import BestK, _id_array, _lengths, _matrix

SAMPLE = 10_000  # vectors the centres are fitted on, at most
MAX_CELLS = 4096
ROWS_PER_SHELL = 1024
ROWS_PER_SLICE = 8192
FIRST_SHELLS = 2
QUERIES_AT_ONCE = 4096
DIGITS = 6
_ROUNDING = 1e-9  # of angles


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / _lengths(rows)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Directions of ``cells`` groups of unit vectors, fewer if there are fewer
    distinct ones; each round moves them to the means of their groups."""
    distinct = np.unique(np.round(sample, 6), axis=0)
    chosen = np.random.default_rng(seed).permutation(len(distinct))[:cells]
    centres = _unit(distinct[chosen])
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        moved = np.linalg.norm(sums, axis=1) > 1e-9
        centres[moved] = _unit(sums[moved])
    return centres


@dataclass
class DenseIndex:
    """``shells`` is ``cell, shell, low, high, amount`` with the angles between
    which the vectors of a shell lie; cell -1 holds vectors of length zero."""

    spark: SparkSession
    path: str
    item_id: str
    stored: DataFrame
    centres: np.ndarray
    shells: pa.Table

    @staticmethod
    def load(spark: SparkSession, path: str, item_id: str = "chunk_id") -> "DenseIndex":
        rows = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
        shells = spark.read.parquet(f"{path}/shells").orderBy("cell", "shell").toArrow()
        centres = _matrix(rows.column("centre")) if rows.num_rows else np.empty((0, 0))
        schema = spark.read.parquet(f"{path}/schema").schema  # of the vectors, of which there may be none
        stored = spark.read.schema(schema).parquet(f"{path}/vectors")
        return DenseIndex(spark, path, item_id, stored, centres, shells)

    def top_k(self, queries: DataFrame, k: int, query_vector: str = "vector", query_id: str = "query_id") -> DataFrame:
        return search(self, queries, k, query_vector, query_id)[0]


def build_index(
    vectors: DataFrame,
    path: str,
    item_id: str = "chunk_id",
    vector: str = "embedding",
    cells: int | None = None,
    rows_per_shell: int = ROWS_PER_SHELL,
    sample_rows: int = SAMPLE,
) -> DenseIndex:
    """Store the vectors below ``path`` by cell and shell.

    Centres are fitted on at most ``sample_rows`` vectors, those of least
    hashed id; every vector is stored.  The number of cells follows the square
    root of the row count.  Vectors of length zero keep a cell of their own;
    rows without a vector or an id are left out.  What reaches the driver is
    the sample and a row for each shell, ``MAX_CELLS`` times a few.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull() & F.col(item_id).isNotNull()).select(item_id, vector)
    count = rows.count()
    cells = cells or min(MAX_CELLS, max(1, math.isqrt(count) // 2))
    drawn = rows.orderBy(F.xxhash64(item_id), item_id).limit(sample_rows).select(vector).toArrow()
    sample = _matrix(drawn.column(0)) if drawn.num_rows else np.empty((0, 1))
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    centres = fit_centres(_unit(sample), cells) if len(sample) else np.empty((0, sample.shape[1]))
    sent = spark.sparkContext.broadcast(centres)  # MAX_CELLS vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                unit = _matrix(batch.column(1))
                empty = np.linalg.norm(unit, axis=1) == 0
                unit = _unit(unit)
                cell, angle = np.full(len(unit), -1), np.zeros(len(unit))
                if len(near):
                    cosines = unit @ near.T
                    cell = np.where(empty, -1, cosines.argmax(axis=1))
                    angle = np.where(empty, 0.0, _angles(cosines.max(axis=1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)],
                    names=[item_id, vector, "cell", "angle"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"`{item_id}` {kinds[item_id]}, `{vector}` {kinds[vector]}, cell int, angle double"
    placed = settle(rows.mapInArrow(assign, schema), "placed")
    sizes = placed.groupBy("cell").count()
    # Angles that part a cell into shells of about equal size: as many as it needs.
    cuts = placed.groupBy("cell").agg(
        F.percentile_approx("angle", [n / 16 for n in range(1, 16)]).alias("quantiles")
    )
    parted = settle(
        sizes.join(cuts, "cell").select(
            "cell",
            F.array_distinct(
                F.filter(
                    "quantiles",
                    lambda q, n: (n + 1) % F.greatest(F.lit(1), F.floor(16 * F.lit(rows_per_shell) / F.col("count"))) == 0,
                )
            ).alias("cuts"),
        ),
        "cuts",
    )
    shell = F.size(F.filter("cuts", lambda c: F.col("angle") > c))
    stored = placed.join(parted, "cell").select(
        item_id, F.col(vector).alias("vector"), "cell", shell.alias("shell"), "angle",
        F.pmod(F.xxhash64(item_id), F.lit(max(1, math.ceil(count / ROWS_PER_SLICE)))).cast("int").alias("deal"),
    )
    # Many tasks may write into one cell: a third of all rows can be alike.
    stored.repartition("cell", "deal").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    table = [(n, c.tolist()) for n, c in enumerate(centres)]
    spark.createDataFrame(table, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    stored.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    summary = spark.read.schema(stored.schema).parquet(f"{path}/vectors").groupBy("cell", "shell")
    summary.agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("amount")
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/shells")
    return DenseIndex.load(spark, path, item_id)


def reach(centres: np.ndarray, shells: pa.Table, queries: np.ndarray) -> np.ndarray:
    """The largest cosine each unit query can have with a vector of each shell."""
    cell = shells.column("cell").to_numpy()
    low, high = shells.column("low").to_numpy(), shells.column("high").to_numpy()
    bound = np.zeros((len(queries), len(cell)))
    real = cell >= 0
    if real.any():
        apart = _angles(queries @ centres.T)[:, cell[real]]
        least = np.maximum(0.0, np.maximum(apart - high[real], low[real] - apart) - _ROUNDING)
        bound[:, real] = np.cos(least)
    bound[np.linalg.norm(queries, axis=1) == 0] = 0.0
    return bound


def _first(bound: np.ndarray, amounts: np.ndarray, k: int) -> np.ndarray:
    """The most promising shells of each query, with ``k`` vectors at least."""
    ranks = np.argsort(-bound, axis=1, kind="stable")
    before = np.cumsum(amounts[ranks], axis=1) - amounts[ranks]
    chosen = np.zeros(bound.shape, bool)
    np.put_along_axis(chosen, ranks, (before < k) | (np.arange(len(amounts)) < FIRST_SHELLS), axis=1)
    return chosen


def _choose(index: DenseIndex, queries: DataFrame, query_id: str, k: int, first: bool) -> DataFrame:
    """``query_id, cell, shell``: the first shells of each query, or the others
    that reach its column ``least``."""
    spark = index.spark
    sent = spark.sparkContext.broadcast((index.centres, index.shells))  # a row a shell
    kind = queries.schema[query_id].dataType
    schema = f"`{query_id}` {kind.simpleString()}, cell int, shell int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, shells = sent.value
        amounts = shells.column("amount").to_numpy()
        cells, numbers = (shells.column(c).combine_chunks() for c in ("cell", "shell"))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                units = _unit(_matrix(batch.column(1)))
                if len(centres) and units.shape[1] != centres.shape[1]:
                    raise ValueError(f"vectors of {centres.shape[1]} and of {units.shape[1]} numbers cannot be compared")
                bound = reach(centres, shells, units)
                chosen = _first(bound, amounts, k)
                if not first:
                    least = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    # Without a k-th score nothing is passed over.
                    chosen = ~(bound < least[:, None] - 10.0**-DIGITS) & ~chosen
                row, shell = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), cells.take(pa.array(shell)), numbers.take(pa.array(shell))],
                    names=[query_id, "cell", "shell"],
                )

    return queries.mapInArrow(run, schema)


def _scorer(out: pa.Schema, query_id: str, k: int):
    """Exact cosines of the vectors of one slice of a shell."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return out.empty_table()
        found, ids = _matrix(rows.column("vector")), _id_array(rows.column(0).combine_chunks())
        lengths = _lengths(found)
        tables = []
        for at in range(0, asked.num_rows, 256):
            some = asked.slice(at, 256)
            wanted = _matrix(some.column("_vector"))
            wanted = wanted / _lengths(wanted)
            best = BestK(some.num_rows, k)
            best.add(ids, np.round((found @ wanted.T) / lengths, DIGITS) + 0.0, None)
            tables.append(best.table(some.column(query_id).to_pylist(), out))
        return pa.concat_tables(tables)

    return run


def search(
    index: DenseIndex,
    queries: DataFrame,
    k: int = K.TOP_K,
    query_vector: str = "vector",
    query_id: str = "query_id",
) -> tuple[DataFrame, DataFrame]:
    """``query_id, item_id, dense_score, rank``, highest cosine first, and the
    ``query_id, cell, shell`` that were read for it.

    The same rows as a search of all vectors.  Query ids are unique; queries
    without a vector are left out, one of length zero scores 0 everywhere.
    Cells that no query chose are not read.
    """
    stored, item_id = index.stored, index.item_id
    asked = settle(
        queries.where(F.col(query_vector).isNotNull()).select(query_id, F.col(query_vector).alias("_vector")), "asked"
    )
    groups = max(1, math.ceil(asked.count() / QUERIES_AT_ONCE))
    kinds = {query_id: asked.schema[query_id].dataType, item_id: stored.schema[item_id].dataType}
    schema = f"`{query_id}` {kinds[query_id].simpleString()}, `{item_id}` {kinds[item_id].simpleString()}, score double"
    out = pa.schema([(n, to_arrow_type(t)) for n, t in kinds.items()] + [("score", pa.float64())])
    # A row a shell, MAX_CELLS times a few: how many slices each is cut into.
    amounts = zip(*(index.shells.column(c).to_pylist() for c in ("cell", "shell", "amount")))
    slices = F.broadcast(
        index.spark.createDataFrame(
            [(c, s, math.ceil(n / ROWS_PER_SLICE)) for c, s, n in amounts], "cell int, shell int, _slices int"
        )
    )

    def scored(chosen: DataFrame) -> DataFrame:
        cells = [row.cell for row in chosen.select("cell").distinct().collect()]  # MAX_CELLS at most
        keys = ["cell", "shell", "_slice", "_group"]
        rows = stored.where(F.col("cell").isin(cells)).join(slices, ["cell", "shell"]).select(
            item_id, "vector", "cell", "shell", F.pmod(F.xxhash64(item_id), F.col("_slices")).cast("int").alias("_slice"),
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"),
        )
        wanted = chosen.join(asked, query_id).join(slices, ["cell", "shell"]).select(
            query_id, "_vector", "cell", "shell", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"),
            F.pmod(F.xxhash64(query_id), F.lit(groups)).cast("int").alias("_group"),
        )
        return rows.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(_scorer(out, query_id, k), schema)

    first = settle(_choose(index, asked, query_id, k, True), "first")
    hits = settle(scored(first), "hits")
    order = [F.desc("score"), F.asc(item_id)]
    kth = top_k(hits, [query_id], order, k, "_n").where(F.col("_n") == k)
    left = asked.join(kth.select(query_id, F.col("score").alias("least")), query_id, "left")
    second = settle(_choose(index, left.select(query_id, "_vector", "least"), query_id, k, False), "second")
    found = top_k(hits.union(scored(second)), [query_id], order, k).withColumnRenamed("score", "dense_score")
    return found, first.union(second)
