"""Whitened vectors: principal components from an exact characteristic polynomial."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .bpe import pieces
from .char_poly import (
    chinese_remainders,
    coefficient_bound,
    largest_roots,
    null_vectors,
    polynomials_modulo,
    primes_beyond,
)

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
PRIMES_A_TASK = 16
FRACTION_BITS = 64  # of the roots; vectors are solved with twice as many
LIMB = 60  # bits of the lower part of a sum
ROW_BLOCK = 4096
_WHOLE = T.DecimalType(38, 0)


def usable(vector: Column) -> Column:
    """Vectors with entries, all of them finite and small enough for a long."""
    most = float(2**62 // SCALE)
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < most)),
        F.lit(False),
    )


def _integers(column: pa.Array) -> np.ndarray:
    """floor(SCALE * c) of the entries, a row a vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(column), -1)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of columns, as Python numbers."""
    size = y.shape[1]
    total = np.zeros((size, size), object)
    most = int(np.abs(y).max(initial=0)) ** 2
    # Sums below 2 ** 53 are exact in floating point, below 2 ** 63 in longs.
    kind, room = (np.float64, 2**53) if most * 64 < 2**53 else (np.int64, 2**63)
    if most >= room:
        kind, room = object, most * ROW_BLOCK + 1
    step = max(1, min(ROW_BLOCK, (room - 1) // max(most, 1)))
    for at in range(0, len(y), step):
        block = y[at : at + step].astype(kind)
        part = block.T @ block
        total += (part.astype(np.int64) if kind is np.float64 else part).astype(object)
    return total


def _sums(df: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """Row count, sums of each dimension and of each product of two, exact.

    Tasks send size * (size + 3) / 2 + 1 numbers each, in two parts so that no
    sum leaves the decimals; Spark adds them up, and as many reach the driver.
    """
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in pieces(batches):
            y = _integers(batch.column(0))
            count += len(y)
            sums += y.astype(object).sum(axis=0) if len(y) else 0
            products += _products(y)
        values = [count, *sums.tolist(), *products[upper].tolist()] if count else []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(len(values)), pa.int64()),
                pa.array([Decimal(v >> LIMB) for v in values], pa.decimal128(38, 0)),
                pa.array([Decimal(v & ((1 << LIMB) - 1)) for v in values], pa.decimal128(38, 0)),
            ],
            names=["place", "high", "low"],
        )

    parts = df.mapInArrow(run, "place bigint, high decimal(38,0), low decimal(38,0)")
    added = parts.groupBy("place").agg(F.sum("high").cast(_WHOLE), F.sum("low").cast(_WHOLE)).collect()
    values = {row[0]: (int(row[1]) << LIMB) + int(row[2]) for row in added}
    matrix = [[0] * size for _ in range(size)]
    for k, (i, j) in enumerate(zip(*map(np.ndarray.tolist, upper))):
        matrix[i][j] = matrix[j][i] = values[1 + size + k]
    return values[0], [values[1 + k] for k in range(size)], matrix


def _polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """The exact characteristic polynomial: Spark spreads the primes, the
    driver joins the residues, a number a prime and coefficient."""
    primes = primes_beyond(2 * coefficient_bound(matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PRIMES_A_TASK):
                chosen = batch.column(0).to_pylist()[at : at + PRIMES_A_TASK]
                found = polynomials_modulo(matrix, chosen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chosen, pa.int64()), pa.array(list(found), pa.list_(pa.int64()))],
                    names=["prime", "residues"],
                )

    table = spark.createDataFrame([(p,) for p in primes], "prime bigint")
    spread = table.repartition(-(-len(primes) // PRIMES_A_TASK))
    rows = spread.mapInArrow(run, "prime bigint, residues array<bigint>").collect()
    return chinese_remainders([row.residues for row in rows], [row.prime for row in rows])


def _vectors(spark, matrix: list[list[int]], roots: list[tuple[int, int]]) -> np.ndarray:
    """Unit vectors of the roots, a row each; Spark spreads the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                made = null_vectors(matrix, *roots[number], FRACTION_BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(made), pa.int64()), pa.array(range(len(made)), pa.int64()),
                     pa.array(list(made), pa.list_(pa.float64()))],
                    names=["root", "number", "entries"],
                )

    table = spark.range(len(roots)).repartition(len(roots), "id")
    rows = table.mapInArrow(run, "root bigint, number bigint, entries array<double>").collect()
    return np.array([row.entries for row in sorted(rows, key=lambda r: (r.root, r.number))])


def components(spark, covariance: list[list[int]], wanted: int) -> tuple[list[Fraction], np.ndarray]:
    """Largest positive eigenvalues of an integer scatter matrix, and their unit
    vectors as rows; fewer than ``wanted`` if the rank is lower."""
    roots = largest_roots(_polynomial(spark, covariance), wanted, FRACTION_BITS)
    if not roots:
        return [], np.empty((0, len(covariance)))
    values = [Fraction(root, 1 << FRACTION_BITS) for root, times in roots for _ in range(times)]
    return values[:wanted], _vectors(spark, covariance, roots)[:wanted]


def whiten(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS
) -> DataFrame:
    """A row for each usable vector and each of its ``wanted`` components.

    Entries become whole numbers, floor(1024 c) + 100000; the components are
    those of their covariance over all usable vectors, by falling eigenvalue.
    Columns: ``id_col``, ``component`` from 1, ``n``, ``deviation`` (sum of
    squares of n x - S over the dimensions, null if it leaves the longs),
    ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, empty or holds a null, infinite, not-a-number
    or enormous entry (no long) are left out; so are rows whose number of
    dimensions is not the commonest one (ties: the larger).  Repeated rows
    count as often as they occur, a null id is an id, further columns are not
    read.  Components with eigenvalue 0 are left out: a table of equal vectors,
    of one row or of none gives no rows.  A repeated eigenvalue gets orthogonal
    vectors.  Each vector's largest entry is positive.

    The driver holds numbers in proportion to the square of the dimensions.
    """
    spark = df.sparkSession
    names = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}"
    schema = (
        f"{names}, component int, n bigint, deviation bigint, whitened double, explained double, "
        "identity_error double"
    )
    valid = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    lengths = valid.groupBy(F.size("vector").alias("size")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["size"]
    valid = valid.where(F.size("vector") == size)
    count, sums, products = _sums(valid.select("vector"), size)
    covariance = [[count * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    values, vectors = components(spark, covariance, wanted)
    if not values:
        return spark.createDataFrame([], schema)

    square = count * count
    trace = sum(covariance[k][k] for k in range(size))
    explained = [float(v / trace) for v in values]
    turned = (vectors / np.sqrt([[float(v / square)] for v in values])).T
    kind = df.schema[id_col].dataType
    fits = max(map(abs, sums)) < 2**62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            y = _integers(batch.column(1))
            if fits and int(np.abs(y).max(initial=0)) * count < 2**62:
                off = count * y - np.array(sums, np.int64)
            else:
                off = count * y.astype(object) - np.array(sums, object)
            most = max(map(abs, (off.max(initial=0), off.min(initial=0))))
            exact = off if int(most) ** 2 * size < 2**63 else off.astype(object)
            squares = [v if v < 2**63 else None for v in (exact * exact).sum(axis=1).tolist()]
            projected = (off / count).astype(np.float64) @ turned
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(squares, pa.int64()), pa.array(list(projected), pa.list_(pa.float64()))],
                names=["id", "deviation", "whitened"],
            )

    wide = T.StructType(
        [T.StructField("id", kind), T.StructField("deviation", T.LongType()),
         T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )
    rows = settle(valid.mapInArrow(run, wide), "whitened")
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    measured = rows.agg(
        *(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) for i, j in pairs)
    ).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(measured, pairs))
    shares = F.array(*map(F.lit, explained))
    return rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(count).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_embedding_whitening(spark, folder):
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
ORACLE: dict[str, str] = {}
