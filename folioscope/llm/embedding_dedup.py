"""Near-duplicate vectors: a small-world graph per shard, every shard queried."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .components import components
from .hnsw import Graph, links_within

SHARD = 16_384  # vectors of one graph at most, about
BLOCK = 2_048  # queries that travel together
BEAM = 48
AUDIT_RECALL = 0.97
SLACK = 1e-3  # graphs hold single precision; links are confirmed in double


def _runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Neighbouring rows with equal keys; they may lie in several batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            now = tuple(columns[:, start])
            if rest and now != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(start, end - start))
            last = now
    if rest:
        yield pa.Table.from_batches(rest)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, "id")


def build_graphs(vectors: DataFrame) -> DataFrame:
    """``label, dim, shard`` and the stored graph of each shard.

    ``vectors`` has ``id, label, dim, shard, vector``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("label", "dim", "shard")):
            own = _matrix(rows.column("vector"))
            graph, order = Graph.build(_unit(own))
            stored = graph.to_bytes(ids=rows.column("id").to_numpy()[order], own=own[order])
            head = [rows.column(k).slice(0, 1).combine_chunks() for k in ("label", "dim", "shard")]
            yield pa.RecordBatch.from_arrays(
                [*head, pa.array([stored], pa.binary())], names=["label", "dim", "shard", "graph"]
            )

    keys = ("label", "dim", "shard")
    return _grouped(vectors, keys).mapInArrow(run, "label bigint, dim int, shard int, graph binary")


def query_blocks(vectors: DataFrame) -> DataFrame:
    """``label, dim, block`` with the ids and vectors of bounded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("label", "dim", "block")):
            own = _matrix(rows.column("vector"))
            head = [rows.column(k).slice(0, 1).combine_chunks() for k in ("label", "dim", "block")]
            ids = rows.column("id").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*head, pa.array([ids.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())],
                names=["label", "dim", "block", "ids", "own"],
            )

    keys = ("label", "dim", "block")
    return _grouped(vectors, keys).mapInArrow(
        run, "label bigint, dim int, block int, ids binary, own binary"
    )


def find_links(pairs: DataFrame, threshold: float, target: float) -> DataFrame:
    """``a < b`` linked ids of each (graph, block) row, confirmed in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                graph, kept = Graph.from_bytes(batch.column("graph")[row].as_py())
                ids = np.frombuffer(batch.column("ids")[row].as_py(), np.int64)
                own = np.frombuffer(batch.column("own")[row].as_py()).reshape(len(ids), -1)
                (query, node), _ = links_within(graph, _unit(own), threshold - SLACK, BEAM, target)
                left, right = own[query], kept["own"][node]
                dots = np.einsum("ed,ed->e", left, right)
                sizes = np.sqrt(np.einsum("ed,ed->e", left, left) * np.einsum("ed,ed->e", right, right))
                a, b = ids[query], kept["ids"][node]
                good = (dots / sizes >= threshold) & (a != b)
                a, b = np.minimum(a, b)[good], np.maximum(a, b)[good]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return pairs.select("graph", "ids", "own").mapInArrow(run, "a bigint, b bigint").distinct()


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    threshold: float = 0.93,
    target: float = AUDIT_RECALL,
) -> DataFrame:
    """One row per input row: the id, ``n_links``, ``component_id``, ``kept``.

    Equal vectors of a label are one class with its smallest id as name; they
    are linked with each other without being compared.  The classes of a label
    are hashed into shards of bounded size, each with a graph of its own, and
    into blocks of queries.  Every block is sent to every shard of its label.
    Beams are widened until an audit against the whole shard finds at least
    ``target`` of the links; a link counts when either side finds it.

    A null label, or a vector that is null, empty, zero or has null or
    non-finite numbers, is linked with nothing.  Vectors of different lengths
    are not compared.  Rows that repeat id and vector count as two vectors.  A
    null id names no class and takes part in no link unless its vector equals
    another one's.
    """
    v = F.col("vector")
    fine = (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull()
    rows = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"),
        # Adding zero makes the two zeros one.
        F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"),
    ).withColumn("fine", F.coalesce(fine, F.lit(False)))
    keyed = rows.select(
        "id",
        F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("vector").cast("array<string>")), 256)).alias("key"),
        "label",
        F.when(F.col("fine"), v).alias("vector"),
    )
    classes = settle(
        keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")),
        "vector_classes",
    )
    named = classes.where("class is not null").select(F.col("class").alias("id"), "key")
    chosen = keyed.join(named, ["id", "key"]).dropDuplicates(["id", "key"]).withColumn("dim", F.size("vector"))
    # One row per label and length.
    sizes = chosen.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("_n"))
    shards, blocks = F.ceil(F.col("_n") / SHARD), F.ceil(F.col("_n") / BLOCK)
    placed = settle(
        chosen.join(sizes, ["label", "dim"]).select(
            "id",
            "label",
            "dim",
            "vector",
            F.pmod(F.xxhash64("id"), shards).cast("int").alias("shard"),
            F.pmod(F.hash("id"), blocks).cast("int").alias("block"),
            shards.cast("int").alias("shards"),
        ),
        "vector_shards",
    )
    graphs = settle(build_graphs(placed.drop("block", "shards")), "vector_graphs")
    counts = placed.select("label", "dim", "shards").distinct()
    sent = (
        query_blocks(placed.drop("shard", "shards"))
        .join(counts, ["label", "dim"])
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    )
    meet = sent.join(graphs, ["label", "dim", "shard"])
    links = settle(find_links(meet, threshold, target), "vector_links")
    parts = components(links, "a", "b")
    size_of = classes.select(F.col("class").alias("to"), "n")
    both = links.select("a", F.col("b").alias("to")).unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("to")))
    linked = both.join(size_of, "to").groupBy("a").agg(F.sum("n").alias("others"))
    known = (
        classes.join(linked.withColumnRenamed("a", "class"), "class", "left")
        .join(parts.withColumnRenamed("node", "class"), "class", "left")
        .select(
            "key",
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "class").alias("component"),
        )
    )
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return (
        keyed.select("id", "key")
        .join(known, "key", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            component.alias("component_id"),
            F.col("id").eqNullSafe(component).alias("kept"),
        )
    )


def op6_embedding_near_dedup(spark, folder):
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {"op6_embedding_near_dedup": op6_embedding_near_dedup}
ORACLE: dict[str, str] = {}
