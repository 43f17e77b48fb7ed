"""Near-duplicate texts: MinHash bands, odd sketches, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .components import components
from .shingles import MinHasher, Shingler, differing_bits, most_differing_bits

WORDS = 5
THRESHOLD = 75  # percent, shared of all shingles
# A pair at the threshold shares at least one of 32 bands of 4 samples with
# probability 1 - 6e-6.
BANDS, ROWS = 32, 4
BINS, BITS = 2048, 2048
# Pairs whose sketches differ by this many standard deviations more than those
# of a pair at the threshold are put aside.
DEVIATIONS = 5
MEMBERS = 512  # rows of a bucket that are compared as one block


def signatures(df: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``id``, ``n_shingles``, ``set_key``, ``bands``, ``sketch`` and ``samples`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        shingler, hasher = Shingler(words), MinHasher(BANDS, ROWS, BINS, BITS)
        for batch in batches:
            counts, keys, bands, sketches, samples = [], [], [], [], []
            for text in batch.column(1):
                found = shingler.shingles(text.as_py())
                counts.append(len(found))
                if not len(found):
                    for column in (keys, bands, sketches, samples):
                        column.append(None)
                    continue
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bands.append(hasher.band_keys(found))
                sketch, kept = hasher.odd_sketch(found)
                sketches.append(sketch)
                samples.append(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()),
                    pa.array(samples, pa.int32()),
                ],
                names=["id", "n_shingles", "set_key", "bands", "sketch", "samples"],
            )

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run,
        "id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary, samples int",
    )


def shingle_sets(df: DataFrame, words: int = WORDS) -> DataFrame:
    """``id`` and the whole set of hashed shingles of ``id, text`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(batch.num_rows):
                found = shingler.shingles(batch.column(1)[at].as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1), pa.array([found], pa.list_(pa.int64()))],
                    names=["id", "shingles"],
                )

    return df.select("id", "text").mapInArrow(run, "id bigint, shingles array<bigint>")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Bucket members dealt to pairs of blocks of bounded size.

    ``members`` has ``key``, ``n`` (rows of the bucket) and row columns.  The
    rows of a bucket are hashed into blocks; each pair of blocks is one group
    of at most about 2 x MEMBERS rows, so a bucket of any size is spread over
    the cluster.
    """
    blocks = F.ceil(F.col("n") / MEMBERS).cast("int")
    own = members.withColumn("_blocks", blocks).withColumn(
        "_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = own.withColumn("_other", other)
    return (
        dealt.withColumn("_p", F.least("_own", "_other"))
        .withColumn("_q", F.greatest("_own", "_other"))
        .drop("_blocks", "_other")
        .repartition("key", "_p", "_q")
        .sortWithinPartitions("key", "_p", "_q")
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (key, _p, _q) at a time; they may lie in several batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "_p", "_q")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            now = tuple(key[:, start])
            if rest and now != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(start, end - start))
            last = now
    if rest:
        yield pa.Table.from_batches(rest)


def _compare(dealt: DataFrame, percent: int, across: bool) -> DataFrame:
    """Pairs of ids whose sketches are similar enough, from each block pair.

    Without ``across`` every row names its most similar partner only.  With
    it, all pairs of different components are named, each in the first bucket
    that both share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if group.num_rows < 2:
                continue
            ids = group.column("id").to_numpy()
            own = group.column("_own").to_numpy()
            sizes, samples = group.column("n_shingles").to_numpy(), group.column("samples").to_numpy()
            joined = b"".join(group.column("sketch").to_pylist())
            sketches = np.frombuffer(joined, np.uint64).reshape(len(ids), BITS // 64)
            p, q = group.column("_p")[0].as_py(), group.column("_q")[0].as_py()
            left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
            if not len(left) or not len(right):
                continue
            differ = differing_bits(sketches[left], sketches[right])
            most = most_differing_bits(
                sizes[left], samples[left], sizes[right], samples[right], percent / 100, BINS, BITS, DEVIATIONS
            )
            # The smaller the share of the bits a pair may differ in, the nearer.
            alike = 1 - differ / most
            alike[ids[left][:, None] == ids[right][None, :]] = -1
            if across:
                part = group.column("component").to_numpy()
                alike[part[left][:, None] == part[right][None, :]] = -1
                at, to = np.nonzero(alike >= 0)
                bands = np.stack(group.column("bands").to_numpy())
                first = (bands[left[at]] == bands[right[to]]).argmax(axis=1)
                here = bands[left[at], first] == group.column("key")[0].as_py()
                at, to = at[here], to[here]
            else:
                rows, columns = np.arange(len(left)), np.arange(len(right))
                nearest, nearest_back = alike.argmax(axis=1), alike.argmax(axis=0)
                at = np.concatenate([rows, nearest_back])
                to = np.concatenate([nearest, columns])
                good = alike[at, to] >= 0
                at, to = at[good], to[good]
            if len(at):
                a, b = ids[left][at], ids[right][to]
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets share enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    all_of = F.size("sa") + F.size("sb") - F.col("shared")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("shared", shared)
        .where(F.lit(100) * F.col("shared") >= F.lit(percent) * all_of)
        .select("a", "b")
    )


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    words: int = WORDS,
    percent: int = THRESHOLD,
) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id``, ``kept``.

    1. Rows with one shingle set are one class, named by its smallest id.
    2. Classes that share a band key meet in a bucket.  Inside a bucket the
       odd sketches are compared, and each class names its nearest partner
       there.  These links are confirmed on the whole shingle sets and joined
       to components.
    3. In buckets that still hold several components, all pairs of different
       components whose sketches are similar enough are confirmed as well.
       Only pairs that are already connected are left out.

    A bucket is compared in pairs of blocks of bounded size; no pair leaves
    its task before the sketch comparison.  Whole sets are read for classes
    with a near partner only.

    A null or empty text, or one of white space, has no shingles, is linked
    with nothing and is kept.  Shorter texts than a shingle count as one
    shingle.  Rows that repeat an id and text stay as they are; rows that
    repeat an id with another text take the component of their own text.  A
    null id is never a component's name.  An empty table gives no rows.
    """
    if percent < 70:
        raise ValueError("bands and sketches are laid out for thresholds of 70 percent and more")
    found = settle(signatures(df, id_col, text_col, words), "signatures")
    keyed = found.where("n_shingles > 0")
    classes = settle(keyed.groupBy("set_key").agg(F.min("id").alias("class")), "classes")
    named = classes.where("class is not null").select(F.col("class").alias("id"), "set_key")
    reps = settle(
        keyed.join(named, ["id", "set_key"])
        .dropDuplicates(["id", "set_key"])
        .select("id", "n_shingles", "bands", "sketch", "samples"),
        "representatives",
    )
    placed = reps.select("id", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settle(placed.join(shared, "key"), "members")
    sketched = members.join(reps.drop("bands"), "id")
    first = settle(_compare(_in_blocks(sketched), percent, across=False), "nearest")
    near = settle(
        first.select("a").unionAll(first.select("b")).distinct().withColumnRenamed("a", "id"), "near_ids"
    )
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sets = settle(shingle_sets(texts.join(near, "id"), words), "shingle_sets")
    links = settle(_confirm(first, sets, percent), "near_links")
    parts = components(links, "a", "b")

    labels = near.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )
    labelled = members.select("id", "key").join(labels, "id")
    mixed = (
        labelled.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
        .where("x <> y")
        .select("key", "n")
    )
    open_members = labelled.join(mixed, "key").join(reps, "id")
    more = settle(_compare(_in_blocks(open_members), percent, across=True), "across")
    late = _confirm(more, sets, percent)
    named_a = labels.select(F.col("id").alias("a"), F.col("component").alias("x"))
    named_b = labels.select(F.col("id").alias("b"), F.col("component").alias("y"))
    bridges = settle(late.join(named_a, "a").join(named_b, "b").select("x", "y").distinct(), "bridges")
    merged = components(bridges, "x", "y").select(
        F.col("node").alias("component"), F.col("component").alias("to")
    )
    final = (
        labels.join(merged, "component", "left")
        .select(F.col("id").alias("class"), F.coalesce("to", "component").alias("component"))
    )
    named_sets = classes.join(final, "class", "left").select(
        "set_key", F.coalesce("component", "class").alias("component")
    )
    rows = found.select("id", "n_shingles", "set_key").join(named_sets, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def op10_minhash_near_dedup(spark, folder):
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
ORACLE: dict[str, str] = {}
