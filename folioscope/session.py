"""Session set-up and the shared working folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


# A union of equally partitioned inputs may otherwise be zipped partition by
# partition, which fails when adaptive execution has merged partitions of one
# input only.
# Batches for Python are cut by their bytes: 10,000 long texts would make up to
# 64 MB, of which a worker holds several at a time.
RUNTIME_SETTINGS = {
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on to a given session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def get_session(app: str = "folioscope", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators count on.

    On a cluster the master, memory and shuffle partition count come from
    spark-submit; only semantic settings (time zone, AQE) are fixed here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def local_session(cores: int = 8, **conf) -> SparkSession:
    """Session for tests and the local benchmark."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    spark = get_session(master=f"local[{cores}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write.

    Taken from ``spark.checkpoint.dir``.  When that is unset a temporary
    folder is used, but only for a local master: on a cluster a machine-local
    folder would lose data, so the missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        return _local_dir()
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="folioscope-")


_scopes: list[list[str]] = []


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one run.

    It belongs to the innermost :func:`run_scope`, if there is one.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextlib.contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the run folders made inside when the block ends.

    Results that read them have to be written, or otherwise used up, inside.
    """
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        for path in made:
            delete_dir(spark, path)


def delete_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; nothing happens if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least one partition per core.

    A table that arrives as one small file would be worked on by one task.  A
    scan that already has enough partitions, as any large table does, is left
    alone and not shuffled.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written copy.

    Cuts the lineage: later steps neither repeat the work nor lose it with an
    executor.
    """
    path = new_run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HELD_ROWS = 20_000


def held(df: DataFrame, name: str, rows: int = HELD_ROWS) -> DataFrame:
    """As :func:`settle`, but a result of at most ``rows`` rows stays with the
    driver, which saves writing it.  The rows are counted first; only use it
    for rows of bounded width."""
    small = df.limit(rows + 1).toArrow()
    if small.num_rows > rows:
        return settle(df, name)
    return df.sparkSession.createDataFrame(small, df.schema)
