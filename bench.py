"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioscope import catalog  # noqa: E402
from folioscope.session import local_session, run_scope  # noqa: E402

HEADLINE = (
    "clean_text",
    "chunk_windows",
    "chunk_pages",
    "bm25_idf",
    "retrieve_bm25",
    "bm25_stored_index",
    "retrieve_dense",
    "fuse_rrf",
    "fuse_relative",
    "retrieve_dense_postfilter",
    "mode_comparison",
    "k_sweep",
    "html_headings",
    "duplicate_chunk_text",
    "chunk_overlaps",
    "validation_report",
    "build_context",
    "upsert_latest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = tuple(chosen.split(",")) if chosen else HEADLINE
    spark = local_session(cores)
    queries = catalog.queries()
    # Compiled code and Python workers are there before the first timing.
    warm = spark.range(100_000).repartition(cores).selectExpr("id", "cast(id AS string) AS text")
    warm.mapInArrow(lambda batches: batches, warm.schema).groupBy("text").count().count()
    first = "/root/testdata/sf0.001"
    for name in names[:3] if os.path.isdir(first) else ():
        queries[name](spark, first).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        with run_scope(spark):
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
