"""Stored indexes: equal to a scan of everything, and what they need not read."""

import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioscope.functions.tokens import search_terms
from folioscope.operators import dense, dense_index, lexical, postings, terms
from folioscope.session import new_run_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXTS = "chunk_id int, text string"
WORDS = [f"w{k}" for k in range(300)]
SMALL = {"block_documents": 16, "terms_per_part": 2000}


def document(rnd, longest=60):
    weights = [1 / (1 + n) for n in range(len(WORDS))]
    return " ".join(rnd.choices(WORDS, weights, k=rnd.randint(0, longest)))


def asked(spark, rnd, docs):
    texts = [document(rnd, 20) for _ in range(25)]
    texts += ["w299", "zzz w1", "w1 w1 w2", "w290 w280", "", "unknown words only", docs[3][1]]
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "bm25_score").collect()))


def same_as_scan(spark, path, docs, queries, k=7):
    index = postings.PostingIndex.open(spark, path)
    got = rows(lexical.bm25_top_k(None, queries, k, index=index))
    scan = rows(lexical.bm25_top_k(spark.createDataFrame(docs, TEXTS), queries, k))
    assert [r[:3] for r in got] == [r[:3] for r in scan]
    assert np.allclose([r[3] for r in got], [r[3] for r in scan], atol=2e-6)
    assert index.n_docs == len(docs)
    return index


def test_postings_equal_a_scan(spark):
    rnd = random.Random(3)
    docs = [(k, document(rnd)) for k in range(400)] + [(1000, None), (1001, "")]
    path = new_run_dir(spark, "postings")
    postings.add(spark.createDataFrame(docs + [(None, "w1")], TEXTS), path, **SMALL)
    queries = asked(spark, rnd, docs)
    index = same_as_scan(spark, path, docs, queries)
    weights = lexical.query_weights(queries, index)
    narrow = postings.search(index, weights, 7, query_rows=20)[0]
    assert sorted(map(tuple, narrow.select("query_id", "rank", "chunk_id").collect())) == [
        r[:3] for r in rows(lexical.bm25_top_k(None, queries, 7, index=index))
    ]


def test_blocks_are_skipped_and_only_asked_parts_are_read(spark):
    """A word of few documents decides: blocks that only have the common one
    cannot reach the k-th score."""
    rnd = random.Random(8)
    docs = [(k, " ".join(rnd.choices([f"t{k % 40}x{j}" for j in range(8)], k=20)) + " common") for k in range(4000)]
    docs[77] = (77, docs[77][1] + " w7777")
    rare = [(4000 + k, "rare gem common") for k in range(10)]
    path = new_run_dir(spark, "postings")
    postings.add(spark.createDataFrame(docs + rare, TEXTS), path, **SMALL)
    index = postings.PostingIndex.open(spark, path)
    queries = spark.createDataFrame([(1, "common rare gem"), (2, "w7777 common")], "query_id int, query string")
    weights = lexical.query_weights(queries, index)
    hits, seen = postings.search(index, weights, 5)
    assert sorted(r.chunk_id for r in hits.where("query_id = 1").collect()) == [r[0] for r in rare[:5]]
    bounds = {r.query_id: r["count"] for r in seen["bounds"].groupBy("query_id").count().collect()}
    read = {r.query_id: r["count"] for r in seen["read"].groupBy("query_id").count().collect()}
    assert bounds[1] > 100 and read[1] < 20
    assert hits.where("query_id = 2 AND rank = 1").first().chunk_id == 77
    parts = {s.parts for s in index.segments}
    assert parts == {index.segments[0].parts} and index.segments[0].parts > 30
    plan = postings._asked(index, weights)._jdf.queryExecution().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "part#" in filters and "segment#" in filters
    read_parts = {r.part for r in postings._asked(index, weights).select("part").distinct().collect()}
    assert len(read_parts) <= 5


def test_most_terms_everywhere(spark):
    """A negative floor of idf: such an index is scanned."""
    docs = [(k, "a1 b1 c1" if k else "a1") for k in range(9)]
    path = new_run_dir(spark, "postings")
    postings.add(spark.createDataFrame(docs, TEXTS), path)
    queries = spark.createDataFrame([(1, "a1 b1"), (2, "nothing")], "query_id int, query string")
    index = same_as_scan(spark, path, docs, queries)
    assert index.idf_floor < 0


def test_growing_index(spark):
    rnd = random.Random(5)
    old = [(k, document(rnd)) for k in range(300)]
    changed = [(k, document(rnd)) for k in range(150, 200)]
    path = new_run_dir(spark, "segments")
    postings.add(spark.createDataFrame(old[:170], TEXTS), path, **SMALL)
    postings.add(spark.createDataFrame(old[170:], TEXTS), path, **SMALL)
    queries = asked(spark, rnd, old)
    same_as_scan(spark, path, old, queries)
    postings.add(spark.createDataFrame(changed, TEXTS), path, **SMALL)
    postings.remove(spark.createDataFrame([(5,), (160,), (7777,), (5,)], "chunk_id int"), path)
    now = {**dict(old), **dict(changed)}
    del now[5], now[160]
    same_as_scan(spark, path, list(now.items()), queries)
    back = [(5, document(rnd)), (900, "w299 w298")]
    postings.add(spark.createDataFrame(back, TEXTS), path)
    now |= dict(back)
    same_as_scan(spark, path, list(now.items()), queries)
    assert postings.merge(spark, path, smaller=100) == [1, 2, 3, 4, 5]
    index = same_as_scan(spark, path, list(now.items()), queries)
    assert len(index.segments) == 1 and postings.merge(spark, path) == []


def test_merge_of_newer_segments_keeps_removals(spark):
    rnd = random.Random(6)
    docs = [(k, document(rnd)) for k in range(260)]
    path = new_run_dir(spark, "segments")
    postings.add(spark.createDataFrame(docs[:200], TEXTS), path)
    now = dict(docs[:200])
    for n in range(3):  # each replaces ten of the first and brings ten new ones
        batch = [(k, document(rnd)) for k in [*range(n * 10, n * 10 + 10), *range(200 + n * 10, 210 + n * 10)]]
        postings.add(spark.createDataFrame(batch, TEXTS), path)
        now |= dict(batch)
    assert postings.merge(spark, path, smaller=2) == [2, 3, 4]
    queries = asked(spark, rnd, docs)
    index = same_as_scan(spark, path, list(now.items()), queries)
    assert [s.segment for s in index.segments] == [1, 5]


def test_a_batch_cut_short_leaves_no_trace(spark, monkeypatch):
    rnd = random.Random(7)
    docs = [(k, document(rnd)) for k in range(60)]
    path = new_run_dir(spark, "segments")
    postings.add(spark.createDataFrame(docs[:40], TEXTS), path)
    queries = asked(spark, rnd, docs)
    whole = postings._write

    def stops(df, folder, name, *rest):
        if name == "totals":
            raise RuntimeError("cut short")
        return whole(df, folder, name, *rest)

    monkeypatch.setattr(postings, "_write", stops)
    with pytest.raises(RuntimeError):
        postings.add(spark.createDataFrame(docs[40:], TEXTS), path)
    monkeypatch.setattr(postings, "_write", whole)
    same_as_scan(spark, path, docs[:40], queries)
    postings.add(spark.createDataFrame(docs[40:], TEXTS), path)
    same_as_scan(spark, path, docs, queries)


def test_terms_are_kept_once_and_blocks_are_joined(spark):
    """Documents and removals are listed without their terms, a block's terms
    of a part lie in one row, and small blocks are put together by a merge."""
    rnd = random.Random(9)
    docs = [(f"d{k}", document(rnd)) for k in range(240)]
    kind = "chunk_id string, text string"
    path = new_run_dir(spark, "segments")
    for n in range(0, 240, 60):
        postings.add(spark.createDataFrame(docs[n : n + 60], kind), path, terms_per_part=2000)
    postings.add(spark.createDataFrame([], kind), path)
    postings.add(spark.createDataFrame(docs[:30], kind), path)
    postings.remove(spark.createDataFrame(docs[30:40], kind), path)
    assert "terms" not in spark.read.parquet(f"{path}/items").columns
    assert "terms" not in spark.read.parquet(f"{path}/removed").columns
    rows = spark.read.parquet(f"{path}/postings").where("part >= 0")
    assert rows.count() == rows.select("segment", "part", "block").distinct().count()
    queries = asked(spark, rnd, docs)
    left = docs[:30] + docs[40:]

    def same():
        index = postings.PostingIndex.open(spark, path)
        got = rows_of(lexical.bm25_top_k(None, queries, 7, index=index))
        assert got == rows_of(lexical.bm25_top_k(spark.createDataFrame(left, kind), queries, 7))
        return index

    def rows_of(df):
        return [r[:3] for r in rows_sorted(df)]

    def rows_sorted(df):
        return sorted(map(tuple, df.select("query_id", "rank", "chunk_id").collect()))

    before = same().items().select("segment", "block").distinct().count()
    assert postings.merge(spark, path, smaller=100) == [1, 2, 3, 4, 5, 6, 7]
    index = same()
    after = index.items().select("block").distinct().count()
    assert before > 20 and after <= 10
    words = {r.chunk_id: sorted(r.terms) for r in index.texts().collect()}
    assert words == {name: sorted(text.split()) for name, text in left}


def test_scan_of_an_index_with_removals(spark):
    docs = [(k, "a1 b1 c1 c1" if k else "a1") for k in range(9)] + [(9, "")]
    path = new_run_dir(spark, "postings")
    postings.add(spark.createDataFrame(docs, TEXTS), path)
    postings.remove(spark.createDataFrame([(4,)], "chunk_id int"), path)
    queries = spark.createDataFrame([(1, "a1 c1"), (2, "nothing")], "query_id int, query string")
    assert same_as_scan(spark, path, [d for d in docs if d[0] != 4], queries).idf_floor < 0


def test_posting_rows_grow_with_the_texts(spark):
    """Blocks made together share a row of each part: there are not as many
    rows as parts times blocks."""
    rnd = random.Random(10)
    docs = [(k, document(rnd)) for k in range(1000)]
    path = new_run_dir(spark, "postings")
    postings.add(spark.createDataFrame(docs, TEXTS).coalesce(1), path, block_documents=16, terms_per_part=500)
    index = same_as_scan(spark, path, docs, asked(spark, rnd, docs))
    blocks = index.items().select("block").distinct().count()
    rows = postings._postings(spark, path, index.segments)
    parts = rows.select("part").distinct().count()
    assert blocks >= 60 and parts >= 30
    assert rows.count() <= parts * -(-blocks // postings.BLOCKS_AT_ONCE)


def test_counts_of_all_sizes_and_parts_of_all_terms(spark):
    """Counts over a byte, terms of any length, and removals behind them."""
    docs = [(0, "a1 " * 254 + "b1"), (1, "a1 " * 255), (2, "a1 " * 70000 + "c1 c1"), (3, "q" * 500 + " c1")]
    docs += [(k, f"d{k} c1" if k % 2 else f"d{k}") for k in range(4, 30)]
    path = new_run_dir(spark, "postings")
    postings.add(spark.createDataFrame(docs[:16], TEXTS), path, terms_per_part=2)
    postings.add(spark.createDataFrame(docs[16:], TEXTS), path)
    postings.remove(spark.createDataFrame([(1,), (29,)], "chunk_id int"), path)
    left = [d for d in docs if d[0] not in (1, 29)]
    queries = spark.createDataFrame([(1, "a1 c1"), (2, "q" * 500), (3, "d28 d7 b1")], "query_id int, query string")
    same_as_scan(spark, path, left, queries)
    assert postings.merge(spark, path, smaller=100) == [1, 2, 3]
    index = same_as_scan(spark, path, left, queries)
    assert {r.chunk_id: sorted(r.terms) for r in index.texts().collect()} == {k: sorted(t.split()) for k, t in left}
    words = pa.array(["a1", "", "q" * 500, "x" * 64, "y" * 65, "é"])
    assert postings._parts_of(words, 4096).tolist() == [zlib.crc32(w.encode()) % 4096 for w in words.to_pylist()]


def test_terms_cut_by_bytes_are_those_of_the_expression(spark):
    rnd = random.Random(11)
    signs = "abcxyz019ABZ--//__ .'ñóßÿŁłÀ×÷éɏ«ªº²µİ–’€中‍α٣ͅ𝒳😀"
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 40))) for _ in range(3000)] + [None, "", "a", "-", "1-", "-a-b/"]
    every = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts += [f"ab{c}cd {c}ef gh{c} ij-{c}kl mn{c}-op{c}" for c in every]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    table = df.select(terms.lowered(F.col("text")).alias("low"), search_terms(F.col("text")).alias("terms")).toArrow()
    words = terms.word_table(terms.word_characters(spark))
    values, counts = terms.cut_terms(table.column("low").combine_chunks(), words)
    wanted = table.column("terms").combine_chunks()
    assert counts.tolist() == wanted.value_lengths().to_pylist()
    assert values.to_pylist() == wanted.flatten().to_pylist()


# -- vectors ------------------------------------------------------------------

VECTORS = "chunk_id int, embedding array<double>"
ASKED = "query_id int, vector array<double>"


def clustered(rng, count, size=16, groups=30, noise=0.05):
    centres = rng.normal(size=(groups, size))
    return (centres[rng.integers(0, groups, count)] + noise * rng.normal(size=(count, size))).tolist()


@pytest.mark.parametrize("limits", [{}, {"ROWS_PER_SLICE": 50, "QUERIES_AT_ONCE": 9}])
def test_vector_index_equals_a_scan(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(dense_index, name, value)
    rng = np.random.default_rng(2)
    values = clustered(rng, 3000)
    odd = [(5000, [0.0] * 16), (5001, None), *[(5100 + n, [1.0] * 16) for n in range(400)]]
    vectors = spark.createDataFrame(list(enumerate(values)) + odd, VECTORS)
    questions = [(n, v) for n, v in enumerate(clustered(rng, 30) + values[:5] + [[0.0] * 16, [2.0] * 16, [-1.0] * 16])]
    queries = spark.createDataFrame(questions + [(99, None)], ASKED)
    path = new_run_dir(spark, "vectors")
    index = dense_index.build_index(vectors, path, rows_per_shell=64)
    got = dense.dense_top_k(None, queries, 6, index=index)
    scan = dense.dense_top_k(vectors, queries, 6)
    assert got.columns == scan.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scan.collect()))


def test_shells_are_passed_over(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame(list(enumerate(clustered(rng, 4000, groups=40))), VECTORS)
    queries = spark.createDataFrame(list(enumerate(clustered(np.random.default_rng(3), 20, groups=40))), ASKED)
    index = dense_index.build_index(vectors, new_run_dir(spark, "vectors"), cells=40, rows_per_shell=50)
    read = dense_index.search(index, queries, 5)[1].count()
    assert index.shells.num_rows > 60 and read < 20 * index.shells.num_rows / 5


def test_reach_is_never_below_a_cosine():
    rng = np.random.default_rng(4)
    values = dense_index._unit(np.array(clustered(rng, 500, groups=9)))
    centres = dense_index.fit_centres(values, 9)
    cosines = values @ centres.T
    cell, angle = cosines.argmax(axis=1), dense_index._angles(cosines.max(axis=1))
    import pyarrow as pa

    shells = pa.table({"cell": cell, "shell": np.arange(500), "low": angle, "high": angle})
    queries = dense_index._unit(rng.normal(size=(50, 16)))
    assert (dense_index.reach(centres, shells, queries) >= queries @ values.T - 1e-12).all()


@pytest.mark.parametrize("values", [[], [(1, [0.0, 0.0])], [(1, [1.0, 0.0])]])
def test_vector_index_of_next_to_nothing(spark, values):
    vectors = spark.createDataFrame(values, VECTORS)
    index = dense_index.build_index(vectors, new_run_dir(spark, "vectors"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], ASKED)
    got = dense.dense_top_k(None, queries, 3, index=index).collect()
    assert [r.chunk_id for r in got] == [i for i, _ in values]
