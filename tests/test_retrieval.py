"""Search against brute force, both ways of the search engine, fusion, targets."""

import math
import random
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from folioscope.operators import context, dense, evaluation, fusion, lexical, targets
from folioscope.plans.ask import ask
from folioscope.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = ["drug", "dose", "bp", "140/90", "renal", "adult", "risk", "salt", "5", "the"]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(n)]


def bm25(corpus, query):
    docs = [[t for t in re.findall(r"\b[a-z0-9]+(?:[-/][a-z0-9]+)*\b", c.lower()) if len(t) > 1 or t.isdigit()] for c in corpus]
    asked = [t for t in re.findall(r"\b[a-z0-9]+(?:[-/][a-z0-9]+)*\b", query.lower()) if len(t) > 1 or t.isdigit()]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    return [
        sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in asked)
        for d in docs
    ]


@pytest.mark.parametrize("limits", [{}, {"max_shipped": 3, "rows_per_block": 7}])
def test_bm25(spark, limits):
    corpus, asked = texts(40, 1), texts(6, 2) + ["nothing known", "!!"]
    c = spark.createDataFrame(list(enumerate(corpus)), "chunk_id bigint, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query string")
    got = {}
    for r in lexical.bm25_top_k(c, q, 7, **limits).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.bm25_score))
    assert 7 not in got  # no terms, no hits
    for i, text in enumerate(asked[:7]):
        scores = [round(s, 6) for s in bm25(corpus, text)]
        best = sorted(range(40), key=lambda d: (-scores[d], d))[:7]
        assert [d for d, _ in got[i]] == best
        assert np.allclose([s for _, s in got[i]], [scores[d] for d in best], atol=2e-6)


@pytest.mark.parametrize("limits", [{}, {"max_shipped": 2, "rows_per_block": 5}])
def test_dense(spark, limits):
    rng = np.random.default_rng(3)
    v, a = rng.normal(size=(50, 8)), rng.normal(size=(7, 8))
    v[11] = v[4]  # equal rows keep id order
    items = spark.createDataFrame([(f"c{i:02d}", x.tolist()) for i, x in enumerate(v)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(a)], "query_id bigint, vector array<double>")
    got = {}
    for r in dense.dense_top_k(items, q, 50, **limits).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    v32 = v.astype(np.float32).astype(float)
    sims = np.round(a @ v32.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(v32, axis=1), 6)
    for i in range(7):
        assert got[i] == [f"c{j:02d}" for j in sorted(range(50), key=lambda j: (-sims[i, j], j))]


def legs(spark, d, s):
    left = spark.createDataFrame([(1, c, x, r) for r, (c, x) in enumerate(d, 1)], "query_id int, chunk_id string, dense_score double, rank int")
    right = spark.createDataFrame([(1, c, x, r) for r, (c, x) in enumerate(s, 1)], "query_id int, chunk_id string, bm25_score double, rank int")
    return left, right


def test_fusion(spark):
    d, s = legs(spark, [("a", 0.9), ("b", 0.7), ("c", 0.5)], [("c", 12.0), ("d", 6.0), ("a", 0.0)])
    rrf = fusion.reciprocal_rank_fusion(d, s).orderBy("rank").collect()
    assert [(r.chunk_id, r.fusion_score) for r in rrf] == [("a", 0.01613), ("c", 0.01613), ("b", 0.00806), ("d", 0.00806)]
    rsf = fusion.relative_score_fusion(d, s).orderBy("rank").collect()
    assert [(r.chunk_id, r.fusion_score) for r in rsf] == [("a", 0.6), ("c", 0.4), ("b", 0.3), ("d", 0.2)]
    flat, _ = legs(spark, [("a", 0.5), ("b", 0.5)], [("c", 1.0)])
    rsf = fusion.relative_score_fusion(flat, s.limit(0)).orderBy("rank").collect()
    assert [r.fusion_score for r in rsf] == [0.6, 0.6]


def test_mentions(spark):
    rows = [('@"ESC 2024" dose? @WHO',), ("@WHO",), ("plain",), ("mail @a.b-c_d end",)]
    got = targets.extract_mentions(spark.createDataFrame(rows, "query string")).collect()
    assert [(r.doc_filter, r["query"]) for r in got] == [
        ("ESC 2024", "dose?"), ("WHO", "@WHO"), (None, "plain"), ("a.b-c_d", "mail  end"),
    ]


def test_filters_keep_order_and_scope(spark):
    hits = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1) for i in range(6)], "query_id int, chunk_id int, dense_score double, rank int")
    docs = spark.createDataFrame([(i, f"doc{i % 3}", f"DOC{i % 3}.pdf") for i in range(6)], "chunk_id int, document_id string, pdf_file string")
    q = spark.createDataFrame([(1, True, "doc2", "doc2", "")], "query_id int, has_target boolean, target_id string, target_file string, target_org string")
    got = targets.keep_target_hits(hits, q, docs, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"]) for r in got] == [(2, 1), (5, 2)]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, r, f"c{r}", "s" if r in (1, 3, 4) else "t") for r in range(1, 6)], "query_id int, rank int, chunk_id string, section_id string")
    truth = spark.createDataFrame([(1, "s", ["c1", "c9"]), (2, "s", ["x"])], "query_id int, expected_section_id string, expected_chunk_ids array<string>")
    got = {(r.query_id, r.k): r for r in evaluation.query_metrics(hits, truth).collect()}
    assert (got[1, 5].hit, got[1, 5].precision, got[1, 5].recall, got[1, 5].rr) == (1, 0.6, 1.0, 1.0)
    assert (got[2, 5].hit, got[2, 5].precision, got[2, 5].recall, got[2, 5].rr) == (0, 0.0, 0.0, 0.0)
    assert got[1, 1].recall == 0.5




def test_sources_and_context(spark):
    rows = [(1, 1, "c1", "doc_001", None, None, "S", 3, 3, 0.123456, "x"), (1, 2, "c2", "other_doc", "o.pdf", "", None, 4, 6, 0.5, "y")]
    hits = spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, document_id string, pdf_file string, document_name string, section_title string, page_start int, page_end int, score double, text string")
    s = context.format_sources(hits)
    first, second = s.orderBy("rank").collect()
    assert (first.pdf_file, first.document_name, first.score) == ("WHO_guideline_01.pdf", "Doc 001", 0.1235)
    assert (second.pdf_file, second.document_name) == ("o.pdf", "Other Doc")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r.context for r in context.build_context(q, s).collect()}
    assert got[1] == "[1] Document: Doc 001, Section: S | Page 3\nx\n\n---\n\n[2] Document: Other Doc | Pages 4-6\ny"
    assert got[2].startswith("[No matching context")


class Letters:
    name = "letters"

    def embed(self, items, task):
        return [[float(t.lower().count(c)) + 0.1 for c in "abcdefgh"] for t in items]


class Echo:
    def generate(self, prompt):
        return f"{len(prompt)} characters"


def test_ask_with_plugins(spark):
    from folioscope.plugins import embed

    rows = [(f"k{i}", "doc_x" if i % 2 else "doc_y", f"{'x' if i % 2 else 'y'}.pdf", f"T{i}", i, i, t) for i, t in enumerate(["bad cab", "face", "egg head", "dose of salt", "salt", "bag"])]
    chunks = embed(spark.createDataFrame(rows, "chunk_id string, document_id string, pdf_file string, section_title string, page_start int, page_end int, text string"), Letters())
    registry = spark.createDataFrame([(0, "doc_x", "X set", "ORG", "x.pdf")], "ord bigint, document_id string, document_name string, organization string, local_file string")
    q = spark.createDataFrame([("a", "salt dose"), ("b", "@x salt")], "query_id string, query string")
    got = {r.query_id: r for r in ask(q, chunks, registry, k=2, embedder=Letters(), generators=[Echo()]).collect()}
    assert {s.document_id for s in got["b"].sources} == {"doc_x"}
    assert got["a"].sources[0].chunk_id in ("k3", "k4") and got["a"].answer.endswith("characters")
    assert "X set" in got["b"].prompt and got["b"]["query"] == "salt"


def test_containing_keys_by_anchors(spark):
    rng = random.Random(4)
    keys = {"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(120)} | {"é", "éa", "a.b", "%_"}
    made = {"".join(rng.choices("abcd", k=rng.randint(1, 40))) for _ in range(150)} | {"xéax", "100%_", "a", "a.b"}
    t = spark.createDataFrame([(x,) for x in sorted(made)], "text string")
    k = spark.createDataFrame([(x,) for x in sorted(keys)], "key string")
    got = sorted(map(tuple, targets.containing(t, k).collect()))
    assert got == sorted((x, y) for x in made for y in keys if y in x)


def test_anchors_of_long_texts(spark):
    """Rows of the join follow the texts' size, not the number of key lengths."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts_ = ["".join(rng.choices(letters, k=400)) for _ in range(500)]
    keys = [texts_[n][n % 300 : n % 300 + 3 + n % 90] for n in range(0, 500, 5)] + ["".join(rng.choices(letters, k=60)) for _ in range(400)]
    t = spark.createDataFrame([(x,) for x in texts_], "text string")
    k = spark.createDataFrame([(x,) for x in sorted(set(keys))], "key string")
    found = targets.containing(t, k)
    assert found.count() >= 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    grams = sum(len({x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)}) for x in texts_)
    assert grams < 3 * 400 * 500


def test_pieces_are_not_broadcast(spark):
    """Written keys and texts are small files; their pieces are not small rows."""
    t = settle(spark.range(3000).selectExpr("concat('unknown ', id) AS text"), "texts")
    k = settle(spark.range(20).selectExpr("concat('n ', id) AS key"), "keys")
    found = targets.containing(t, k)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == sum(f"n {key}" in f"unknown {n}" for n in range(3000) for key in range(20))
