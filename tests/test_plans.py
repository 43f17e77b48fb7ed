"""Sources, plug-ins, whole plans and the published metric roll-up."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.operators import clinical, evaluation, headings, lexical, state
from folioscope.plans import ingest
from folioscope.session import new_run_dir
from folioscope.sources import files, pages, tables
from folioscope.streaming.ingest import ProgressListener

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# fixed values: published per-query results of the dense run, as
# (query, reciprocal rank, then precision and recall at 1, 3 and 5)
DENSE_RUN = [
    ("Q01", 1.0, 1.0, 1.0, 0.3333, 1.0, 0.2, 1.0),
    ("Q02", 1.0, 1.0, 0.5, 1.0, 1.0, 0.6, 1.0),
    ("Q03", 1.0, 1.0, 1.0, 0.3333, 1.0, 0.2, 1.0),
    ("Q04", 1.0, 1.0, 0.5, 0.6667, 1.0, 0.6, 1.0),
    ("Q05", 1.0, 1.0, 0.5, 1.0, 1.0, 1.0, 1.0),
    ("Q06", 0.5, 0.0, 0.0, 0.3333, 1.0, 0.2, 1.0),
    ("Q07", 1.0, 1.0, 0.5, 1.0, 1.0, 0.6, 1.0),
    ("Q08", 1.0, 1.0, 0.5, 1.0, 1.0, 0.6, 1.0),
    ("Q09", 1.0, 1.0, 0.3333, 1.0, 1.0, 0.8, 1.0),
    ("Q10", 1.0, 1.0, 0.5, 1.0, 1.0, 0.6, 1.0),
]
# fixed values: the published means as (k, hit rate, precision, recall)
DENSE_MEANS = [(1, 0.9, 0.9, 0.5333), (3, 1.0, 0.7667, 1.0), (5, 1.0, 0.54, 1.0)]


def test_published_means(spark):
    rows = [
        (q, k, 1 if p > 0 else 0, p, r, rr)
        for q, rr, *pr in DENSE_RUN
        for k, p, r in zip((1, 3, 5), pr[::2], pr[1::2])
    ]
    per_query = spark.createDataFrame(rows, "query_id string, k int, hit int, precision double, recall double, rr double")
    got = {r.k: r for r in evaluation.macro_metrics(per_query).collect()}
    for k, hit, precision, recall in DENSE_MEANS:
        assert got[k].hit_rate == hit and got[k].mrr == 0.95
        assert abs(got[k].precision - precision) <= 1e-4 and abs(got[k].recall - recall) <= 1e-4


def test_sweep_formula(spark):
    hits = spark.createDataFrame([("q", r, f"c{r}", "s" if r <= 2 else "t", None if r == 3 else 100) for r in range(1, 11)], "query_id string, rank int, chunk_id string, section_id string, token_count int")
    truth = spark.createDataFrame([("q", "s", ["zz"])], "query_id string, expected_section_id string, expected_chunk_ids array<string>")
    got = {r.k: r for r in evaluation.sweep_k(hits, truth).collect()}
    assert got[2].tradeoff_score == 1.0 and got[4].tradeoff_score == 0.8
    assert got[3].avg_context_tokens == 800 and got[10].precision == 0.2


def test_layout_cascade(spark):
    span = lambda t, s, f="Serif": (t, float(s), f)
    blocks = [
        ([([span("Big heading", 16)],), ([span("second line", 16)],)],),
        ([([span("Body text that is long enough to set the size", 10)],)],),
        ([([span("Bold one", 10.6, "Serif-Bold")],)],),
        ([([span("References", 16)],)],),
    ]
    page = spark.createDataFrame([("d", 2, blocks)], "document_id string, page_number int, blocks array<struct<lines:array<struct<spans:array<struct<text:string,size:double,font:string>>>>>>")
    layout = pages.layout_of(page)
    assert headings.body_font_sizes(layout).first().body_size == 10.0
    text = spark.createDataFrame([("d", 2, "DOSES\nplain"), ("d", 3, "1.1 More words\nplain")], schemas.PAGES)
    toc = spark.createDataFrame([("d", [(1, " One: ", 1), (1, "Two", 2), (1, "One", 3)])], "document_id string, toc array<struct<level:int,title:string,page:int>>")
    found = headings.detect_headings(text, pages.bookmarks_of(toc), layout)
    titles = [(r.title, r.page_number) for r in found.orderBy("order").collect()]
    # two bookmarks are too few, but they stay; the layout adds its headings
    assert titles == [("One", 1), ("Two", 2), ("Big heading second line", 2), ("Bold one", 2)]
    ends = [(r.start_page, r.end_page) for r in headings.detected_sections(found, text).orderBy("ord").collect()]
    assert ends == [(1, 1), (2, 2), (2, 2), (2, 3)]
    lines = headings.detect_headings(text)
    assert [r.title for r in lines.orderBy("order").collect()] == ["DOSES", "1.1 More words"]


def test_ingest_and_store(spark):
    raw = spark.createDataFrame([("d", 1, "SCOPE\nsome words"), ("d", 2, "LIMITS\nother words\n2"), ("d", 3, " ")], schemas.PAGES)
    docs = spark.createDataFrame([("d", "Doc D", "d.pdf")], "document_id string, document_name string, pdf_file string")
    folder = new_run_dir(spark, "store")
    chunks = tables.StoredTable(spark, f"{folder}/chunks", schemas.CHUNKS, "chunk_id")
    registry = tables.StoredTable(spark, f"{folder}/registry", schemas.REGISTRY, "document_id")
    told = []
    for expected in (2, 0):  # the second run adds nothing
        done = ingest.ingest(raw, docs)
        assert ingest.store(done, docs, chunks, registry, progress=lambda *a: told.append(a)) == expected
    row = registry.read().first()
    assert registry.count() == 1 and (row.total_chunks, row.total_pages, row.status) == (2, 2, "indexed")
    assert told[0][2] == 2.0 and told[-1][2] == 100.0
    assert sorted(r.chunk_id for r in chunks.read().collect()) == ["d_sec_001_c001", "d_sec_002_c001"]


def test_index_save_and_reload(spark):
    corpus = spark.createDataFrame([(1, "salt dose"), (2, "dose"), (3, "blood")], "chunk_id int, text string")
    index = lexical.build_index(corpus)
    path = new_run_dir(spark, "index")
    assert lexical.reload_index(spark, path, index) is index
    lexical.build_index(corpus, path=path)
    again = lexical.reload_index(spark, path, index)
    assert again is not index and again.n_docs == 3 and again.average_length == index.average_length
    assert sorted(map(tuple, again.idf().collect())) == sorted(map(tuple, index.idf().collect()))
    asked = spark.createDataFrame([(1, "dose of salt")], "query_id int, query string")
    hits = lexical.bm25_top_k(None, asked, 2, index=again)
    assert [r.chunk_id for r in hits.orderBy("rank").collect()] == [1, 2]
    assert "text" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_search_without_queries_or_vectors(spark):
    from folioscope.operators import dense

    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id int, vector array<double>")
    found = dense.dense_top_k(items, asked, 5).collect()
    assert sorted((r.query_id, r.chunk_id) for r in found) == [(1, 1), (1, 3)]
    assert dense.dense_top_k(items, asked.limit(0), 5).collect() == []
    longer = spark.createDataFrame([(1, [1.0, 1.0, 1.0])], "query_id int, vector array<double>")
    with pytest.raises(Exception, match="cannot be compared"):
        dense.dense_top_k(items, longer, 5).collect()


def test_pages_of_many_sections(spark):
    """A page meets the sections of its bucket only."""
    from folioscope.operators import chunking

    pages = spark.range(1, 1001).selectExpr("'d' AS document_id", "CAST(id AS INT) AS page_number", "'t' AS text")
    sections = spark.range(0, 500).selectExpr(
        "'d' AS document_id", "concat('s', id) AS section_id", "'x' AS section_title",
        "CAST(2 * id + 1 AS INT) AS start_page", "CAST(2 * id + 2 + (id % 3) * 100 AS INT) AS end_page",
    )
    found = chunking.section_pages(pages, sections)
    expected = sum(
        1 for i in range(500) for p in range(2 * i + 1, min(1000, 2 * i + 2 + (i % 3) * 100) + 1)
    )
    assert found.count() == expected
    assert "_bucket" in found._jdf.queryExecution().optimizedPlan().toString()


class Broken:
    def extract(self, text):
        raise RuntimeError("down")


class Fixed:
    def extract(self, text):
        return json.dumps({"systolic": 150, "comorbidities": ["CKD"], "lab_values": {"eGFR": "55"}})


def test_report_extraction(spark):
    p = spark.createDataFrame([("r", 1, " BP 150/95 "), ("r", 2, " "), ("r", 3, "end")], schemas.PAGES)
    report = clinical.report_text(p)
    assert report.first().text == "--- Page 1 ---\nBP 150/95\n\n--- Page 3 ---\nend"
    got = clinical.extract_vitals(report, [Broken(), Fixed()]).first()
    assert got.vitals.systolic == 150 and got.vitals.lab_values == {"eGFR": "55"}
    assert got.summary == "Patient Blood Pressure Report analyzed."


def test_user_lookup(spark):
    users = spark.createDataFrame([("1", "A", "a@x.org", "h", 1)], schemas.USERS)
    assert state.find_user(users, "email", " A@X.org ").first().id == "1"
    assert "password_hash" not in state.find_user(users, "id", "1").columns
    assert state.find_user(users, "id", "2").isEmpty()


def test_registry_listing(spark, tmp_path):
    (tmp_path / "registry.json").write_text(json.dumps([{"document_id": "doc_1"}]))
    (tmp_path / "a.pdf").write_bytes(b"x")
    got = files.registry_listing(spark, str(tmp_path / "registry.json"), str(tmp_path))
    assert sorted((r.kind, r.name) for r in got.collect()) == [("file", "a.pdf"), ("registry", "doc_1")]


def test_progress_listener():
    told = []
    listener = ProgressListener(lambda *a: told.append(a))

    class Event:
        id, name, exception = "7", None, None

    listener.onQueryStarted(Event())
    listener.onQueryTerminated(Event())
    assert [t[0] for t in told] == ["start", "done"]


def test_missing_vector_is_an_error(spark):
    from folioscope.operators.dense import zip_embeddings

    c = spark.createDataFrame([(1, "a"), (2, "b")], "ord bigint, text string")
    v = spark.createDataFrame([(1, [1.0])], "ord bigint, embedding array<double>")
    with pytest.raises(Exception, match="do not pair"):
        zip_embeddings(c, v).select(F.max("ord")).collect()


class CountingEmbedder:
    """Writes a file per call, since calls happen in Python workers."""

    name = "counting"

    def __init__(self, folder):
        self.folder = folder

    def embed(self, texts, task):
        import os
        import uuid

        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as out:
            out.write("\n".join(str(len(t)) for t in texts))
        return [[float(len(t)), 1.0] for t in texts]


def test_chunks_are_embedded_once(spark, tmp_path):
    pages = [(f"d{k}", n, f"1. Heading {n}\n" + "some words of text here " * 30) for k in range(3) for n in range(1, 5)]
    raw = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    docs = raw.select("document_id").distinct().selectExpr("document_id", "document_id AS document_name", "concat(document_id, '.pdf') AS pdf_file")
    folder = new_run_dir(spark, "embedded")
    chunks = tables.StoredTable(spark, f"{folder}/chunks", schemas.EMBEDDED_CHUNKS, "chunk_id")
    registry = tables.StoredTable(spark, f"{folder}/registry", schemas.REGISTRY, "document_id")
    points = tables.StoredTable(spark, f"{folder}/points", schemas.POINTS, "point_id")
    embedder = CountingEmbedder(str(tmp_path))
    done = ingest.ingest(raw, docs)
    added = ingest.store(done, docs, chunks, registry, embedder, vector_table=points)
    embedded = sum(len(f.read_text().split("\n")) for f in tmp_path.iterdir())
    assert added == embedded == chunks.count() == points.count() == done.chunks.count() > 0
    assert ingest.store(done, docs, chunks, registry, embedder, vector_table=points) == 0
    assert sum(len(f.read_text().split("\n")) for f in tmp_path.iterdir()) == embedded


def test_vectors_after_a_cut_run(spark, tmp_path, monkeypatch):
    """Chunks that are stored without their points get them in the next run."""
    raw = spark.createDataFrame(
        [("d", n, f"1. Heading {n}\n" + "some words of text here " * 30) for n in range(1, 4)],
        "document_id string, page_number int, text string",
    )
    docs = spark.createDataFrame([("d", "d", "d.pdf")], "document_id string, document_name string, pdf_file string")
    folder = new_run_dir(spark, "cut")
    chunks = tables.StoredTable(spark, f"{folder}/chunks", schemas.EMBEDDED_CHUNKS, "chunk_id")
    registry = tables.StoredTable(spark, f"{folder}/registry", schemas.REGISTRY, "document_id")
    points = tables.StoredTable(spark, f"{folder}/points", schemas.POINTS, "point_id")
    embedder = CountingEmbedder(str(tmp_path))
    done = ingest.ingest(raw, docs)

    def cut(*_):
        raise RuntimeError("cut")

    with monkeypatch.context() as patch:
        patch.setattr(points, "upsert", cut)
        with pytest.raises(RuntimeError, match="cut"):
            ingest.store(done, docs, chunks, registry, embedder, vector_table=points)
    assert chunks.count() > 0 and points.count() == 0
    assert ingest.store(done, docs, chunks, registry, embedder, vector_table=points) == 0
    stored = {r.payload.chunk_id: r.embedding for r in points.read().collect()}
    assert stored == {r.chunk_id: r.embedding for r in chunks.read().collect()}


def test_labelled_set(spark, tmp_path):
    rows = [
        {"query_id": "Q1", "query": "dose?", "expected_section_id": "s1", "expected_chunk_ids": ["c1"], "expected_pages": [3], "topic": "t"},
        {"query_id": "Q2", "query": "salt?", "expected_section_id": "s2"},
        {"query_id": None, "query": "nameless"},
    ]
    (tmp_path / "set.json").write_text(json.dumps(rows))
    found = files.read_test_set(spark, str(tmp_path / "set.json")).orderBy("query_id").collect()
    assert [(r.query_id, r.expected_chunk_ids, r.expected_pages) for r in found] == [("Q1", ["c1"], [3]), ("Q2", [], [])]
    assert files.read_test_set(spark, str(tmp_path / "none.json")).collect() == []


def test_notes_times_and_clock(spark):
    from folioscope.operators import context
    from folioscope.plans.evaluate import timed

    noted = spark.createDataFrame([("high",), ("",), (None,)], "t string").select(context.patient_text_note(F.col("t")).alias("n"))
    assert [bool(r.n) for r in noted.collect()] == [True, False, False]
    told = timed("range", lambda: spark.range(5), lambda df: df.count())
    assert told["mode"] == "range" and told["latency_ms"] > 0
    assert spark.range(1).select(state.now_millis().alias("n")).first().n > 1_600_000_000_000


def test_run_folders_are_deleted_with_their_scope(spark):
    import os

    from folioscope.session import run_scope, settle

    kept = new_run_dir(spark, "kept")
    with run_scope(spark):
        written = settle(spark.range(5), "scoped")
        inside = written.inputFiles()[0].removeprefix("file://")
        written.write.parquet(kept)
        assert os.path.exists(inside)
    assert not os.path.exists(inside) and spark.read.parquet(kept).count() == 5
