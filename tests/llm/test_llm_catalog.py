"""Queries with SQL agree with it; the pipeline agrees with its stages done plainly."""

import pytest

import __spark_entry__
import corpus_pipeline
from folioscope.llm import catalog, exact_dedup, mixing, toxicity

SQL = catalog.oracle_sql()
NAMES = {int(n[2:].split("_")[0]) for n in catalog.queries()}


def test_every_operator_has_a_query():
    assert NAMES == set(range(1, 14))
    assert set(SQL) <= set(catalog.queries())
    assert {"pipeline", *catalog.queries()} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, data, duck, name):
    df = __spark_entry__.queries()[name](spark, data)
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(map(repr, map(tuple, df.select(*names).collect())))
    assert mine == sorted(map(repr, answer.fetchall()))


def test_pipeline(spark, folder, near_brute):
    """Five stages on a small table, each against a plain version of it."""
    insult = "you worthless idiot and stupid moron"
    words = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(120):
        text = " ".join(words[(k * 7 + j * (k % 11 + 1)) % 60] for j in range(40)) + f" tail {k} {k * 31}"
        if k % 6 == 5:
            text = f"{insult} {text}"
        rows.append((k, text, ["en", "fr"][k % 2], f"src{k % 3}", len(text)))
        labels.append((k, 1, int(k % 6 == 5)))
    copy, near = rows[4][1], rows[8][1] + " more"
    rows += [(120, copy, "en", "src1", 1), (121, near, "en", "src2", 1), (122, None, None, None, None), (123, "", "fr", "src0", 0)]
    documents = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    path = folio = folder(documents=(rows, documents), labels=(labels, "doc_id bigint, quality int, toxic int"))
    docs = spark.read.parquet(f"{folio}/documents.parquet")

    def texts(df):
        return {r.doc_id: r.text for r in df.collect()}

    clean = corpus_pipeline.drop_toxic(spark, docs, path)
    assert clean.columns == docs.columns
    machine = toxicity.learn(spark, path, docs)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert set(texts(clean)) == {i for i, s in scores.items() if s < toxicity.CUT}
    assert not [i for i, t in texts(clean).items() if insult in (t or "")]
    assert {4, 8, 120, 121, 122, 123} <= set(texts(clean))

    single = corpus_pipeline.drop_exact_copies(spark, clean, path)
    first = {}
    for i, t in sorted(texts(clean).items()):
        first.setdefault(t or "", i)
    assert set(texts(single)) == set(first.values())

    apart = corpus_pipeline.drop_near_copies(spark, single, path)
    assert set(texts(apart)) == {r[0] for r in near_brute(texts(single).items()) if r[3]}
    assert 121 not in texts(apart)

    mixed = corpus_pipeline.mix_sources(spark, apart, path)
    plan = mixing.mix(apart, mixing.document_levels(), share=corpus_pipeline.MIX_SHARE, seed=mixing.SEED)
    assert set(texts(mixed)) == {r.doc_id for r in plan.collect() if r.copies}

    last = corpus_pipeline.encode(spark, mixed, path).collect()
    assert {r.doc_id for r in last} == set(texts(mixed))
    assert [r.doc_id for r in corpus_pipeline.run(spark, path).orderBy("doc_id").collect()] == sorted(texts(mixed))


def test_exact_stage_keeps_the_smallest(spark):
    rows = [(3, "a"), (1, "a"), (2, None), (4, "")]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, "a"), (2, "")]
