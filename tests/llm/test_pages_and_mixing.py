import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import embedding_dedup, factorization, hnsw, mixing, toxicity, url_filter, warc

PAGES = "page_id bigint, url string, html string"


# -- WARC ---------------------------------------------------------------------


def test_chunked_framing():
    for payload in (b"", b"a", b"x" * 100, bytes(range(256)) * 90):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"9\r\nabc\r\n0\r\n\r\n")


def test_archives(spark, tmp_path):
    same, small = "equal payload " * 20, "tiny"
    rows = [
        (5, "http://a/\r\nX-Evil: 1", same), (3, None, same), (9, "http://b", same), (1, "http://c", small),
        (2, "http://d", small), (7, "http://e", None), (8, "http://f", ""), (10, "http://g", "é\r\n\r\nWARC/1.1\r\n" * 5000),
        (11, "http://g", "double" * 500), (11, "http://g", "double" * 500), (None, "http://h", "no id"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", digest string")
    warc.write(df, f"{tmp_path}/w", segment=1000)
    found = warc.read(spark, f"{tmp_path}/w").select(warc.page_of(F.col("record_id")).alias("page"), "*").collect()
    stored = sorted((str(r.page), bytes(r.payload)) for r in found if r.type == "response")
    assert stored == sorted((str(i), (h or "").encode()) for i, _, h in rows if i not in (5, 9))
    revisits = {r.page: bytes(r.refers_to) for r in found if r.type == "revisit"}
    digest = hashlib.sha256(same.encode()).hexdigest()
    assert revisits == {i: warc.page_urn(3, digest) for i in (5, 9)}


def test_incomplete_segments(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "text " * 900), (2, "v", "text! " * 900)], PAGES), f"{tmp_path}/w", segment=900)
    records = warc._records(spark, f"{tmp_path}/w")
    assert records.where("segment is not null").count() > 8
    broken = records.where(~((warc.page_of(F.col("origin")) == 2) & (F.col("segment") == 3)))
    blocks = {warc_page(r.record_id): r.block for r in warc.reassemble(broken).collect()}
    assert blocks[1] is not None and blocks[2] is None


def test_warc_members(spark, tmp_path):
    """Archives of others: a member for each record, several records in one."""
    import gzip

    def record(n):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + b"page %d " % n * 9000
        head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d:00>\r\nContent-Length: %d\r\n\r\n"
        return head % (n, len(block)) + block + b"\r\n\r\n"

    each = [gzip.compress(record(n)) for n in range(5)]
    some = gzip.compress(b"".join(map(record, range(5, 8))))
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.gz").write_bytes(b"".join(each))
    (tmp_path / "w" / "b.gz").write_bytes(some + gzip.compress(record(8)) + b"\0" * 10)
    found = {warc_page(r.record_id): bytes(r.payload) for r in warc.read(spark, f"{tmp_path}/w").collect()}
    assert found == {n: b"page %d " % n * 9000 for n in range(9)}
    whole = b"".join(each)
    for cut in (1, 10, len(each[-1]) - 1):
        with pytest.raises(ValueError, match="cut short"):
            list(warc.members(whole[:-cut]))
    assert len(list(warc.members(whole))) == 5 and list(warc.members(b"")) == []


def warc_page(record_id):
    return int(warc.PAGE_URN.fullmatch(bytes(record_id))[1])


def test_no_pages(spark, folder):
    assert warc.op2_warc(spark, folder(pages=([], PAGES))).collect() == []


# -- URL filter ---------------------------------------------------------------


def test_parts_and_rules(spark):
    urls = [
        (1, "HTTP://WWW.Example.ORG/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://org?x=/en/1"),
        (4, "http://notexample.org.net/es/"), (5, None), (6, "no scheme"), (7, "x://É.COM/de/\nz#"), (8, "a://b://c/d"),
        (9, "http://my.com/fr/"), (10, "http://example.org"), (11, "http://example.org/en/1?"),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in urls], "page_id bigint, url string, host string")
    none = spark.createDataFrame([], "_host string, _bad int")
    found = {r.page_id: r for r in url_filter.judge(pages, none, url_filter.RULES).collect()}
    assert [(found[i].host, found[i].path) for i in range(1, 9)] == [
        ("www.example.org", "/es/x"), ("example.org", "/en/12"), ("org", ""), ("notexample.org.net", "/es/"),
        ("", ""), ("", ""), ("É.com", "/de/\nz"), ("b:", "//c/d"),
    ]
    assert [found[i].rule for i in range(1, 12)] == [
        "example.org/es/", "example.org/en/1", None, None, None, None, "com/de/", None, "com/fr/", None, "example.org/en/1",
    ]
    assert [i for i in found if found[i].verdict == "block"] and {i for i in found if found[i].verdict == "block"} == {1, 2, 7, 11}


def test_reputation(spark):
    """Bad hosts with many labels are blocked, those with few are shrunk."""
    hosts = [("bad.one.net", 300, 290), ("good.one.net", 300, 10), ("new.one.net", 1, 1), ("x.two.net", 300, 30), ("y.three.com", 200, 20)]
    rows = [(h, int(k < bad)) for h, n, bad in hosts for k in range(n)]
    outcomes = spark.createDataFrame(rows, "_host string, _bad int")
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, (h, _, _) in enumerate([*hosts, ("unseen.org", 0, 0)])], "page_id bigint, url string")
    found = {r.host: r for r in url_filter.judge(pages, outcomes, ()).collect()}
    assert {h for h in found if found[h].verdict == "block"} == {"bad.one.net"}
    assert 0.1 < found["new.one.net"].bad_rate < 0.9
    assert url_filter.judge(pages.limit(0), outcomes, ()).collect() == []


# -- mixing -------------------------------------------------------------------


def fill(budget, children):
    """Water filling by bisection; children: name -> (weight, capacity)."""
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        if sum(min(c, w * mid) for w, c in children.values()) < budget:
            low = mid
        else:
            high = mid
    return {k: min(c, w * high) for k, (w, c) in children.items()}


def test_budgets_and_prefixes(spark):
    sizes = {("a", "x"): 30, ("a", "y"): 300, ("b", "x"): 200, ("b", "z"): 5}
    rows = []
    for (top, low), n in sizes.items():
        rows += [(len(rows) + k, "w " * (k % 7 + 1), top, low) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, top string, low string")
    weights = {"a": 3.0, "b": 1.0}
    levels = {"t": mixing.Level(F.col("top"), weights), "l": mixing.Level(F.col("low"), {"x": 2.0})}
    for share, epochs in ((0.5, 1), (1.0, 2), (0.9, 3)):
        found = mixing.mix(df, levels, share=share, epochs=epochs, seed=9).collect()
        available = {}
        for r in found:
            available[r.t, r.l] = available.get((r.t, r.l), 0) + r.n_tokens
        total = share * sum(available.values())
        tops = fill(total, {t: (weights[t], epochs * sum(v for k, v in available.items() if k[0] == t)) for t in "ab"})
        for t in "ab":
            leaves = {k: (2.0 if k[1] == "x" else 1.0, epochs * v) for k, v in available.items() if k[0] == t}
            for leaf, budget in fill(tops[t], leaves).items():
                own = [r for r in found if (r.t, r.l) == leaf]
                whole = int((budget + 1e-3) // available[leaf])
                rest = int(budget + 1e-3) - whole * available[leaf]
                key = {r.doc_id: hashlib.md5(f"9:{whole}:{r.doc_id}".encode()).hexdigest() for r in own}
                taken, expected = 0, {}
                for r in sorted(own, key=lambda r: key[r.doc_id]):
                    taken += r.n_tokens
                    expected[r.doc_id] = whole + (taken <= rest)
                assert {r.doc_id: r.copies for r in own} == expected


def test_mixing_edges(spark):
    levels = {"lang": mixing.Level(F.col("lang"), {"no": 0.0})}
    schema = "doc_id bigint, text string, lang string, copies int"
    rows = [(1, "a b", "en", 7), (1, "a b", "en", 7), (2, None, None, 7), (3, "c", "no", 7), (None, "d", "en", 7)]
    df = spark.createDataFrame(rows, schema)
    taken = mixing.take(df, levels, share=1.0, epochs=2)
    assert taken.schema.names == df.schema.names
    assert {r.lang for r in taken.collect()} <= {"en", ""}
    found = mixing.mix(df, levels, share=1.0, epochs=1).collect()
    assert {r.copies for r in found if r.lang == "no"} == {0} and {r.copies for r in found if r.lang == "en"} == {1}
    assert mixing.mix(df.limit(0), levels).collect() == []


# -- toxicity -----------------------------------------------------------------


def test_pairs_are_learnt():
    """Two harmless terms that are toxic together."""
    r = np.random.default_rng(3)
    documents, labels = [], []
    for _ in range(1500):
        terms = set(r.integers(10, 400, 20).tolist())
        a, b = r.random(2) < 0.4
        documents.append(np.array(sorted(terms | ({1} if a else set()) | ({2} if b else set())), np.int64))
        labels.append(float(a and b))
    machine = factorization.fit(documents, np.array(labels))
    flat = np.array([1, 2, 1, 2, 50])
    both, first, second, none = machine.scores(flat, np.array([0, 0, 1, 2, 3]), 4)
    assert both > 0.9 and max(first, second, none) < 0.5
    assert (machine.factors != 0).any()


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.op9_toxicity(spark, data).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in bad) > 0.8 * len(bad)
    assert sum(r.predicted for r in good) < 0.08 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.CUT) for r in rows)


def test_toxicity_edges(spark, folder):
    docs = "doc_id bigint, text string, score double, _toxicity int"
    rows = [(k, "bad insult" if k % 2 else "fine words", 0.5, 1) for k in range(40)]
    rows += [(50, None, 0.5, 1), (51, "", 0.5, 1), (None, "insult", 0.5, 1), (52, "insult " * 200_000, 0.5, 1)]
    labels = [(k, None, k % 2) for k in range(40)] + [(0, None, 0), (None, None, 1), (50, None, None)]
    path = folder(documents=(rows, docs), labels=(labels, "doc_id bigint, quality int, toxic int"))
    found = toxicity.op9_toxicity(spark, path).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    scores = {r.doc_id: r.score for r in found}
    assert scores[50] == scores[51] and scores[52] > scores[50]
    df = spark.read.parquet(f"{path}/documents.parquet")
    machine = toxicity.learn(spark, path, df)
    assert toxicity.keep_below(df, machine).schema.names == df.schema.names
    assert toxicity.score(df.limit(0), machine).collect() == []
    empty = toxicity.train(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {r.score for r in toxicity.score(df, empty).collect()} == {0.5}


# -- vectors ------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    def fine(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    up, links = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, v, label) in enumerate(rows):
        for j, w, other in rows[:k]:
            if fine(v, label) and fine(w, other) and label == other and len(v) == len(w):
                a, b = np.float32(v).astype(float), np.float32(w).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    return sorted((i, links[i], root(i), root(i) == i) for i in links)


def vectors(seed, count):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(count // 8, 16))
    rows = []
    for k in range(count):
        v = centers[r.integers(len(centers))] + r.normal(size=16) * r.choice([0.0, 0.05, 0.1, 1.0])
        rows.append((k, [float(np.float32(x)) for x in v], int(r.integers(2))))
    return rows


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 64)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    rows = vectors(1, 400)
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0] * 15 + [None], 1),
             (904, [1.0] * 15 + [float("nan")], 1), (905, [float("inf")] * 16, 1), (906, rows[0][1], None), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], VECTORS + ", n_links int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect())
    assert found == brute(rows)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_graph_recall():
    r = np.random.default_rng(2)
    centers = r.normal(size=(150, 32))
    unit = (centers[r.integers(150, size=3000)] + r.normal(size=(3000, 32)) * 0.25).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph, order = hnsw.Graph.build(unit)
    graph, _ = hnsw.Graph.from_bytes(graph.to_bytes())
    (query, node), audited = hnsw.links_within(graph, unit, 0.93, 32, 0.97)
    found = np.zeros((3000, 3000), bool)
    found[query, order[node]] = True
    truth = unit @ unit.T >= 0.93
    assert audited >= 0.97 and (found & truth).sum() / truth.sum() > 0.95 and not (found & ~truth).sum() > 5
