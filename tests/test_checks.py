"""Chunk checks, stored tables, stream."""

import random
import sys
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from folioscope import schemas
from folioscope.operators import arrow, duplicates, state, validation
from folioscope.session import new_run_dir, prepare
from folioscope.sources import files, pages, tables
from folioscope.streaming.ingest import TEXT_CHUNKS, document_stream, start_ingest

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sentences(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = list(rng.choice(out))
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = rng.choice("abcxyz é")
            out.append("".join(base).strip() or "x")
        else:
            out.append("".join(rng.choices("abcdefghij klmnop", k=rng.randint(20, 120))).strip() or "x")
    return out


@pytest.mark.parametrize("block_rows", [2000, 5])
def test_near_duplicates(spark, block_rows):
    texts = sentences(60, 5) + ["copy of one text " * 4] * 30
    df = spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(texts)], "ord bigint, chunk_id string, text string")
    got = {r.ord: (r.other_ord, round(r.ratio, 9)) for r in duplicates.near_duplicates(df, block_rows=block_rows).collect()}
    expected = {}
    for i, a in enumerate(texts):
        for j in range(i):
            ratio = SequenceMatcher(None, a.strip(), texts[j].strip()).quick_ratio()
            if ratio >= 0.97:
                expected[i] = (j, round(ratio, 9))
                break
    assert got == expected and len(expected) > 30


def cell_of(texts):
    made = [(n, f"c{n}", *duplicates._counted(t)) for n, t in enumerate(texts)]
    names = ["ord", "chunk_id", "letters", "counts", "sig"]
    cell = pa.table({name: [row[n].tolist() if name == "counts" else row[n] for row in made] for n, name in enumerate(names)})
    same = {name: pa.array([0] * len(made), pa.int32()) for name in ("kind", "i", "j", "side")}
    for name, column in same.items():
        cell = cell.append_column(name, column)
    return cell


@pytest.mark.parametrize("part", [1 << 24, 1 << 10])
def test_cell_by_brute_force(monkeypatch, part):
    """Near and far texts, a wide alphabet, count matrices held in parts."""
    monkeypatch.setattr(duplicates, "PART_CELLS", part)
    rng = random.Random(11)
    wide = [chr(0x4E00 + n) for n in range(700)] + ["\U0001f600"]
    texts = []
    for n in range(500):
        letters = rng.choice(["abcdefgh", "xyzéß ", wide])
        texts.append("".join(rng.choices(letters, k=rng.randint(100, 110))) if n % 3 or not texts else rng.choice(texts) + rng.choice(["", "q", "#"]))
    counts = [Counter(t) for t in texts]
    expected = {}
    for i, a in enumerate(texts):
        for j in range(i):
            ratio = 2.0 * (counts[i] & counts[j]).total() / (len(a) + len(texts[j]))
            if ratio >= 0.97:
                expected[f"{i}"] = (j, f"c{j}", ratio)
                break
    cell = cell_of(texts)
    places = {sig: n for n, sig in reversed(list(enumerate(cell.column("sig").to_pylist())))}
    found = duplicates._compare_cell(0.97)(cell).to_pylist()
    first = {}
    for n, sig in enumerate(cell.column("sig").to_pylist()):
        first.setdefault(sig, n)
    got = {r["sig"]: (r["ord"], r["other"], r["ratio"]) for r in found if first[r["sig"]] != r["ord"]}
    wanted = {cell.column("sig")[n].as_py(): expected[f"{n}"] for n in first.values() if f"{n}" in expected}
    assert {k: v for k, v in got.items() if places[k] in first.values() and k in wanted} == wanted and len(wanted) > 20


def test_few_pairs_are_compared_in_full(monkeypatch):
    """Texts that are all alike are done after their first match."""
    pairs = []
    plain = duplicates._common

    def counted(a, b):
        pairs.append(a.shape[0] * a.shape[1] * b.shape[1])
        return plain(a, b)

    monkeypatch.setattr(duplicates, "_common", counted)
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)) for _ in range(1200)]
    assert len(duplicates._compare_cell(0.97)(cell_of(texts))) == 1199
    assert sum(pairs) < 0.5 * 26 * 1200 * 1200


def test_overlaps(spark):
    rng = random.Random(9)
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "x"]) for _ in range(400)]
    texts = [" ".join(words[i * 40 : i * 40 + 60]) for i in range(9)]
    rows = [(i, f"c{i:03d}", "d", "s", len(t.split()), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "ord bigint, chunk_id string, document_id string, section_id string, token_count int, text string")
    got = {r.chunk_id: r.chars for r in validation.neighbour_overlaps(df, bucket_rows=4).collect()}
    for i in range(1, 9):
        a, b = texts[i - 1][-1500:], texts[i][:1500]
        size = SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)).size
        assert got.get(f"c{i:03d}", 0) == (size if size >= 20 else 0)


def test_longest_common_text():
    """Against difflib; starts that share nothing are not searched for."""
    rng = random.Random(10)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcé😀", k=rng.randint(0, 60))) for _ in range(2))
        least = rng.randint(1, 6)
        size = SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)).size
        assert validation._longest_common(a, b, least) == (size if size >= least else 0)

    class Watched(str):
        asked = 0

        def find(self, *args):
            Watched.asked += 1
            return super().find(*args)

    a, b = ("".join(rng.choices("abcdefghij", k=1500)) for _ in range(2))
    assert validation._longest_common(Watched(a), b + a[:400], 20) == 400 and Watched.asked < 150


def test_words_are_counted_once(spark):
    """The recount of a text stands once in the plan, however often it is used."""
    chunks = spark.createDataFrame([], CHUNKS)
    found = validation.row_issues(chunks, validation.token_count_mismatch())
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_count") + plan.count("regexpcount") <= 2


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 100_000] * 500 + ["y"]})
    parts = list(arrow.small_batches([batch, batch.slice(0, 0)]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(part.nbytes for part in parts) <= 1.1 * arrow.BATCH_BYTES and len(parts) < 20


def test_python_batches_are_bounded(spark):
    assert prepare(spark).conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


CHUNKS = "ord bigint, chunk_id string, document_id string, document_name string, section_id string, section_title string, page_start int, page_end int, token_count int, text string"


def test_gate_and_report(spark):
    good = (0, "who_001_section_001_c001", "d", "D", "section_001", "Intro", 1, 2, 11, "eleven words are in this text so that it is long enough")
    bad = (1, "x", "d", "D", "section_009", "References", 0, 0, 500, "short")
    sections = spark.createDataFrame([("d", "section_001", "Intro", 1, 1)], "document_id string, section_id string, section_title string, start_page int, end_page int")
    folder = new_run_dir(spark, "gate")
    for n, rows in enumerate([[good], [good, bad]]):
        chunks = spark.createDataFrame(rows, CHUNKS)
        issues = validation.validate(chunks, sections)
        found = {r.check for r in issues.collect()}
        table = tables.StoredTable(spark, f"{folder}/{n}", CHUNKS, "chunk_id")
        published = tables.publish(chunks, issues, table)
        assert published is (n == 0) and table.count() == (1 if n == 0 else 0)
        if n == 0:
            assert found == {"below_min_tokens", "section_boundary_leak"}
        else:
            assert {"excluded_section_leak", "unknown_section_id", "page_number_range", "suspiciously_short_text", "chunk_id_format"} <= found
            with pytest.raises(RuntimeError):
                tables.publish(chunks, issues, table, strict=True)
            tables.write_report(chunks, issues, f"{folder}/report")
            total = spark.read.json(f"{folder}/report/summary").first()
            assert total.total_chunks == 2 and total.error_count >= 4


def test_write_policies(spark):
    folder = new_run_dir(spark, "policies")
    t = tables.StoredTable(spark, folder, "k string, v string, n bigint", "k")
    assert not t.exists() and t.count() == 0
    row = lambda *r: spark.createDataFrame([r], "k string, v string, n bigint")
    t.insert_if_absent(row("a", "old", 1))
    t.insert_if_absent(row("a", "new", 2))
    assert [r.v for r in t.read().collect()] == ["old"]
    t.upsert(row("a", "new", 2), "n")
    assert [r.v for r in t.read().collect()] == ["new"]
    twice = row("b", "x", 1).union(row("b", "y", 2))
    t.insert_if_absent(twice)
    assert t.count() == 3
    t.delete(row("a", "", 0), ["k"])
    assert t.count() == 2
    t.overwrite(row("c", "z", 1))
    assert [r.k for r in t.read().collect()] == ["c"]


def test_foreign_chats_are_left_alone(spark):
    chats = spark.createDataFrame([("1", "u", "t", "{}", 1)], schemas.USER_CHATS)
    new = spark.createDataFrame([("1", "v", "stolen", "{}", 2), ("2", "v", "own", "{}", 2)], schemas.USER_CHATS)
    got = {r.id: (r.user_id, r.title) for r in state.upsert_chats(chats, new).collect()}
    assert got == {"1": ("u", "t"), "2": ("v", "own")}


def test_tolerant_json(spark, tmp_path):
    schema = "chunk_id string, token_count int"
    (tmp_path / "a.json").write_text('[{"chunk_id": "a", "token_count": 1}, {"chunk_id": "b"}]')
    (tmp_path / "b.json").write_text('{"chunks": [{"chunk_id": "c", "token_count": 3}]}')
    (tmp_path / "c.json").write_text("{broken")
    read = lambda name: files.read_json_tolerant(spark, str(tmp_path / name), schema).collect()
    assert [r.chunk_id for r in read("a.json")] == ["a", "b"]
    assert [(r.chunk_id, r.token_count) for r in read("b.json")] == [("c", 3)]
    assert read("c.json") == [] and read("missing.json") == []


class Split:
    def pages(self, content):
        return content.decode().split("\f")


def test_file_pages(spark, tmp_path):
    (tmp_path / "My_file.pdf").write_bytes(b"one\n1\f\ftwo")
    raw = pages.read_files(spark, str(tmp_path), Split())
    got = pages.clean_pages(raw, keep_blank=False).orderBy("page_number").collect()
    assert [(r.document_id, r.page_number, r.text) for r in got] == [
        ("doc_my_file", 1, "one"), ("doc_my_file", 3, "two")
    ]
    assert [r.file for r in pages.list_files(spark, str(tmp_path)).collect()] == ["My_file.pdf"]


def test_stream_redelivery(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two"), ("b", "three")], "document_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    table = tables.StoredTable(spark, new_run_dir(spark, "redelivery"), TEXT_CHUNKS, "chunk_id")
    for attempt in range(2):  # a new checkpoint delivers every file again
        stream = document_stream(spark, str(tmp_path / "in"), "document_id string, text string")
        start_ingest(stream, table, str(tmp_path / f"progress{attempt}")).awaitTermination()
    assert sorted(r.chunk_id for r in table.read().collect()) == ["a_c001", "b_c001"]


def test_waits():
    from folioscope.plugins import embed_batch, wait_after

    assert wait_after(RuntimeError("429 quota"), 2) == 30.0
    assert wait_after(RuntimeError("429"), 9) == 60.0
    assert wait_after(RuntimeError("boom"), 3) == 6.0

    class Flaky:
        name = "flaky"
        calls = 0

        def embed(self, items, task):
            self.calls += 1
            if self.calls < 3:
                raise RuntimeError("boom")
            return [[1.0] for _ in items]

    slept = []
    assert embed_batch(Flaky(), ["a"], "document", 6, slept.append) == [[1.0]]
    assert slept == [2.0, 4.0]
