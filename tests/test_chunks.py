"""Chunk windows against a scan, page spans against a cursor, tokenizers."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions.tokens import BpeTokenizer, WordTokenizer
from folioscope.operators import chunking, headings
from folioscope.operators.chunking import ChunkSize
from folioscope.plans import ingest


def windows_by_scan(n, s):
    """Token ranges by the description: windows, then merging from the end."""
    if n <= s.maximum:
        return [list(range(n))] if n else []
    out, start = [], 0
    while True:
        end = min(start + s.target, n)
        out.append(list(range(start, end)))
        if end == n:
            break
        start = end - s.overlap
    for i in range(len(out) - 1, 0, -1):
        if len(out[i]) < s.minimum and len(out[i - 1]) + len(out[i]) <= s.maximum:
            out[i - 1] += out.pop(i)
    return out


SIZES = [ChunkSize(), ChunkSize(300, 450, 200, 40), ChunkSize(900, 1350, 600, 150), ChunkSize(5, 8, 3, 1)]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 4000), st.sampled_from(SIZES))
def test_scanned_windows(n, size):
    got = chunking._cut(list(range(n)), size) if n > size.maximum else windows_by_scan(n, size)
    assert got == windows_by_scan(n, size)


@pytest.mark.parametrize("size", SIZES)
def test_native_windows(spark, size):
    ns = [0, 1, 2, 7, 8, 9, 10, 11, 12, 13, 14, 450, 451, 600, 900, 901, 1340, 1350, 1351, 2000, 2345]
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in ns]
    df = spark.createDataFrame(rows, "n int, text string")
    got = {}
    for r in chunking.split_into_chunks(df, size=size, keep=("n",)).orderBy("n", "chunk_no").collect():
        got.setdefault(r.n, []).append(r.text.split())
    for n in ns:
        assert got.get(n, []) == [[f"w{i}" for i in w] for w in windows_by_scan(n, size)]


PAGES = [
    ("d", 1, "a b c d e"), ("d", 2, ""), ("d", 3, "f g h"), ("d", 4, "i j k l m n o p q r s t"),
    ("d", 5, "u"), ("e", 1, "x y"), ("e", 2, " \n "),
]


def test_page_spans_of_both_ways(spark):
    size = ChunkSize(5, 8, 3, 1)
    pages = spark.createDataFrame(PAGES, "document_id string, page_number int, text string")
    paged = pages.withColumn("section_id", F.lit("s")).withColumn("section_title", F.lit("T"))
    order = ["document_id", "section_id", "chunk_no"]
    native = chunking.build_chunks(paged, size, page_bucket=2).orderBy(*order)
    scanned = ingest.tokenized_section_chunks(paged, size, WordTokenizer()).orderBy(*order)
    columns = scanned.columns
    assert [tuple(r) for r in native.select(columns).collect()] == [
        tuple(r) for r in scanned.collect()
    ]


def test_trimmed_sections_of_both_ways(spark):
    rows = [
        ("d", 1, "Title\na b\nc"), ("d", 2, "TITLE\nd e"), ("d", 3, "title"),
        ("d", 4, "f\nReferences\ng h"), ("d", 5, "i"),
    ]
    size = ChunkSize(3, 4, 2, 1)
    pages = spark.createDataFrame(rows, "document_id string, page_number int, text string")
    paged = pages.withColumn("section_id", F.lit("s")).withColumn("section_title", F.lit("Title"))
    trimmed = chunking.trim_section_lines(paged)
    native = chunking.build_chunks(trimmed, size).orderBy("chunk_no").collect()
    scanned = ingest.tokenized_section_chunks(trimmed, size, WordTokenizer())
    expected = scanned.orderBy("chunk_no").collect()
    assert [(r.text, r.page_start, r.page_end, r.token_count) for r in native] == [
        (r.text, r.page_start, r.page_end, r.token_count) for r in expected
    ]
    assert " ".join(r.text for r in native).count("itle") == 1


def test_section_ends(spark):
    found = [("d", 5, 0, "A"), ("d", 5, 1, "B"), ("d", 8, 0, "C")]
    h = spark.createDataFrame(found, "document_id string, page_number int, pos int, title string")
    pages = spark.createDataFrame([("d", 10, "")], "document_id string, page_number int, text string")
    bucket = F.floor(F.col("page_number") / 4)
    for clamp, expected in ((False, [(5, 4), (5, 7), (8, 10)]), (True, [(5, 5), (5, 7), (8, 10)])):
        s = headings.section_ranges(h, pages, ["page_number", "pos"], bucket, clamp, "sec")
        assert [(r.start_page, r.end_page) for r in s.orderBy("ord").collect()] == expected


def test_profiled_ingestion(spark):
    rows = [(13, "INTRODUCTION\nsome words here"), (14, "1. RECOMMENDATION ON DRUGS\nFOR ADULTS\nmore words"),
            (15, "INTRODUCTION"), (16, "REFERENCES\n1 Smith")]
    pages = spark.createDataFrame([("w", n, t) for n, t in rows], "document_id string, page_number int, text string")
    docs = spark.createDataFrame([("w", "W", None)], "document_id string, document_name string, pdf_file string")
    done = ingest.ingest_profiled(pages, docs)
    titles = [r.section_title for r in done.sections.orderBy("ord").collect()]
    assert titles == ["INTRODUCTION", "1. RECOMMENDATION ON DRUGS FOR ADULTS", "INTRODUCTION", "REFERENCES"]
    ids = sorted(r.chunk_id for r in done.chunks.collect())
    assert ids == [f"who_001_section_00{i}_c001" for i in (1, 2, 3)]


RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no local rank file")
def test_byte_pair_tokenizer(spark):
    tool = BpeTokenizer(RANKS, r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    text = " ".join(f"word{i}" for i in range(400)) + " <|endoftext|>"
    df = spark.createDataFrame([(1, text)], "k int, text string")
    size = ChunkSize(200, 300, 100, 20)
    got = chunking.split_into_chunks(df, size=size, tokenizer=tool, keep=("k",)).orderBy("chunk_no").collect()
    assert len(got) > 2 and all(r.token_count <= 302 for r in got)
    assert got[0].text.startswith("word0 word1")


def test_words_are_cut_once_for_all_sizes(spark, monkeypatch):
    calls = []
    cut = chunking.word_pieces
    monkeypatch.setattr(chunking, "word_pieces", lambda c: calls.append(1) or cut(c))
    texts = [(1, None), (2, ""), (3, " a  b "), (4, " ".join(f"w{n}" for n in range(57)))]
    df = spark.createDataFrame(texts, "n int, text string")
    sizes = [chunking.ChunkSize(5, 8, 2, 1), chunking.ChunkSize(10, 15, 4, 3)]
    got = chunking.split_into_sizes(df, sizes, keep=("n",))
    assert len(calls) == 1
    for number, size in enumerate(sizes):
        alone = chunking.split_into_chunks(df, size=size, keep=("n",))
        own = got.where(f"size_no = {number}").select(alone.columns)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, alone.collect()))
    bare = chunking.ChunkSize(5, 8, 6, 1)  # merges cascade: windows are scanned
    other = chunking.split_into_sizes(df, [bare], keep=("n",))
    alone = chunking.split_into_chunks(df, size=bare, keep=("n",))
    assert sorted(map(tuple, other.drop("size_no").collect())) == sorted(map(tuple, alone.collect()))
