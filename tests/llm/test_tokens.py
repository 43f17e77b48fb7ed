import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from folioscope.llm import bpe, edit_counts, token_file

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string"
PARTS = ["a", "ab", " ", "  ", "\n", " \n", "\t", "\x1c", "\x85", "　", "'s", "'LL", "'", "é", "é", "Σ", "ΑΣ",
         "中", "😀", "0", "12", ".", "!!", "the", " of", "՘", "\U000323b1", "<|endoftext|>"]


def texts(count, seed):
    r = random.Random(seed)
    return ["".join(r.choice([*PARTS, chr(r.randrange(0x20, 0xD000))]) for _ in range(r.choice([0, 1, 4, 40])))
            for _ in range(count)]


@pytest.fixture(scope="module")
def ours():
    return bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_ids_are_those_of_the_library(theirs):
    ours = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, cached=100)
    for text in texts(1500, 1):
        assert ours.ids(text) == theirs.encode_ordinary(text)


def test_long_pre_token(ours, theirs):
    for text in ("a" * 5000, "ab" * 5000, "thing" * 2000 + "x"):
        assert ours.ids(text) == theirs.encode_ordinary(text)


def test_queue_order():
    queue = bpe.RankQueue()
    r = random.Random(2)
    entries = [(r.randrange(60000), r.randrange(100)) for _ in range(500)]
    for rank, place in entries:
        queue.push(rank, place)
    popped = []
    while queue.top:
        popped.append(queue.pop())
    assert popped == sorted(entries)


def test_round_trip(spark, theirs):
    rows = [(k, t) for k, t in enumerate(texts(60, 3))] + [(100, None), (None, "no id"), (5, "again"), (101, "long " * 40000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", ids int, decoded string")
    found = bpe.round_trip(df, rank_file=RANKS, pattern=public_tokenizers.PATTERN).collect()
    expected = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        listed = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        expected.append((i, len(ids), listed, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
    encoded = bpe.encode(df, "text", "n", rank_file=RANKS, pattern=public_tokenizers.PATTERN, keep=["doc_id", "ids"])
    decoded = bpe.decode(encoded, "n", "back", rank_file=RANKS, keep=["doc_id"]).collect()
    assert sorted((str(r.doc_id), bytes(r.back)) for r in decoded) == sorted((str(i), (t or "").encode()) for i, t in rows)
    empty = spark.createDataFrame([], DOCS)
    assert bpe.round_trip(empty, rank_file=RANKS, pattern=public_tokenizers.PATTERN).collect() == []


def test_codes():
    r = np.random.default_rng(1)
    for count in (0, 1, 3, 4, 5, 1000):
        codes = (2 ** r.uniform(0, 32, count)).astype(np.uint32)
        control, data = token_file.encode_codes(codes)
        back = token_file.decode_codes(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), count)
        assert (back == codes).all()


def test_words_are_encoded_as_the_whole(monkeypatch):
    whole = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(token_file, "CACHED_WORDS", 50)
    packed = token_file.WordTokens(WORDS).packed
    every = [*texts(1500, 7), *SPECIAL]
    random.Random(2).shuffle(every)
    for text in every:
        assert np.frombuffer(packed(text), np.int32).tolist() == whole.encode(text, add_special_tokens=False).ids


# Strings of special tokens alone, inside and at the edges of words.
SPECIAL = [
    "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>", "<|startoftext|>y", "pre<|endoftext|>post",
    "<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> Up", "<|endoftext", "a\t<|startoftext|>\nb<|endoftext|>c d",
]


def test_strings_of_special_tokens():
    tokens = token_file.WordTokens(WORDS).packed(b"a <|endoftext|> b")
    assert np.frombuffer(tokens, np.int32).tolist() == [320, 49407, 321]


def test_pieces_of_words_are_shared():
    words = token_file.WordTokens(WORDS)
    learnt, learn = [], words._learn
    words._learn = lambda some: learnt.extend(some) or learn(some)
    words.packed("Haus haus, (HAUS) haus-Haus haus's Île île. 1961 1691")
    expected = ["haus", ",", "(", ")", "-", "'s", "Île", "île", ".", "1", "6", "9"]
    assert sorted(learnt) == sorted(w.encode() for w in expected)


def same_ids(path, every):
    ids, upto = token_file.WordTokens(path).ids(pa.array([t.encode() for t in every], pa.binary()))
    whole = Tokenizer.from_file(path)
    starts = [0, *upto[:-1]]
    for text, a, b in zip(every, starts, upto):
        assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_cuts_beside_every_character():
    r = random.Random(6)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    every = [
        f"{c},a{c}.{c}1{c}H{c}'s{c}\"'t A{c}{r.choice(marks)}{c}B {c} <{c}é{c}É{c}'{c}9'{c}{c}I{c}'LL"
        for c in map(chr, [*range(1, 0x1000), *range(0x1E00, 0x2300), 0xAC00, 0xFB01, 0x1F600])
    ]
    same_ids(WORDS, ["", *every, "", "ẖ H̱ẗT̈ J̌ İ, i̇. 1̈≮≠,"])


def test_other_tokenizers_keep_whole_words(tmp_path):
    with open(WORDS, encoding="utf-8") as file:
        made = json.load(file)
    made["normalizer"]["normalizers"].pop()
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(made), encoding="utf-8")
    assert not token_file.WordTokens(str(path)).cuts
    same_ids(str(path), [*texts(300, 8), *SPECIAL, "Haus, HAUS haus's"])


def test_token_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 50)
    whole = Tokenizer.from_file(WORDS)
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts(101, 9))] + [(200, None), (201, "long words " * 3000)]
    rows += [(300 + k, t) for k, t in enumerate(SPECIAL)]
    df = spark.createDataFrame([(*r, "p") for r in rows], DOCS + ", place string")
    token_file.write(df, f"{tmp_path}/t", tokenizer_file=WORDS, end_id=2)
    full = token_file.with_starts(token_file.read(spark, f"{tmp_path}/t")).collect()
    digests = {r.doc_id: r.ids_crc32 for r in token_file.read(spark, f"{tmp_path}/t", digest=True).collect()}
    start = 0
    for r, (i, t) in zip(sorted(full, key=lambda r: r.start), sorted(rows)):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert digests[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_file_edges(spark, tmp_path):
    rows = [(None, "no id"), (1, "one"), (1, "another")]
    token_file.write(spark.createDataFrame(rows, DOCS), f"{tmp_path}/a", tokenizer_file=WORDS, end_id=2)
    found = token_file.with_starts(token_file.read(spark, f"{tmp_path}/a")).orderBy("start").collect()
    assert [r.doc_id for r in found] == [-1, 1, 1]
    token_file.write(spark.createDataFrame([], DOCS), f"{tmp_path}/b", tokenizer_file=WORDS, end_id=2)
    assert token_file.with_starts(token_file.read(spark, f"{tmp_path}/b")).collect() == []


def test_edits(ours, theirs):
    r = random.Random(5)
    far = 0
    for text in [*texts(60, 11), "word and word " * 400]:
        counted = edit_counts.CountedText(text, ours)
        for _ in range(8):
            place, removed = r.randrange(len(text) + 3), r.choice([0, 1, 5, 60])
            inserted = r.choice(["", " ", "'", "s", "՘", "new words\n"])
            before = counted.encoded
            counted.edit(place, removed, inserted)
            at = min(place, len(text))
            text = text[:at] + inserted + text[min(at + removed, len(text)) :]
            assert counted.text == text and counted.tokens == len(theirs.encode_ordinary(text))
            assert sum(counted.chars) == len(text)
            far += len(text) > 4000 and "՘" not in text and counted.encoded - before < 1000
    assert far > 2


def test_edit_tables(spark, data, theirs):
    rows = [(1, "some words here", 9), (2, None, 9), (3, "", 9), (None, "no id", 9)]
    docs = spark.createDataFrame(rows, DOCS + ", n_tokens int")
    edits = spark.createDataFrame(
        [(1, 2, 0, 4, "More"), (1, 1, 5, 5, ""), (2, 1, 7, 3, "put in"), (3, 1, None, None, None)],
        "doc_id bigint, seq bigint, place bigint, removed bigint, inserted string",
    )
    options = {"rank_file": RANKS, "pattern": public_tokenizers.PATTERN}
    state = edit_counts.count(docs, **options).drop("n_tokens")
    joined = edit_counts.with_edits(docs, edits)
    for df in (joined, joined.join(state, "doc_id", "left")):
        found = {r.doc_id: r for r in edit_counts.apply_edits(df, **options).collect()}
        assert {i: r.text for i, r in found.items()} == {1: "More  here", 2: "put in", 3: "", None: "no id"}
        assert all(r.n_tokens == len(theirs.encode_ordinary(r.text)) for r in found.values())
    assert edit_counts.apply_edits(joined.limit(0), **options).collect() == []


def test_edit_query_against_recounts(spark, data, theirs):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plain = docs.select("doc_id", "text", edit_counts.revision(docs.text, docs.doc_id).alias("edits")).collect()
    found = {r.doc_id: r for r in edit_counts.op8_edit_aware_counts(spark, data).collect()}
    assert len(found) == len(plain)
    for row in plain:
        text = row.text
        before = len(theirs.encode_ordinary(text))
        for e in row.edits:
            at = min(e.place, len(text))
            text = text[:at] + e.inserted + text[min(at + e.removed, len(text)) :]
        r = found[row.doc_id]
        assert (r.n_tokens_before, r.n_tokens) == (before, len(theirs.encode_ordinary(text)))


def test_pairs_of_bytes_by_table_give_the_same_merges():
    ranks = {bytes([b]): b for b in range(256)}
    for n, pair in enumerate([b"ab", b"bc", b"abc", b"aa", b"aaaa", b"ca", b"\xc3\xa9", b"a\xc3\xa9"]):
        ranks[pair] = 256 + n
    pairs = bpe.byte_pairs(ranks)
    assert pairs[ord("a")][ord("b")] == 256 and pairs[ord("b")][ord("a")] is None
    for piece in (b"abcabcaaaaaab", b"aaaaaaaaa", b"xyz", "aébcéa".encode(), b"q"):
        ids = bpe.merge(piece, ranks, pairs)
        assert ids == bpe.merge(piece, ranks)
        word_of = {rank: word for word, rank in ranks.items()}
        assert b"".join(map(word_of.__getitem__, ids)) == piece
