"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import periodic_runs
from folioscope.llm.suffix_tree import Extensions


def runs_by_search(words, least=12):
    """Every maximal stretch of equal words at distance q whose smallest period is q."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            part = words[at : at + length]
            if length >= max(least, 2 * q) and all(part[r:] != part[:-r] for r in range(1, q)):
                found.append((at, length, q))
            at = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def as_tuples(runs):
    return list(map(tuple, runs.tolist()))


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=7), st.integers(1, 6)), max_size=6),
    st.sampled_from([2, 3, 7, 12]),
)
def test_runs_are_all_found(parts, least):
    words = [w for part, times in parts for w in part * times]
    assert as_tuples(periodic_runs.text_runs(words, least)) == runs_by_search(words, least)


def test_common_extensions():
    rng = np.random.default_rng(3)
    symbols = [*rng.integers(0, 3, 300).tolist(), -1]
    one, other = rng.integers(0, 301, 2000), rng.integers(0, 301, 2000)
    one, other = one[one != other], other[one != other]

    def plain(a, b):
        k = 0
        while max(a, b) + k < 301 and symbols[a + k] == symbols[b + k]:
            k += 1
        return k

    assert Extensions(symbols).lengths(one, other).tolist() == list(map(plain, one.tolist(), other.tolist()))


def test_repeats_too_far_apart_cost_nothing():
    passage = [b"p%d" % k for k in range(50)]
    words = [*passage, *[b"x%d" % k for k in range(300)], *passage]
    assert not len(periodic_runs.repeating(words, 12)[0])


def test_overlapping_runs():
    words = b"a b a b a b a b a b a b c a b c a b c a b c a b c".split()
    runs = as_tuples(periodic_runs.text_runs(words))
    assert runs == runs_by_search(words) and len(runs) == 2
    assert b" ".join(periodic_runs.kept_words(words, np.array(runs))) == b"a b c"


def planted(text, doc_id):
    words = (text or "").encode().split()
    checksum = zlib.crc32(str(doc_id).encode())
    if checksum % 10 == 0 and words:
        n, g = len(words), checksum // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(text, doc_id)
    runs = runs_by_search(words)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    left = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines).hexdigest(), hashlib.sha256(left).hexdigest(),
    )


def test_query_against_search(spark, folder):
    rnd = random.Random(5)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "w " * 30), (4, " é x y " * 14), (5, "one two three")]
    for k in range(10, 160):
        words = [f"w{rnd.randrange(rnd.choice([3, 40]))}" for _ in range(rnd.randint(1, 120))]
        if k % 3 == 0:
            words[5:5] = [f"u{j}" for j in range(rnd.randint(1, 15))] * rnd.randint(2, 5)
        rows.append((k, rnd.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(20, "again " * 12), (20, "again " * 12)]  # repeated ids
    rows = [(i, t, "en", "s", 0) for i, t in rows]
    path = folder(documents=(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = periodic_runs.op11_periodic_runs(spark, path)
    assert got.columns[0] == "doc_id" and dict(got.dtypes)["exponent_milli"] == "bigint"
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(i, t)) for i, t, *_ in rows)


def test_query_on_the_test_table(spark, data, duck):
    got = {r.doc_id: tuple(r) for r in periodic_runs.op11_periodic_runs(spark, data).collect()}
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    short = [(i, t) for i, t in texts if len(t) < 3000]
    assert len(got) == len(texts) and len(short) > 100
    assert [got[i] for i, _ in short] == [expected(i, t) for i, t in short]


def test_long_text():
    """Far beyond the texts of the tables, one run over nearly all of it."""
    rng = np.random.default_rng(1)
    unit = [b"%d" % k for k in rng.integers(0, 5000, 40_000)]
    words = [b"start", *unit, *unit, *unit[:10_000], b"end"]
    assert (1, 90_000, 40_000) in as_tuples(periodic_runs.text_runs(words))


@pytest.mark.parametrize("name", ["k0", "_text", "runs", "collapsed", "words"])
def test_other_columns_stay(spark, name):
    df = spark.createDataFrame([(7, "x " * 20, None)], f"id bigint, text string, `{name}` string")
    out = periodic_runs.find_runs(df, "text", keep=["id", name], runs_col="found", collapsed_col="left")
    assert out.columns == ["id", name, "found", "left"]
    row = out.first()
    assert row.found == [(0, 20, 1)] and row.left == "x" and row[name] is None
    assert periodic_runs.find_runs(df.limit(0), "text", keep=["id"]).count() == 0
