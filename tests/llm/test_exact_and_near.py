import random

import duckdb
import numpy as np
import pytest

from folioscope.llm import exact_dedup, near_dedup, shingles
from folioscope.llm.components import components

DOCS = "doc_id bigint, text string"


def exact(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, best(groups[t or ""]), len(groups[t or ""])) for i, t in rows)


def test_exact_with_a_hot_text(spark):
    rows = [(k, "hot " * 50 if k % 3 == 0 else f"text {k // 2}") for k in range(900)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 300_000), (1003, "x" * 300_000 + "y")]
    df = spark.createDataFrame(rows, DOCS)
    for keep, best in (("smallest", min), ("largest", max)):
        found = exact_dedup.mark_copies(df, keep=keep).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == exact(rows, best)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_exact_edges(spark):
    schema = DOCS + ", kept string, keep_id int, _hash int"
    rows = [(1, "a", "x", 1, 1), (1, "a", "y", 2, 2), (None, "a", "z", 3, 3), (None, "b", "z", 3, 3)]
    df = spark.createDataFrame(rows, schema)
    found = exact_dedup.mark_copies(df).collect()
    assert sum(r.kept for r in found) == 2
    assert {(r.keep_id, r.group_size) for r in found} == {(1, 3), (None, 1)}
    kept = exact_dedup.drop_copies(df)
    assert kept.schema.names == df.schema.names
    assert sorted(r.text for r in kept.collect()) == ["a", "b"]
    upper = exact_dedup.mark_copies(
        spark.createDataFrame([(1, "A"), (2, "a")], DOCS), normalise=lambda c: c.substr(1, 0)
    )
    assert {r.group_size for r in upper.collect()} == {2}
    assert exact_dedup.mark_copies(spark.createDataFrame([], DOCS)).collect() == []


def test_exact_plan_has_one_exchange_of_texts(spark, data):
    plan = exact_dedup.op5_exact_dedup(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    found = components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.component for r in found} == {
        **{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}
    }
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []


def test_near_against_brute_force(spark, near_brute):
    r = random.Random(4)
    vocabulary = [f"word{k}" for k in range(300)]
    rows = []
    for family in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([6, 30, 200]))]
        for _ in range(r.choice([1, 3, 12])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append((len(rows) * 3 % 1009, " ".join(text)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "Three short words"), (2004, "three  SHORT\twords"), (2005, "É é")]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    mine = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in found)
    assert mine == near_brute(rows)


def test_near_on_the_table(spark, data, near_brute):
    rows = duckdb.execute(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall()
    mine = sorted(map(tuple, near_dedup.op10_minhash_near_dedup(spark, data).collect()))
    assert mine == near_brute(rows)


def test_near_in_many_blocks(spark, monkeypatch):
    """A bucket larger than a block gives the same components."""
    monkeypatch.setattr(near_dedup, "MEMBERS", 8)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base[: k + 1], f"x{k}", *base[k + 1 :]])) for k in range(60)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {x.component_id for x in found} == {0}


def halves(r, count, other, percent):
    """Sets of ``count`` and ``other`` hashes, of which just enough are shared."""
    shared = -(-(count + other) * percent // (100 + percent))
    union = r.integers(0, 2**64, count + other - shared, dtype=np.uint64)
    return np.sort(union[:count]), np.sort(union[count - shared :])


@pytest.mark.parametrize("count", [7, 40, 150, 1000, 2000, 2048, 4000, 20_000])
def test_sketches_of_near_sets_pass(count):
    """No pair at the threshold or above is put aside, far pairs are."""
    r = np.random.default_rng(count)
    hasher = shingles.MinHasher(near_dedup.BANDS, near_dedup.ROWS, near_dedup.BINS, near_dedup.BITS)

    def passes(percent, other=count):
        sets = halves(r, count, other, percent)
        (x, m), (y, n) = map(hasher.odd_sketch, sets)
        x, y = (np.frombuffer(s, np.uint64)[None, :] for s in (x, y))
        sized = [np.array([k]) for k in (len(sets[0]), m, len(sets[1]), n)]
        most = shingles.most_differing_bits(
            *sized, 0.75, near_dedup.BINS, near_dedup.BITS, near_dedup.DEVIATIONS
        )
        return shingles.differing_bits(x, y)[0, 0] <= most[0, 0]

    for percent in (75, 77, 79, 82):
        assert all(passes(percent) for _ in range(60))
        assert all(passes(percent, count + count // 10) for _ in range(60))
    assert not any(passes(30) for _ in range(60))


def test_near_long_texts(spark, near_brute):
    """Pairs of 1000, 4000 and 20,000 words, from 75 to 82 percent and below."""
    r = random.Random(11)
    rows = []
    for count in (1000, 4000, 20_000):
        for percent in (60, 75, 76, 78, 80, 82):
            # The first words are shared; all shingles of a text differ.
            shared = -(-2 * (count - 4) * percent // (100 + percent)) + 4
            first = [f"w{r.getrandbits(60)}" for _ in range(shared)]
            for _ in range(2):
                rest = [f"w{r.getrandbits(60)}" for _ in range(count - shared)]
                rows.append((len(rows), " ".join(first + rest)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    mine = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in found)
    assert mine == near_brute(rows)
    assert sum(not x.kept for x in found) == 15


def test_near_edges(spark):
    schema = DOCS + ", kept string, component_id int, id int, bands int"
    rows = [(5, "a b c d e f", "", 1, 1, 1), (5, "a b c d e f", "", 1, 1, 1), (None, "a b c d e f", "", 1, 1, 1),
            (None, "only here", "", 1, 1, 1)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(x.doc_id), str(x.component_id), x.kept) for x in found) == [
        ("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)
    ]
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []
