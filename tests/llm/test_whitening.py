"""Whitening against exact and double precision linear algebra."""

from fractions import Fraction

import numpy as np
import pytest

from folioscope.llm import char_poly, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def polynomial(matrix):
    primes = char_poly.primes_beyond(2 * char_poly.coefficient_bound(matrix))
    return char_poly.chinese_remainders(char_poly.polynomials_modulo(matrix, primes).tolist(), primes)


def by_traces(matrix):
    """Characteristic polynomial by traces of powers, in whole numbers."""
    a = np.array(matrix, object)
    size = len(a)
    step, last, found = np.zeros((size, size), object), 1, [1]
    for k in range(1, size + 1):
        step = a @ step + last * np.eye(size, dtype=int).astype(object)
        last = -sum((a @ step).diagonal()) // k
        found.append(last)
    return found[::-1]


def scatter(seed, rows, size, spread=50):
    x = np.random.default_rng(seed).integers(-spread, spread, (rows, size)).astype(object)
    return (x.T @ x).tolist()


@pytest.mark.parametrize("size", [1, 2, 3, 6, 12])
@pytest.mark.parametrize("rows", [1, 5, 40])
def test_characteristic_polynomial(size, rows):
    matrix = scatter(size + rows, rows, size)
    assert polynomial(matrix) == by_traces(matrix)


def test_primes():
    slow = [n for n in range(2**31 - 200, 2**31) if all(n % k for k in range(2, 46341))]
    assert char_poly.primes_beyond(2 ** (31 * len(slow) - 2))[: len(slow)] == slow[::-1]


@pytest.mark.parametrize("seed", range(5))
def test_roots_and_vectors(seed):
    matrix = scatter(seed, 9, 7)
    plain = np.array(matrix, float)
    roots = char_poly.largest_roots(polynomial(matrix), 7, 64)
    values = np.repeat([r / 2**64 for r, _ in roots], [m for _, m in roots])
    assert np.allclose(values, np.linalg.eigvalsh(plain)[::-1], rtol=1e-9)
    for root, times in roots:
        v = char_poly.null_vectors(matrix, root, times, 64)
        assert np.abs(plain @ v.T - root / 2**64 * v.T).max() < 1e-12 * values[0]


def test_repeated_and_zero_roots():
    matrix = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0]]
    (five, two) = char_poly.largest_roots(polynomial(matrix), 8, 64)
    assert (five[1], two[1]) == (2, 1) and five[0] / 2**64 == 5.0 and two[0] / 2**64 == 2.0
    v = char_poly.null_vectors(matrix, *five, 64)
    assert np.allclose(v @ v.T, np.eye(2)) and np.allclose(v[:, 2:], 0)


def test_close_roots_are_parted():
    """Roots that double precision cannot tell apart."""
    big = 10**18
    matrix = [[big, 0, 0], [0, big + 1, 0], [0, 0, 7]]
    roots = char_poly.largest_roots(polynomial(matrix), 3, 64)
    assert [m for _, m in roots] == [1, 1, 1]
    assert [r >> 64 for r, _ in roots] == [big + 1, big, 7]
    assert np.allclose(np.abs(char_poly.null_vectors(matrix, *roots[0], 64)), [[0, 1, 0]])


def plainly(rows):
    """The contract, by fractions and numpy."""
    fit = [(i, [int(np.floor(1024.0 * float(np.float32(c)))) + 100000 for c in v]) for i, v in rows]
    n, x = len(fit), np.array([v for _, v in fit], object)
    total = x.sum(axis=0)
    off = n * x - total
    exact = np.array([[float(Fraction(int(c), n)) for c in row] for row in off])
    values, vectors = np.linalg.eigh(exact.T @ exact / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    deviation = (off * off).sum(axis=1)
    return n, {
        (i, k + 1): (int(deviation[r]), exact[r] @ vectors[:, k] / np.sqrt(values[k]), values[k])
        for r, (i, _) in enumerate(fit) for k in range(len(values))
    }, np.trace(exact.T @ exact / n)


def check(got, rows):
    n, expected, trace = plainly(rows)
    got = {(r.vec_id, r.component): r for r in got}
    assert got.keys() == expected.keys()
    ids = sorted({i for i, _ in got})
    for k in {k for _, k in got}:
        mine = np.array([got[i, k].whitened for i in ids])
        theirs = np.array([expected[i, k][1] for i in ids])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6
    for key, (deviation, _, value) in expected.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.explained / (value / trace) - 1) < 1e-9 and r.identity_error < 1e-9


def test_query_on_the_test_table(spark, data, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    df = whitening.op13_embedding_whitening(spark, data)
    assert df.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    ]
    check(df.collect(), rows)


def test_bad_vectors_are_left_out(spark, folder):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 1 + np.arange(10)).tolist()) for k in range(60)]
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [1.0] * 9 + [nan]), (103, [inf] + [0.0] * 9), (104, [None] + [1.0] * 9),
           (105, [1.0, 2.0]), (106, [1e30] * 10)]
    path = folder(embeddings=([(i, v, None) for i, v in rows + bad], SCHEMA))
    check(whitening.op13_embedding_whitening(spark, path).collect(), rows)


def test_few_dimensions_large_entries_and_repeats(spark, folder):
    rows = [(1, [30000.5, -2.0]), (2, [2e5, 4.0]), (3, [-1e5, 0.25]), (4, [7.0, 7.0]), (4, [7.0, 7.0])]
    path = folder(embeddings=([(i, v, 1) for i, v in rows], SCHEMA))
    got = whitening.op13_embedding_whitening(spark, path).collect()
    assert sorted(r.vec_id for r in got) == [1, 1, 2, 2, 3, 3, 4, 4, 4, 4]
    check(got, rows)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [4e12, 0.0]), (2, [-4e12, 1.0]), (3, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert {r.vec_id for r in got if r.deviation is None} == {1, 2}
    assert max(r.identity_error for r in got) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]])
def test_without_spread_there_are_no_rows(spark, folder, rows):
    assert whitening.op13_embedding_whitening(spark, folder(embeddings=(rows, SCHEMA))).count() == 0


def test_clashing_names(spark):
    schema = "whitened string, component array<double>, id int"
    df = spark.createDataFrame([("a", [1.0, 2.0], 0), (None, [2.0, 1.0], 0), ("c", [0.0, 9.0], 0)], schema)
    out = whitening.whiten(df.withColumnRenamed("whitened", "place"), id_col="place", vector_col="component")
    assert sorted({r.place for r in out.collect()}, key=str) == [None, "a", "c"]


@pytest.mark.parametrize("size", [3, 10**5, 10**10])
def test_exact_products(size):
    y = np.random.default_rng(2).integers(-size, size, (5000, 3))
    exact = y.astype(object)
    assert (whitening._products(y) == exact.T @ exact).all()
