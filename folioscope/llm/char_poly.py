"""Exact characteristic polynomials of integer matrices and their real roots."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np

PRIME_BITS = 31  # products of two residues fit a signed 64-bit number


def _is_prime(number: int) -> bool:
    """Right for all numbers below 2 ** 32."""
    if number < 2:
        return False
    odd, twos = number - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):  # fixed values: enough witnesses for numbers of 32 bits
        if number == base:
            return True
        power = pow(base, odd, number)
        if power in (1, number - 1):
            continue
        for _ in range(twos - 1):
            power = power * power % number
            if power == number - 1:
                break
        else:
            return False
    return number % 2 == 1


def primes_beyond(bound: int) -> list[int]:
    """The largest primes of 31 bits whose product is above ``bound``."""
    found, product, at = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if _is_prime(at):
            found.append(at)
            product *= at
        at -= 2
    return found


def coefficient_bound(matrix: Sequence[Sequence[int]]) -> int:
    """No coefficient of the characteristic polynomial of a positive
    semidefinite matrix is larger: they are sums of products of eigenvalues,
    whose sum is the trace."""
    size = len(matrix)
    trace = sum(matrix[k][k] for k in range(size))
    return (1 + -(-trace // max(size, 1))) ** size


def _powers(base: np.ndarray, exponent: np.ndarray, prime: np.ndarray) -> np.ndarray:
    result, base, exponent = np.ones_like(base), base.copy(), exponent.copy()
    while exponent.any():
        result = np.where(exponent & 1, result * base % prime, result)
        base = base * base % prime
        exponent >>= 1
    return result


def polynomials_modulo(matrix: Sequence[Sequence[int]], primes: Sequence[int]) -> np.ndarray:
    """Characteristic polynomial, lowest power first, modulo each prime.

    The matrix is brought to Hessenberg form by similar row and column steps,
    for all primes at once; the form's leading blocks then give the polynomial
    by a recurrence.
    """
    size, count = len(matrix), len(primes)
    p = np.array(primes, np.int64)
    flat = [[value % prime for row in matrix for value in row] for prime in primes]
    h = np.array(flat, np.int64).reshape(count, size, size)
    each, one, two = np.arange(count), p[:, None], p[:, None, None]
    for k in range(size - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        for line in (h, h.transpose(0, 2, 1)):
            line[each, pivot], line[each, k + 1] = line[each, k + 1].copy(), line[each, pivot].copy()
        inverse = _powers(h[:, k + 1, k], p - 2, p)
        factor = h[:, k + 2 :, k] * inverse[:, None] % one
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, k + 1, None, :] % two) % two
        moved = (h[:, :, k + 2 :] * factor[:, None, :] % two).sum(axis=2)
        h[:, :, k + 1] = (h[:, :, k + 1] + moved) % one
    blocks = np.zeros((size + 1, count, size + 1), np.int64)
    blocks[0, :, 0] = 1
    for k in range(size):
        now = np.zeros((count, size + 1), np.int64)
        now[:, 1:] = blocks[k, :, :-1]
        now = (now - h[:, k, k, None] * blocks[k] % one) % one
        below = np.ones(count, np.int64)
        for i in range(k - 1, -1, -1):
            below = below * h[:, i + 1, i] % p
            now = (now - (h[:, i, k] * below % p)[:, None] * blocks[i] % one) % one
        blocks[k + 1] = now
    return blocks[size]


def chinese_remainders(residues: Sequence[Sequence[int]], primes: Sequence[int]) -> list[int]:
    """The numbers of least size with these residues: ``residues[k]`` are those
    modulo ``primes[k]``."""
    values, product = [0] * len(residues[0]), 1
    for row, prime in zip(residues, primes):
        inverse = pow(product, -1, prime)
        values = [v + product * ((int(r) - v) * inverse % prime) for v, r in zip(values, row)]
        product *= prime
    return [v - product if 2 * v > product else v for v in values]


def _roots_above(polynomial: Sequence[int], place: int) -> int:
    """Roots larger than ``place``, with multiplicity, of a polynomial whose
    roots are all real: the sign changes of its shifted coefficients."""
    shifted = list(polynomial)
    for k in range(len(shifted) - 1):
        for j in range(len(shifted) - 2, k - 1, -1):
            shifted[j] += place * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(polynomial: Sequence[int], place: int) -> int:
    total = 0
    for c in reversed(polynomial):
        total = total * place + c
    return total


def largest_roots(polynomial: Sequence[int], wanted: int, fraction_bits: int) -> list[tuple[int, int]]:
    """The largest positive roots, as (root * 2 ** fraction_bits rounded up,
    multiplicity), until ``wanted`` roots are listed or none is left.

    The polynomial, lowest power first, has leading coefficient 1 and real,
    non-negative roots only.  Each root is fenced in by counts of the roots
    above a place, exact by integer arithmetic, then halved down by the sign
    of the polynomial.  Roots that no multiple of 2 ** -fraction_bits parts are
    one root of higher multiplicity.
    """
    degree = len(polynomial) - 1
    scaled = [c << (fraction_bits * (degree - k)) for k, c in enumerate(polynomial)]
    top = -scaled[degree - 1] if degree else 0  # the sum of all roots
    counts = {0: _roots_above(scaled, 0), top: 0} if degree else {0: 0}
    found: list[tuple[int, int]] = []
    listed = 0
    while listed < min(wanted, counts[0]):
        # Counts never grow with the place: the next root lies between these.
        low = max(at for at, count in counts.items() if count > listed)
        high = min(at for at, count in counts.items() if count <= listed)
        while high - low > 1 and counts[low] - counts[high] > 1:
            middle = (low + high) // 2
            counts[middle] = _roots_above(scaled, middle)
            low, high = (middle, high) if counts[middle] > listed else (low, middle)
        multiplicity = counts[low] - counts[high]
        if multiplicity == 1:
            # All roots but ``listed`` lie at or below, so the sign above the root is known.
            above = 1 if listed % 2 == 0 else -1
            while high - low > 1:
                middle = (low + high) // 2
                if _value(scaled, middle) * above > 0:
                    high = middle
                else:
                    low = middle
        found.append((high, multiplicity))
        listed += multiplicity
    return found


def null_vectors(
    matrix: Sequence[Sequence[int]], root: int, multiplicity: int, fraction_bits: int
) -> np.ndarray:
    """Orthonormal vectors that span the null space of the matrix minus a root.

    Inverse iteration in fixed-point numbers: with the root known far beyond
    double precision, two steps leave next to nothing of other components.
    Each further vector of a multiple root is kept orthogonal to those before.
    """
    size = len(matrix)
    places = 2 * fraction_bits
    one = 1 << places
    shift = places - fraction_bits
    rows = [[value << places for value in row] for row in matrix]
    for k in range(size):
        rows[k][k] -= root << shift
    order = list(range(size))
    for k in range(size):
        best = max(range(k, size), key=lambda i: abs(rows[i][k]))
        rows[k], rows[best], order[k], order[best] = rows[best], rows[k], order[best], order[k]
        pivot = rows[k][k] = rows[k][k] or 1
        upper = rows[k]
        for i in range(k + 1, size):
            row = rows[i]
            if row[k]:
                factor = row[k] = (row[k] << places) // pivot
                for j in range(k + 1, size):
                    row[j] -= factor * upper[j] >> places

    def solved(right: list[int]) -> list[int]:
        x = [right[k] for k in order]
        for k in range(size):
            for j in range(k):
                x[k] -= rows[k][j] * x[j] >> places
        for k in range(size - 1, -1, -1):
            rest = x[k]
            for j in range(k + 1, size):
                rest -= rows[k][j] * x[j] >> places
            x[k] = (rest << places) // rows[k][k]
        return x

    def unit(x: list[int]) -> list[int]:
        length = isqrt(sum(v * v for v in x)) or 1
        return [(v << places) // length for v in x]

    found: list[list[int]] = []
    for start in range(size):
        if len(found) == multiplicity:
            break
        x = [one if k == start else one // (2 + k) for k in range(size)]
        for _ in range(3):
            for other in found:
                along = sum(a * b for a, b in zip(x, other)) >> places
                x = [a - (along * b >> places) for a, b in zip(x, other)]
            x = unit(solved(x))
        for other in found:
            along = sum(a * b for a, b in zip(x, other)) >> places
            x = [a - (along * b >> places) for a, b in zip(x, other)]
        if sum(v * v for v in x) >> (2 * places - 2):  # longer than a half: a new direction
            found.append(unit(x))
    vectors = np.array([[v / one for v in x] for x in found])
    largest = np.argmax(np.abs(vectors), axis=1)
    return vectors * np.sign(vectors[np.arange(len(found)), largest])[:, None]
