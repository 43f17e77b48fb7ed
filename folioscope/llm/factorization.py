"""A small factorization machine over sparse binary terms, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Machine:
    """Non-zero terms, their weights and factors."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, terms: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        """Probability of each of ``count`` rows; ``rows`` tells whose a term is.

        The sum over all pairs of terms is half of (sum of factors) squared
        minus the sum of squared factors.
        """
        total = np.full(count, self.bias)
        if len(self.terms) and len(terms):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            hit = self.terms[at] == terms
            at, rows = at[hit], rows[hit]
            total += np.bincount(rows, self.weights[at], count)
            for f in self.factors.T:
                total += (np.bincount(rows, f[at], count) ** 2 - np.bincount(rows, f[at] ** 2, count)) / 2
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _screened(flat: np.ndarray, rows: np.ndarray, pull: np.ndarray, least: float) -> np.ndarray:
    """Terms whose slope at the start, the sum of ``pull`` over their rows, is
    not lost in noise."""
    vocabulary, place = np.unique(flat, return_inverse=True)
    slope = np.bincount(place, pull[rows], len(vocabulary))
    return vocabulary[np.abs(slope) >= least]


def fit(
    documents: list[np.ndarray],
    labels: np.ndarray,
    *,
    factors: int = 4,
    steps: int = 250,
    rate: float = 0.03,
    strictness: float = 0.8,
    seed: int = 7,
) -> Machine:
    """Logistic loss, classes weighed alike, adaptive steps over all rows.

    The slope of a term without effect is noise of about 1 / sqrt(rows).
    Terms with less than three quarters of ``strictness`` times that at the start are
    left out.  After each step weights and factors move towards zero by as
    much as such noise would move them, so terms without effect stay at zero.
    """
    count = len(labels)
    positives = float(labels.sum())
    if positives in (0.0, float(count)):
        bias = 0.0 if not count else (40.0 if positives else -40.0)
        return Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, factors)))
    weigh = np.where(labels > 0, 0.5 / positives, 0.5 / (count - positives))
    flat = np.concatenate(documents)
    rows = np.repeat(np.arange(count), [len(d) for d in documents])
    noise = strictness / np.sqrt(count)
    vocabulary = _screened(flat, rows, (0.5 - labels) * weigh, 0.75 * noise)
    if not len(vocabulary):
        return Machine(vocabulary, 0.0, np.empty(0), np.empty((0, factors)))
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
    hit = vocabulary[at] == flat
    at, rows = at[hit], rows[hit]

    machine = _descend(vocabulary, at, rows, labels, weigh, factors, steps, rate, noise / 4, seed)
    # Once more on the terms that stayed, hardly held back.
    kept = np.isin(vocabulary, machine.terms)
    hit = kept[at]
    at, rows = (np.cumsum(kept) - 1)[at[hit]], rows[hit]
    return _descend(vocabulary[kept], at, rows, labels, weigh, factors, steps, rate, noise / 40, seed)


def _descend(
    vocabulary: np.ndarray,
    at: np.ndarray,
    rows: np.ndarray,
    labels: np.ndarray,
    weigh: np.ndarray,
    factors: int,
    steps: int,
    rate: float,
    shrink: float,
    seed: int,
) -> Machine:
    """``at`` is a term's place in the vocabulary, ``rows`` the row that has it."""
    size, count = len(vocabulary), len(labels)
    bias, bias_sum = 0.0, 1e-8
    w, w_sum = np.zeros(size), np.full(size, 1e-8)
    v = np.random.default_rng(seed).normal(0, 0.1, (size, factors))
    v_sum = np.full((size, factors), 1e-8)

    def stepped(value, total, slope):
        total *= 0.9
        total += 0.1 * slope**2
        pace = rate / np.sqrt(total)
        moved = value - pace * slope
        return np.sign(moved) * np.maximum(np.abs(moved) - pace * shrink, 0)

    for _ in range(steps):
        sums = np.stack([np.bincount(rows, v[at, f], count) for f in range(factors)], axis=1)
        squares = np.bincount(rows, (v[at] ** 2).sum(axis=1), count)
        raw = bias + np.bincount(rows, w[at], count) + ((sums**2).sum(axis=1) - squares) / 2
        error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels) * weigh
        pulls = error[rows]
        w_slope = np.bincount(at, pulls, size)
        v_slope = np.stack(
            [np.bincount(at, pulls * (sums[rows, f] - v[at, f]), size) for f in range(factors)], axis=1
        )
        bias_sum = 0.9 * bias_sum + 0.1 * error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(bias_sum)
        w, v = stepped(w, w_sum, w_slope), stepped(v, v_sum, v_slope)
    alive = (w != 0) | (v != 0).any(axis=1)
    return Machine(vocabulary[alive], float(bias), w[alive], v[alive])
