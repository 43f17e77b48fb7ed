"""Word shingles of a text as 64-bit numbers, and their MinHash and odd sketches.

Small numpy helpers that run inside tasks.
"""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 400_000
BLOCK = 2048  # shingles hashed at a time, which bounds memory for long texts

_U = np.uint64


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """Seeded odd multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, count, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (xor-shift-multiply rounds)."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Shingler:
    """Distinct hashed shingles of a text.

    A text with fewer words than a shingle counts as one shingle, a text
    without words as none.  A word's hash is cached, the cache is bounded.
    """

    def __init__(self, words: int = 5):
        self.words = words
        self.factors = odd_numbers(words, 5)
        self.cache: dict[bytes, int] = {}

    def word_hashes(self, text: str) -> np.ndarray:
        # Bytes are split at ASCII white space and only A-Z are lower-cased.
        found = text.encode("utf-8", "surrogatepass").lower().split()
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for word in set(found).difference(cache):
            cache[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        if not text:
            return np.empty(0, np.uint64)
        hashes = self.word_hashes(text)
        width = min(self.words, len(hashes))
        if not width:
            return np.empty(0, np.uint64)
        count = len(hashes) - width + 1
        total = np.full(count, width, np.uint64)
        for k in range(width):
            total += hashes[k : k + count] * self.factors[k]
        return np.unique(mix(total))


class MinHasher:
    """Band keys and an odd sketch of a set of hashes.

    Bands are made of classic MinHash samples.  The odd sketch folds a set into
    a parity bitmap: every hash flips one bit.  The bits in which two bitmaps
    differ tell how many hashes differ.  Of a set of more than ``bins`` hashes
    the samples of a one-permutation MinHash (the least hash in each of
    ``bins`` ranges) are folded.
    """

    def __init__(self, bands: int, rows: int, bins: int, bits: int, seed: int = 1):
        self.bands, self.rows, self.bits = bands, rows, bits
        self.factors = odd_numbers(bands * rows, seed)
        self.shifts = odd_numbers(bands * rows, seed + 1)
        self.row_factors = odd_numbers(rows, seed + 2)
        self.band_numbers = mix(np.arange(1, bands + 1, dtype=np.uint64))
        self.bins, self.bin_shift = bins, _U(64 - (bins.bit_length() - 1))

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), 2**64 - 1, np.uint64)
        for at in range(0, len(hashes), BLOCK):
            block = hashes[at : at + BLOCK, None] * self.factors + self.shifts
            block ^= block >> _U(29)
            np.minimum(least, block.min(axis=0), out=least)
        return least

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        rows = mix(self.samples(hashes).reshape(self.bands, self.rows)) * self.row_factors
        return mix(rows.sum(axis=1, dtype=np.uint64) + self.band_numbers).view(np.int64)

    def odd_sketch(self, hashes: np.ndarray) -> tuple[bytes, int]:
        """The bitmap and the number of samples in it.  ``hashes`` are sorted."""
        kept = hashes
        if len(hashes) > self.bins:
            bins = hashes >> self.bin_shift
            first = np.ones(len(hashes), bool)
            first[1:] = bins[1:] != bins[:-1]
            kept = hashes[first]
        flips = np.bincount((mix(kept) % _U(self.bits)).astype(np.int64), minlength=self.bits) & 1
        return np.packbits(flips.astype(np.uint8)).tobytes(), len(kept)


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which every sketch of ``a`` differs from every one of ``b``.

    Sketches are rows of 64-bit words.
    """
    differ = np.empty((len(a), len(b)), np.int64)
    for i in range(len(a)):
        differ[i] = np.bitwise_count(a[i] ^ b).sum(axis=1)
    return differ


def most_differing_bits(
    a: np.ndarray,
    a_samples: np.ndarray,
    b: np.ndarray,
    b_samples: np.ndarray,
    similarity: float,
    bins: int,
    bits: int,
    deviations: float,
) -> np.ndarray:
    """Most differing bits of the odd sketches of every set of ``a`` and every
    one of ``b`` whose Jaccard similarity is ``similarity`` or more.

    ``a`` and ``b`` are sizes of sets, with the numbers of their samples.  The
    expected number of shared samples, less ``deviations`` standard deviations
    of both errors, gives the bound.  Of two whole sets it is known.  Of a
    whole set and a sampled one it is that of a draw without replacement.  The
    samples of a range of two sampled sets agree if the least hash of the union
    is shared: a draw again, and the number of ranges in use varies.  The
    second error is that of samples meeting in a bit.
    """
    a, a_samples = a[:, None].astype(np.float64), a_samples[:, None].astype(np.float64)
    b, b_samples = b[None, :].astype(np.float64), b_samples[None, :].astype(np.float64)
    a_whole, b_whole = a == a_samples, b == b_samples
    union = (a + b) / (1 + similarity)
    shared = union * similarity
    if a_whole.all() and b_whole.all():
        apart, spread = union - shared, 0.0
    else:
        empty = np.exp(union * np.log1p(-1 / bins))
        used = bins * (1 - empty)
        both = ~a_whole & ~b_whole
        # Drawn from the sampled set, or from the union.
        drawn = np.where(both, used, np.where(a_whole, b_samples, a_samples))
        total = np.where(both, union, np.where(a_whole, b, a))
        rate = np.minimum(shared / total, 1)
        varied = similarity**2 * bins * empty * np.maximum(1 - (1 + union / bins) * empty, 0)
        spread = drawn * rate * (1 - rate) * (total - drawn) / np.maximum(total - 1, 1)
        spread = 4 * (spread + np.where(both, varied, 0))
        apart = np.maximum(a_samples + b_samples - 2 * drawn * rate, 0)
    left = np.exp(-2 * apart / bits)
    meeting = np.maximum(bits / 4 * (1 - left**2) - apart * left**2, 0)
    most = bits / 2 * (1 - left) + deviations * np.sqrt(meeting + spread * left**2) + 1
    # Samples that meet only lessen the differing bits.
    return np.where(a_whole & b_whole, np.minimum(most, apart + 0.5), most)
