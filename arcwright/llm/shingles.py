"""Word shingles as sorted 64-bit sets, and their one-permutation sketches."""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(33)
_MEMO = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _S)) * _M
    return x ^ (x >> _S)


class Hasher:
    """Shingle sets of texts, ``width`` words a shingle; words are lower-cased A-Z and split at the six ASCII spaces."""

    def __init__(self, width: int) -> None:
        rng = np.random.default_rng(20_240_501)
        self.width, self.words = width, {}
        self.factors = rng.integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        held = self.words
        if len(held) > _MEMO:
            held.clear()
        try:
            return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
        except KeyError:
            new = set(words).difference(held)
            held.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
            return np.fromiter(map(held.__getitem__, words), np.uint64, len(words))

    def set_of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h, n = self.hashes(words), len(words)
        if n < self.width:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
        x = np.zeros(n - self.width + 1, np.uint64)
        for k in range(self.width):
            x += h[k : n - self.width + 1 + k] * self.factors[k]
        x = np.sort(mixed(x))
        keep = np.empty(len(x), bool)
        keep[0] = True
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        return x[keep]


class Sketcher:
    """One-permutation sketches: a set's hashes are dealt to bins by their top bits, a bin keeps its least.

    Optimal densification: an empty bin copies the filled bin that comes first in a random order of its own.
    The orders are drawn once for all sets, so that bins filled alike copy alike.
    """

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        bits = (self.bins - 1).bit_length()
        if 1 << bits != self.bins:
            raise ValueError("bands * rows must be a power of two")
        rng = np.random.default_rng(20_240_502)
        self.edges = (np.arange(self.bins, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
        self.order = rng.random((self.bins, self.bins))
        self.factors = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def sketch(self, hashes: np.ndarray) -> np.ndarray:
        """Bin values of a sorted, non-empty set."""
        at = np.searchsorted(hashes, self.edges)
        full = np.append(at[1:], len(hashes)) > at
        out = hashes[np.minimum(at, len(hashes) - 1)]
        if not full.all():
            filled, empty = np.flatnonzero(full), np.flatnonzero(~full)
            out[empty] = out[filled[self.order[np.ix_(empty, filled)].argmin(1)]]
        return out

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key a band; a key names its band too."""
        rows = self.sketch(hashes).reshape(self.bands, self.rows)
        return mixed((mixed(rows) * self.factors).sum(1, dtype=np.uint64) + self.salts).view(np.int64)
