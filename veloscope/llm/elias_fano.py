"""Elias-Fano sequences over numpy: compact monotone integers with vectorised access and search.

n non-decreasing integers below a universe u are kept as low bytes (whole bytes, so that they are plain array
columns) and high parts in unary: the i-th one bit stands at high_i + i, and the j-th zero ends bucket j.
``access`` is a select of ones through a directory of counts per 64-bit word; a batch of look-ups decodes the bucket ends
and low parts once. All parts are flat buffers, so a sequence can live in a memory-mapped file.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (0-based) one bit of each word; the bit exists."""
    x, r, pos = x.copy(), r.astype(np.int64), np.zeros(len(x), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        c = np.bitwise_count(x & _U((1 << s) - 1)).astype(np.int64)
        go = r >= c
        r -= np.where(go, c, 0)
        x = np.where(go, x >> _U(s), x)
        pos += np.where(go, s, 0)
    return pos


class EliasFano:
    """``n``, ``k`` low bytes, ``low`` (n, k) bytes, ``words`` of the unary part, ``ones`` before each word."""

    def __init__(self, n: int, k: int, low: np.ndarray, words: np.ndarray):
        self.n, self.k, self.low, self.words = n, k, low, words
        count = np.bitwise_count(words).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(count)))
        self._ends = self._lows = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.ascontiguousarray(values, "<u8")
        n = len(values)
        spread = np.log2(max(universe, 2) / max(n, 1))
        k = min(range(8), key=lambda k: 8 * k + 1 + 2.0 ** max(spread - 8 * k, -60))
        low = values.view(np.uint8).reshape(n, 8)[:, :k].copy()
        high = (values >> _U(8 * k)).astype(np.int64)
        size = (int(high[-1]) if n else 0) + n + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        return cls(n, k, low, np.packbits(bits, bitorder="little").view("<u8"))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.k, len(self.words)], "<i8").tobytes() + self.words.tobytes() + self.low.tobytes()

    @classmethod
    def from_buffer(cls, buf, at: int = 0) -> EliasFano:
        n, k, w = np.frombuffer(buf, "<i8", 3, at).tolist()
        words = np.frombuffer(buf, "<u8", w, at + 24)
        low = np.frombuffer(buf, np.uint8, n * k, at + 24 + 8 * w).reshape(n, k)
        return cls(n, k, low, words)

    def n_bytes(self) -> int:
        return 24 + 8 * len(self.words) + self.n * self.k

    def _select(self, before: np.ndarray, words, j: np.ndarray) -> np.ndarray:
        w = np.searchsorted(before, j, "right") - 1
        return w * 64 + select_in_word(words(w), j - before[w])

    def low_of(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), np.uint8)
        out[:, :self.k] = self.low[i]
        return out.view("<u8").ravel()

    def lows(self) -> np.ndarray:
        """All low parts, decoded once for many look-ups."""
        if self._lows is None:
            wide = np.uint32 if self.k <= 4 else np.uint64
            out = np.zeros((self.n, wide().nbytes), np.uint8)
            out[:, :self.k] = self.low
            self._lows = out.view(wide).ravel()
        return self._lows

    def access(self, i: np.ndarray) -> np.ndarray:
        high = self._select(self.ones, lambda w: self.words[w], i) - i
        return (high.astype(np.uint64) << _U(8 * self.k)) | self.low_of(i)

    def ends(self) -> np.ndarray:
        """End of each bucket, decoded once for many look-ups: the j-th zero stands at (elements up to j) + j."""
        if self._ends is None:
            zeros = np.flatnonzero(np.unpackbits(np.ascontiguousarray(~self.words).view(np.uint8), bitorder="little"))
            zeros -= np.arange(len(zeros))
            self._ends = np.minimum(zeros, self.n).astype(np.int32)
        return self._ends

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[first, end) of the elements with this high part."""
        ends = self.ends()
        inside = high < len(ends)                  # parts above hold nothing
        h = np.where(inside, high, 0)
        end = np.where(inside, ends[h], 0)
        return np.where(inside & (high > 0), ends[h - 1], 0), end

    def find(self, values: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, or -1; ``first``/``end`` bound the search (a context's successors)."""
        values = np.ascontiguousarray(values, np.uint64)
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        lo, hi = self.bucket((values >> _U(8 * self.k)).astype(np.int64))
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, end)
        at = np.flatnonzero(lo < hi)
        low = self.lows()
        lo, hi, want = lo[at], hi[at], (values[at] & _U((1 << 8 * self.k) - 1)).astype(low.dtype)
        open_ = np.flatnonzero(hi - lo > 1)
        while len(open_):                          # successor search by halving, on the low bytes
            a, z = lo[open_], hi[open_]
            mid = (a + z) >> 1
            more = low[mid] <= want[open_]
            lo[open_], hi[open_] = np.where(more, mid, a), np.where(more, z, mid)
            open_ = open_[hi[open_] - lo[open_] > 1]
        ok = low[lo] == want
        out[at[ok]] = lo[ok]
        return out

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.words).view(np.uint8), bitorder="little"))
        return ((ones - np.arange(self.n)).astype(np.uint64) << _U(8 * self.k)) | self.low_of(np.arange(self.n))
