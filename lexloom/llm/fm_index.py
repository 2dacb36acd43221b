"""A compact full-text index over integer words: suffix array, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with a running count per 64-bit word, so that rank costs two look-ups."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits in front of each position."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbols by bit planes, most significant first; each plane keeps zeros in front of ones."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.planes: list[tuple[int, BitVector, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bits = (symbols >> level) & 1
            v = BitVector(bits)
            self.planes.append((level, v, len(symbols) - v.ones))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where a position ends when it follows a symbol's bits (its rank, behind the symbol's start)."""
        for level, v, zeros in self.planes:
            ones = v.rank(i)
            i = np.where((symbol >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and where its own descent ends."""
        symbol = np.zeros(len(i), np.int64)
        for level, v, zeros in self.planes:
            bit, ones = v.get(i).astype(np.int64), v.rank(i)
            symbol |= bit << level
            i = np.where(bit == 1, zeros + ones, i - ones)
        return symbol, i


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling. Zeros are separators: each counts as a symbol of its own, in order of place."""
    n, zero = len(seq), seq == 0
    rank = seq.astype(np.int64) + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    k = 1
    while True:
        key = rank * (n + int(zero.sum()) + int(seq.max(initial=0)) + 2)
        key[:-k or None] += np.concatenate([rank[k:] + 1]) if k < n else 0
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = step
        k *= 2
        if n == 0 or step[-1] == n - 1 or k >= n:
            return order


class FMIndex:
    """Index of one shard: runs of words (ids from 1) that a 0 ends; a run's start is always a sampled position."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        self.n, self.top = len(seq), int(seq.max(initial=0))
        order = suffix_array(seq)
        self.bwt = WaveletMatrix(seq[order - 1].astype(np.int64), self.top)
        counts = np.bincount(seq, minlength=self.top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])[: self.top + 1]
        self.start = self.bwt.descend(np.arange(self.top + 1), np.zeros(self.top + 1, np.int64))
        ends = np.flatnonzero(seq == 0)
        run = np.searchsorted(ends, np.arange(self.n))
        begin = np.concatenate([[0], ends[:-1] + 1])[run] if len(ends) else np.zeros(self.n, np.int64)
        kept = ((np.arange(self.n) - begin) % sample == 0)[order]
        self.marks, self.places = BitVector(kept), order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long phrases (one per line, all ids at least 1): backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j]
            known = c <= self.top
            c = np.where(known, c, 0)
            lo, hi = (self.first[c] + self.bwt.descend(c, x) - self.start[c] for x in (lo, hi))
            hi = np.where(known, np.maximum(lo, hi), lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back until a sampled one, then add the steps."""
        found, steps, left = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            at = self.marks.get(rows) == 1
            found[left[at]] = self.places[self.marks.rank(rows[at])] + steps[at]
            left, rows, steps = left[~at], rows[~at], steps[~at] + 1
            if len(left):
                c, end = self.bwt.access(rows)
                rows = self.first[c] + end - self.start[c]
        return found
