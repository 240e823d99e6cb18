"""A compressed full-text index over integer sequences, for one shard.

``FMIndex`` holds the Burrows-Wheeler transform of a shard's pieces as a
wavelet matrix of packed bit vectors. Backward search narrows the rows of all
patterns of a set at once, a symbol at a time, with two ranks a level;
positions come from a sample of the suffix array.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words with a count before each word: constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)
        self.ones = int(counts.sum())

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access over a sequence with symbols below ``sigma``."""

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        now = sequence
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            self.bits.append(BitVector(bit))
            self.zeros.append(len(now) - self.bits[-1].ones)
            now = np.concatenate([now[~bit], now[bit]])
        symbols = np.arange(sigma, dtype=np.int64)
        self.origin = self._follow(symbols, [np.zeros(sigma, np.int64)])[0]

    def rank(self, symbols: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """How many of each symbol stand before each of its positions."""
        origin = self.origin[symbols]
        return [x - origin for x in self._follow(symbols, list(positions))]

    def _follow(self, symbols: np.ndarray, at: list[np.ndarray]) -> list[np.ndarray]:
        """Where each position leads on the symbol's way through the levels."""
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbols >> (self.levels - 1 - k)) & 1 == 1
            for j, x in enumerate(at):
                r = bits.rank1(x)
                at[j] = np.where(one, zeros + r, x - r)
        return at

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one = bits.get(at).astype(bool)
            r = bits.rank1(at)
            out = (out << 1) | one
            at = np.where(one, zeros + r, at - r)
        return out


def suffix_order(sequence: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling.

    ``ends`` are the positions of the separators; each counts as a symbol of
    its own, smaller than all others, so that the order is strict and the
    number of rounds is the logarithm of the longest piece.
    """
    n = len(sequence)
    key = sequence.astype(np.int64) + len(ends)
    key[ends] = np.arange(len(ends))
    order = np.argsort(key)
    step = 1
    while True:
        sorted_key = key[order]
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n:
            return order
        follow = np.zeros(n, np.int64)
        follow[:-step] = rank[step:]
        key = rank * (n + 1) + follow
        order = np.argsort(key)
        step *= 2


class FMIndex:
    """Index of pieces over symbols 1 to sigma - 1; 0 ends each piece.

    ``sequence`` is the pieces one after another, each with its closing 0.
    Patterns never contain 0, so no match crosses pieces.
    """

    SAMPLE = 8

    def __init__(self, sequence: np.ndarray, sigma: int) -> None:
        self.n, self.sigma = len(sequence), sigma
        ends = np.flatnonzero(sequence == 0)
        order = suffix_order(sequence, ends)
        self.order = order
        bwt = sequence[order - 1]
        self.wavelet = WaveletMatrix(bwt, sigma)
        self.counts = np.bincount(sequence, minlength=sigma)
        self.first = np.cumsum(self.counts) - self.counts
        starts = np.zeros(self.n, bool)
        starts[0] = True
        starts[ends[:-1] + 1] = True
        sampled = (order % self.SAMPLE == 0) | starts[order]
        self.sampled = BitVector(sampled)
        self.samples = order[sampled].astype(np.int32 if self.n < 2**31 else np.int64)

    def compact(self) -> "FMIndex":
        """Without the whole suffix array: only the sample stays."""
        self.order = None
        return self

    def step(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of symbol + pattern from the rows of each pattern."""
        below, above = self.wavelet.rank(symbols, lo, hi)
        start = self.first[symbols]
        return start + below, start + above

    def search(self, symbols: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows lo to hi of each pattern: ``lengths`` of the symbols from ``at``."""
        last = symbols[at + lengths - 1]
        lo, hi = self.first[last], self.first[last] + self.counts[last]
        for k in range(2, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((hi > lo) & (lengths >= k))
            if len(live):
                lo[live], hi[live] = self.step(symbols[at[live] + lengths[live] - k], lo[live], hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each row, by stepping back to a sampled one."""
        at = rows.astype(np.int64).copy()
        out = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        steps = 0
        while len(open_):
            hit = self.sampled.get(at[open_]).astype(bool)
            done = open_[hit]
            out[done] = self.samples[self.sampled.rank1(at[done])] + steps
            open_ = open_[~hit]
            if len(open_):
                symbols = self.wavelet.access(at[open_])
                at[open_] = self.first[symbols] + self.wavelet.rank(symbols, at[open_])[0]
                steps += 1
        return out
