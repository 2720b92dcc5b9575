"""A compressed FM-index over integer sequences, in numpy: k-limited BWT on a wavelet matrix.

Suffixes are sorted on their first `depth` symbols, which is what backward search for patterns of up
to that length needs. The BWT is stored as one bit vector a level, 64 positions a word, with a
cumulative count a word. Queries are vectorised: many patterns take each step of their search together.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.int32)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)


class FMIndex:
    """Index over text, symbols from 1; 0 separates sequences and is never searched."""

    def __init__(self, text: np.ndarray, depth: int):
        n, self.depth = len(text), depth
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        done = 1
        while done < depth:
            after = np.zeros(n, np.int64)
            if done < n:
                after[: n - done] = rank[done:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
            done *= 2
        self.order = np.argsort(rank, kind="stable").astype(np.int32)
        bwt = text[self.order - 1].astype(np.int64)  # the text ends with a separator, which so precedes its start
        size = int(text.max()) + 1 if n else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in reversed(range(max(1, int(size - 1).bit_length()))):
            bits = ((bwt >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, BitVector(bits), int(n - bits.sum())))
            bwt = np.concatenate([bwt[bits == 0], bwt[bits == 1]])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns -> those of the patterns with one more symbol in front."""
        a, b, start = lo, hi, np.zeros_like(lo)
        for shift, vector, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a1, b1, s1 = vector.ones(a), vector.ones(b), vector.ones(start)
            a, b, start = np.where(one, zeros + a1, a - a1), np.where(one, zeros + b1, b - b1), np.where(one, zeros + s1, start - s1)
        at = self.first[symbol] - start
        return at + a, at + b

    def search(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns text[start : start + length]; one that has become unique stops there.

        The patterns are taken from streamed sequences, so each of them occurs at least once where its
        own sequence is in the index: a range of one is final.
        """
        s = text[starts + length - 1].astype(np.int64)
        lo, hi = self.first[s], self.first[s + 1]
        live = np.flatnonzero(hi - lo > 1)
        for k in range(length - 2, -1, -1):
            if not len(live):
                break
            lo[live], hi[live] = self.step(text[starts[live] + k].astype(np.int64), lo[live], hi[live])
            live = live[hi[live] - lo[live] > 1]
        return lo, hi

    def matching(self, text: np.ndarray, threshold: int) -> np.ndarray:
        """Matching statistics at a threshold: for each start, how many places in the index its next `threshold` symbols have."""
        starts = np.arange(max(0, len(text) - threshold + 1))
        s = text[starts + threshold - 1].astype(np.int64)
        known = (s > 0) & (s < len(self.first) - 1)
        lo, hi = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        lo[known], hi[known] = self.first[s[known]], self.first[s[known] + 1]
        live = np.flatnonzero(hi > lo)
        for k in range(threshold - 2, -1, -1):
            s = text[starts[live] + k].astype(np.int64)
            bad = (s <= 0) | (s >= len(self.first) - 1)
            hi[live[bad]] = lo[live[bad]]
            live = live[~bad]
            lo[live], hi[live] = self.step(text[starts[live] + k].astype(np.int64), lo[live], hi[live])
            live = live[hi[live] > lo[live]]
        return hi - lo
