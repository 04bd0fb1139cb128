"""A full-text index of a sequence of small numbers: Burrows-Wheeler transform, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Start positions in the order of their suffixes; every 0 is a symbol of its own, in text order.

    Prefix doubling: ranks by 1, 2, 4, ... symbols until all differ. Suffixes end at a 0, so the
    rounds grow with the logarithm of the longest repeated run between zeros.
    """
    n = len(s)
    zero = s == 0
    key = np.where(zero, np.cumsum(zero) - 1, s + int(zero.sum())).astype(np.int64)
    width = 1
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else ordered
        if not n or rank[order[-1]] == n - 1:
            return order
        following = np.zeros(n, np.int64)
        following[:-width] = rank[width:] + 1
        key = rank * (n + 1) + following
        width *= 2


class Wavelet:
    """Ranks of any symbol in a sequence, one bit of the symbols a level (wavelet matrix)."""

    def __init__(self, s: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        start = np.arange(1 << self.bits)
        # Where a symbol's run begins on the lowest level.
        self.first = self._down(start, np.zeros(len(start), np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            r = ones[i]
            i = np.where((symbol >> level) & 1, zeros + r, i - r)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols equal `symbol`, for arrays of both."""
        return self._down(symbol, i) - self.first[symbol]


class FmIndex:
    """Finds phrases in a sequence over 1..top; 0 separates parts and is in no phrase."""

    EVERY = 16

    def __init__(self, s: np.ndarray, top: int):
        s = np.asarray(s, np.int64)
        order = suffix_order(s)
        before = s[order - 1] if len(s) else s
        if len(s):
            before = np.where(order == 0, 0, before)
        self.before = before
        self.ranks = Wavelet(before, top)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top + 1))])
        # Walks back end at sampled positions: every 16th, and every one after a separator.
        self.sample = np.where((order % self.EVERY == 0) | (before == 0), order, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each phrase (rows padded to the right)."""
        n = len(self.before)
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), n, np.int64)
        live = np.arange(len(phrases))
        for back in range(phrases.shape[1] if len(phrases) else 0):
            at = lengths[live] - 1 - back
            live, at = live[at >= 0], at[at >= 0]
            symbol = phrases[live, at]
            low[live] = self.start[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.start[symbol] + self.ranks.rank(symbol, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to sampled ones."""
        out, steps = np.empty(len(rows), np.int64), 0
        live, at = np.arange(len(rows)), np.asarray(rows, np.int64)
        while len(live):
            known = self.sample[at]
            done = known >= 0
            out[live[done]] = known[done] + steps
            live, at = live[~done], at[~done]
            symbol = self.before[at]
            at = self.start[symbol] + self.ranks.rank(symbol, at)
            steps += 1
        return out
