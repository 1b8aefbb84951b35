"""A full-text index of a sequence of small integers: suffix array, wavelet-tree ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the last symbol must be smaller than all others."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], text[order][1:] != text[order][:-1])))
    width = 1
    while rank[order[-1]] < n - 1:
        second = np.full(n, -1, np.int64)
        second[:-width] = rank[width:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        width *= 2
    return order


class WaveletTree:
    """Counts of a symbol before a position, one bit level after another (each level's zeros stand before its ones)."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(max(1, int(symbols.max()).bit_length()))):
            one = symbols >> bit & 1
            ones = np.concatenate((np.zeros(1, np.int64), np.cumsum(one)))
            self.levels.append((bit, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate((symbols[one == 0], symbols[one == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin = np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            up = symbol >> bit & 1 == 1
            begin, at = np.where(up, zeros + ones[begin], begin - ones[begin]), np.where(up, zeros + ones[at], at - ones[at])
        return at - begin


class FmIndex:
    def __init__(self, text: np.ndarray, step: int = 8):
        """text: symbols from 1 up; 0 is appended as the end."""
        text = np.append(text, 0)
        order = suffix_array(text)
        self.last = text[order - 1]
        self.tree = WaveletTree(self.last)
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(text))))
        self.sampled = np.where(order % step == 0, order, -1)

    def step_back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.tree.rank(symbol, at)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each pattern; patterns: rows of symbols, left-aligned."""
        n, alphabet = len(self.last), len(self.before) - 1
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
        for k in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > k) & (high > low))
            symbol = patterns[live, lengths[live] - 1 - k]
            known = symbol < alphabet
            high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self.step_back(symbol, low[live]), self.step_back(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to the next sampled one."""
        at, out, walked = at.copy(), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        while len(live):
            found = self.sampled[at[live]]
            done = found >= 0
            out[live[done]] = found[done] + walked[live[done]]
            live = live[~done]
            at[live] = self.step_back(self.last[at[live]], at[live])
            walked[live] += 1
        return out
