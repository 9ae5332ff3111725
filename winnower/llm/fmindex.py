"""An FM-index over a sequence of integers, in numpy; all searches are for many patterns at once."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorts the suffixes by prefix doubling; text ends with a symbol that is smaller than all others and occurs once."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[False, sorted_key[1:] != sorted_key[:-1]])
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return np.argsort(rank, kind="stable")


class WaveletTree:
    """Ranks and symbols of a sequence: a level for each bit, from the highest, with zeros moved before ones."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.bits = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.ones, self.zeros = [], []
        row = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(row) - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, end = np.zeros_like(end), end.copy()
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            ones, zeros = self.ones[level], self.zeros[level]
            low = np.where(one, zeros + ones[low], low - ones[low])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(at), at.copy()
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ones[at + 1] > ones[at]
            out = out << 1 | one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    def __init__(self, text: np.ndarray) -> None:
        """text: positive integers; a closing 0 is added."""
        text = np.append(np.asarray(text, np.int64), 0)
        order = suffix_array(text)
        last = text[order - 1]
        self.tree = WaveletTree(last)
        self.before = np.r_[0, np.cumsum(np.bincount(text))]
        marked = order % SAMPLE == 0
        self.mark = np.r_[0, np.cumsum(marked)]
        self.places = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of patterns of one length: for each, the first and the end of the suffixes that begin with it."""
        first = np.zeros(len(patterns), np.int64)
        end = np.full(len(patterns), self.before[-1], np.int64)
        for symbol in patterns.T[::-1]:
            known = symbol < len(self.before) - 1
            symbol = np.where(known, symbol, 0)
            first = np.where(known, self.before[symbol] + self.tree.rank(symbol, first), 0)
            end = np.where(known, self.before[symbol] + self.tree.rank(symbol, end), 0)
        return first, np.maximum(first, end)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes, by steps back to the nearest sampled one."""
        rows, out = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            here = rows[todo]
            found = self.mark[here + 1] > self.mark[here]
            out[todo[found]] = self.places[self.mark[here[found]]] + steps
            todo, here, steps = todo[~found], here[~found], steps + 1
            symbol = self.tree.symbol(here)
            rows[todo] = self.before[symbol] + self.tree.rank(symbol, here)
        return out
