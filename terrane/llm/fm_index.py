"""A compressed index of word sequences: the Burrows-Wheeler transform in a wavelet matrix of packed bits.

Backward search over the matrix gives the matching statistics of streamed sequences: how many of the words before each
place, at most ``depth``, occur in a row in the index. Suffixes are sorted as deep as that and no suffix array is kept:
rows that begin with the same ``depth`` words stand together, ordered by owner, so a bit vector marks where such a run
begins and one number a run tells its smallest owner.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([np.zeros(1, np.int32), np.cumsum(ones[:-1], dtype=np.int32)])
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class WaveletMatrix:
    """Symbols 0 .. size - 1 as one bit vector for each of their bits, highest first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[Bits] = []
        self.depth = max(1, int(size - 1).bit_length())
        # Where each symbol's places begin once all levels have parted them.
        starts, every = np.zeros(size, np.int64), np.arange(size)
        for shift in range(self.depth - 1, -1, -1):
            bits = (symbols >> shift) & 1
            level = Bits(bits.astype(np.uint8))
            self.levels.append(level)
            ones = level.ones(starts)
            starts = np.where((every >> shift) & 1, level.zeros + ones, starts - ones)
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.starts = starts.astype(np.int32)

    def ranks(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs among the first ``low`` and the first ``high`` ones."""
        both = np.concatenate([low, high])
        twice = np.concatenate([symbols, symbols])
        for level, bits in enumerate(self.levels):
            ones = bits.ones(both)
            both = np.where((twice >> (self.depth - 1 - level)) & 1, bits.zeros + ones, both - ones)
        start = self.starts[symbols]
        return both[: len(low)] - start, both[len(low) :] - start


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys; equal keys share one."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
    return rank


class Names:
    """Numbers from 1 for words, told apart by two hashes; 0 for words that are not among them."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.known, at = np.unique(first, return_index=True)
        self.second = second[at]
        # Words that share the first hash are named by the second one.
        odd = self.second[np.searchsorted(self.known, first)] != second if len(first) else np.zeros(0, bool)
        self.odd = {pair: len(self.known) + 1 + k for k, pair in enumerate(dict.fromkeys(zip(first[odd].tolist(), second[odd].tolist(), strict=True)))}

    def __len__(self) -> int:
        return len(self.known) + len(self.odd)

    def of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(first), np.int32)
        at = np.minimum(np.searchsorted(self.known, first), len(self.known) - 1)
        found = np.where((self.known[at] == first) & (self.second[at] == second), at + 1, 0).astype(np.int32)
        if self.odd:
            for k in np.flatnonzero(found == 0).tolist():
                found[k] = self.odd.get((int(first[k]), int(second[k])), 0)
        return found


class FmIndex:
    """Index of sequences of words, each followed by an end mark, for runs of up to ``depth`` words.

    words: two hashes of every word; offsets: those of the sequences in words; owners: one of each sequence.
    """

    def __init__(self, words: tuple[np.ndarray, np.ndarray], offsets: np.ndarray, owners: np.ndarray, depth: int = 13):
        counts = np.diff(offsets)
        n = len(words[0]) + len(counts)
        self.depth, self.rows, self.names = depth, n, Names(*words)
        size = len(self.names) + 1
        text, inside = np.zeros(n, np.int32), np.ones(n, bool)
        inside[offsets[1:] + np.arange(len(counts))] = False
        text[inside] = self.names.of(*words)
        rank, length = _dense(text), 1
        while length < depth:
            step = min(length, depth - length)
            rank, length = _dense(rank * (n + 1) + np.roll(rank, -step)), length + step
        self.owners, whose = np.unique(owners, return_inverse=True)
        whose = np.repeat(whose.astype(np.int32), counts + 1)
        order = np.lexsort((whose, rank))
        heads = np.append(True, rank[order[1:]] != rank[order[:-1]])[:n]
        self.matrix = WaveletMatrix(text[order - 1], size)
        self.heads, self.least = Bits(heads), whose[order[np.flatnonzero(heads)]]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    @property
    def nbytes(self) -> int:
        parts = (self.heads, self.least, self.first, self.owners, self.names.known, self.names.second, self.matrix.starts, *self.matrix.levels)
        return sum(p.nbytes for p in parts)

    def statistics(self, words: tuple[np.ndarray, np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the place after every word of streamed sequences its matching statistic, at most ``depth``, and the first
        row of the suffixes that begin with the words that match."""
        symbols = self.names.of(*words)
        inside = np.arange(len(symbols)) - np.repeat(offsets[:-1], np.diff(offsets))
        length, row = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int64)
        live = np.flatnonzero(symbols > 0)
        low, high = self.first[symbols[live]], self.first[symbols[live] + 1]
        for step in range(1, self.depth + 1):
            length[live], row[live] = step, low
            if step == self.depth:
                break
            on = inside[live] >= step
            symbol = symbols[live - step * on] * on
            on &= symbol > 0
            live, low, high, symbol = live[on], low[on], high[on], symbol[on]
            low, high = self.matrix.ranks(symbol, low, high)
            found = high > low
            start = self.first[symbol[found]]
            live, low, high = live[found], low[found] + start, high[found] + start
        return length, row

    def least_owner(self, rows: np.ndarray) -> np.ndarray:
        """The smallest owner of the runs of ``depth`` words whose suffixes begin at the given rows."""
        return self.owners[self.least[self.heads.ones(rows + 1) - 1]]

    def covered(self, words: tuple[np.ndarray, np.ndarray], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places (words from the start of the stream) where runs of ``depth`` words that occur in the index end, and
        the smallest owner of each."""
        length, row = self.statistics(words, offsets)
        ends = np.flatnonzero(length >= self.depth)
        return ends, self.least_owner(row[ends])
