"""An FM-index over sequences of word numbers: wavelet bits, counts, and smallest owner by range.

The index is of all sequences joined; symbol 0 ends each and never matches. Rows of the suffix
order that begin with a pattern are one interval, found backwards, one symbol a step, by ranks in the
Burrows-Wheeler transform, which is held as bit vectors of a wavelet matrix with counts per 64 bits.
Every step takes a whole array of searches.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of any symbol in a sequence, from one bit vector per bit of the symbols."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.zeros, self.words, self.counts = [], [], []
        self.levels = max(1, int(symbols - 1).bit_length())
        rest, size = sequence, len(sequence)
        for level in range(self.levels - 1, -1, -1):
            bits = (rest >> level) & 1
            packed = np.zeros((size // 64 + 1) * 8, np.uint8)
            packed[:(size + 7) // 8] = np.packbits(bits.astype(np.uint8), bitorder="little")
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]].astype(np.int32))
            one = bits.astype(bool)
            self.zeros.append(int(size - one.sum()))
            rest = np.concatenate([rest[~one], rest[one]])
        self.starts = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            block = place >> 6
            ones = self.counts[i][block] + np.bitwise_count(self.words[i][block] & below)
            place = np.where((symbol >> level) & 1, self.zeros[i] + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._descend(symbol, place) - self.starts[symbol]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; symbol 0 counts as different at every place, so sequences end there."""
    ends = text == 0
    rank = np.where(ends, 0, text.astype(np.int64) + int(ends.sum()))
    rank[ends] = np.arange(int(ends.sum()))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    size, step = len(text), 1
    while True:
        following = np.zeros(size, np.int64)
        following[:size - step] = rank[step:] + 1
        key = rank * (size + 1) + following
        order = np.argsort(key)
        key = key[order]
        names = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        if names[-1] == size - 1 or step >= size:
            return order
        rank[order] = names
        step *= 2


class FMIndex:
    """Backward search over many sequences, with the smallest owner among a pattern's occurrences."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, symbols: int):
        order = suffix_order(text)
        self.size = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], symbols)  # before the first suffix stands the last symbol, an end
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols))[:-1]]
        lowest = owner[order].astype(np.int32)
        self.lowest = [lowest]
        width = 1
        while 2 * width <= self.size:
            lowest = np.minimum(lowest[:-width], lowest[width:])
            self.lowest.append(lowest)
            width *= 2

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol more in front."""
        ranks = self.wavelet.rank(np.r_[symbol, symbol], np.r_[low, high])
        base = self.before[symbol]
        return base + ranks[:len(symbol)], base + ranks[len(symbol):]

    def smallest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of non-empty intervals."""
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int32)
        for k in np.unique(level):
            at = level == k
            table = self.lowest[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(k))])
        return out

    def reach(self, text: np.ndarray, end: np.ndarray, least: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For each search the smallest start, not below ``least``, from which text[start:end] also
        occurs with a smaller owner; ``end`` itself if not even one symbol does."""
        start = end.copy()
        live = np.arange(len(end))
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.size, np.int64)
        while len(live):
            symbol = text[start[live] - 1]
            low, high = self.extend(symbol, low, high)
            found = (high > low) & (symbol > 0)
            found[found] = self.smallest_owner(low[found], high[found]) < owner[live[found]]
            live, low, high = live[found], low[found], high[found]
            start[live] -= 1
            more = start[live] > least[live]
            live, low, high = live[more], low[more], high[more]
        return start
