"""FM-index over a sequence of small whole numbers, with numpy.

The Burrows-Wheeler transform is held in a wavelet matrix of packed bits, so the occurrences
of a symbol before a row are counted with one lookup a level. Suffix positions are kept for
every ``step``-th place; other rows walk back until they meet one. All searches of a call run
together, array by array.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.n = n

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class Wavelet:
    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            one = (seq >> shift) & 1 == 1
            self.levels.append((shift, Bits(one), len(seq) - int(one.sum())))
            seq = np.concatenate([seq[~one], seq[one]])
        self.origin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``i``."""
        return self._down(symbol, i) - self.origin[symbol]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i``, and how often it stands before."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.ones(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.origin[symbol]


def suffix_array(seq: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes in order: packed first symbols, then doubling on those still tied."""
    n = len(seq)
    bits = max(1, symbols.bit_length())
    reach = 63 // bits
    key = np.zeros(n, np.int64)
    for j in range(reach):
        key <<= bits
        key[: n - j] |= seq[j:].astype(np.int64) + 1 if j < n else 0
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n, np.int64)

    def starts(new: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, places, 0))

    def tied(new: np.ndarray) -> np.ndarray:
        """Of rows in groups: those whose group has others."""
        last = np.append(new[1:], True)
        return ~(new & last)

    places = np.arange(n)
    new = np.append(True, key[1:] != key[:-1]) if n else np.zeros(0, bool)
    rank[order] = starts(new, places)
    rows = places[tied(new)]
    while len(rows):
        suffix = order[rows]
        later = suffix + reach
        second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        key = rank[suffix] << 32 | second
        within = np.argsort(key)
        suffix, key = suffix[within], key[within]
        order[rows] = suffix
        new = np.append(True, key[1:] != key[:-1])
        rank[suffix] = starts(new, rows)
        rows = rows[tied(new)]
        reach *= 2
    return order


class FMIndex:
    """Over ``seq``, whose symbols are 1 to ``symbols`` - 1; fewer than 2**31 of them."""

    def __init__(self, seq: np.ndarray, symbols: int, step: int = 16):
        seq = np.append(seq, 0)  # an end that sorts first
        order = suffix_array(seq, symbols)
        self.rows = len(seq)
        self.wavelet = Wavelet(seq[order - 1].astype(np.int64), symbols)
        self.below = np.append(0, np.cumsum(np.bincount(seq, minlength=symbols)))
        kept = order % step == 0
        self.sampled, self.samples = Bits(kept), order[kept].astype(np.int32)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows from lo to hi start with the phrase. phrases: one a row,
        padded on the right."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.rows)
        for k in range(phrases.shape[1]):
            live = np.flatnonzero((k < lengths) & (lo < hi))
            symbol = phrases[live, lengths[live] - 1 - k]
            for end in (lo, hi):
                end[live] = self.below[symbol] + self.wavelet.rank(symbol, end[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence where the rows' suffixes start."""
        at, walked = np.empty(len(rows), np.int64), 0
        who, row = np.arange(len(rows)), rows
        while len(who):
            here = self.sampled.get(row)
            at[who[here]] = self.samples[self.sampled.ones(row[here])] + walked
            who, row = who[~here], row[~here]
            symbol, before = self.wavelet.at(row)
            row, walked = self.below[symbol] + before, walked + 1
        return at
