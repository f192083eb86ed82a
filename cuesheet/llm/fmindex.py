"""An FM-index over word sequences: a wavelet matrix of the Burrows-Wheeler transform, searched backwards.

Suffixes are sorted by their first 64 words, which is enough for windows of at most ``MOST`` words.  Many
queries are searched in step, one numpy operation for all of them.
"""

from __future__ import annotations

import numpy as np

MOST = 63


class Wavelet:
    """Ranks of symbols in a sequence: one bit vector per bit of a symbol, each a stable split by that bit."""

    def __init__(self, values: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(64 + -len(bit) % 64, bit.dtype)).astype(np.uint8), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])))
            self.zeros.append(len(bit) - int(bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefixes of length ``at`` end in the fully split order, on the side of the symbol."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            one = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & below)
            at = np.where((symbols >> level) & 1, self.zeros[k] + one, at - one)
        return at


class FMIndex:
    """An index of segments (runs of word hashes) that knows the smallest owner of every window."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int):
        if not 1 <= window <= MOST:
            raise ValueError(f"windows have 1 to {MOST} words")
        self.window, self.alphabet = window, np.unique(words)
        text = np.zeros(len(words) + len(lengths), np.int64)  # a zero ends each segment
        stops = np.cumsum(lengths + 1) - 1
        solid = np.ones(len(text), bool)
        solid[stops] = False
        text[solid] = np.searchsorted(self.alphabet, words) + 1
        order, same = self._sort(text, (window, window - 1))
        self.size, n_symbols = len(text), len(self.alphabet) + 1
        first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))[:-1]
        self.wavelet = Wavelet(text[order - 1], n_symbols)
        symbols = np.arange(n_symbols)
        self.base = first - self.wavelet.place(symbols, np.zeros(n_symbols, np.int64))
        # suffixes with the same first words form classes: by whole windows, with the smallest owner of each,
        # and by one word less, with the bounds of each
        starts = np.flatnonzero(~same[0])
        self.cls = np.cumsum(~same[0]) - 1
        self.least = np.minimum.reduceat(np.repeat(owners, lengths + 1)[order], starts)
        self.wide = np.cumsum(~same[1]) - 1
        self.bounds = np.append(np.flatnonzero(~same[1]), self.size)

    @staticmethod
    def _sort(text: np.ndarray, wanted: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The order of the suffixes, and for each length in ``wanted`` which share so many words with the one before."""
        ranks, reach = [text], 1
        while reach <= MOST:
            rank = ranks[-1]
            ahead = np.zeros_like(rank)
            if reach < len(rank):
                ahead[:-reach] = rank[reach:] + 1
            ranks.append(np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1])
            reach *= 2
        order = np.argsort(ranks[-1], kind="stable")
        out = []
        for length in wanted:
            same = np.ones(len(text), bool)
            if length:  # two overlapping runs of a power of two
                rank, gap = ranks[length.bit_length() - 1], length - (1 << length.bit_length() - 1)
                later = np.full_like(rank, -1)
                later[: len(rank) - gap] = rank[gap:]
                same[1:] = (rank[order[1:]] == rank[order[:-1]]) & (later[order[1:]] == later[order[:-1]])
            same[0] = False
            out.append(same)
        return order, out

    def least_owners(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each word of the queries the smallest owner of the window that starts there; -1: no such window.

        A query is read from its end.  Each word narrows the interval of suffixes; at ``window`` words the interval
        is a class, which is reported; the last word is then let go.  A word that empties
        the interval rules out every window over the words read, so reading goes on from the end but one of these.
        """
        symbol = np.searchsorted(self.alphabet, words)
        known = symbol < len(self.alphabet)
        known[known] = self.alphabet[symbol[known]] == words[known]
        symbol = np.where(known, symbol + 1, 0)
        out = np.full(len(words), -1, np.int64)
        floor = np.cumsum(lengths) - lengths
        at = floor + lengths - 1
        low, high, depth = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size), np.zeros(len(lengths), np.int64)
        live = np.flatnonzero(lengths >= self.window)
        while len(live):
            c = symbol[at[live]]
            ends = self.base[np.tile(c, 2)] + self.wavelet.place(np.tile(c, 2), np.concatenate((low[live], high[live])))
            lo, hi = ends[: len(live)], ends[len(live) :]
            good = (lo < hi) & (c > 0)
            on, off = live[good], live[~good]
            low[on], high[on] = lo[good], hi[good]
            depth[on] += 1
            full = on[depth[on] == self.window]
            out[at[full]] = self.least[self.cls[low[full]]]
            wide = self.wide[low[full]]
            low[full], high[full] = self.bounds[wide], self.bounds[wide + 1]
            depth[full] -= 1
            at[on] -= 1
            at[off] += np.maximum(depth[off], 1) - 1 - (depth[off] == 0)
            low[off], high[off], depth[off] = 0, self.size, 0
            live = live[at[live] - floor[live] + depth[live] + 1 >= self.window]
        return out
