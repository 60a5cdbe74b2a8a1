"""A compressed FM-index over word sequences: a wavelet matrix on the Burrows-Wheeler transform.

Suffixes are sorted by their first ``depth`` words only, which is all that patterns of
up to ``depth`` words need.  All steps take arrays of queries.  Streamed sequences may be
any texts, of indexed symbols or others.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)


class Wavelet:
    """Rank of any symbol in any prefix, in one step for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for k in reversed(range(self.levels)):
            b = ((seq >> k) & 1).astype(np.uint8)
            self.bits.append(Bits(b))
            self.zeros.append(int(len(b) - b.sum()))
            seq = np.concatenate((seq[b == 0], seq[b == 1]))

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` goes among the symbol's occurrences, plus where those begin."""
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = (symbol >> (self.levels - 1 - level)) & 1
            r = bits.rank(i)
            i = np.where(one == 1, zeros + r, i - r)
        return i


class FMIndex:
    """Index of ``text`` (symbols from 0; 0 parts sequences and is in no pattern)."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, n = depth, len(text)
        sigma = int(text.max(initial=0)) + 1
        self.text, self.n, self._levels = text, n, {}
        rank_of = self._ranker()
        last = rank_of(depth)
        self.suffixes = np.argsort(last, kind="stable")
        sorted_last = last[self.suffixes]
        head = np.concatenate(([True], sorted_last[1:] != sorted_last[:-1])) if n else np.zeros(0, bool)
        #: Rows that agree on ``depth`` words: each row's group, and the groups' first rows.
        self.group = np.cumsum(head) - 1
        self.group_start = np.flatnonzero(head)
        # Rows that agree on one word less: where a full match goes when its last word is dropped.
        shorter = rank_of(depth - 1)[self.suffixes] if depth > 1 else np.zeros(n, np.int64)
        head = np.concatenate(([True], shorter[1:] != shorter[:-1])) if n else np.zeros(0, bool)
        starts = np.flatnonzero(head)
        number = np.cumsum(head) - 1
        self.wide_lo = starts[number] if n else number
        self.wide_hi = np.append(starts[1:], n)[number] if n else number
        bwt = text[self.suffixes - 1]  # the first suffix is preceded by the last symbol
        self.wavelet = Wavelet(bwt.astype(np.int64), sigma)
        count = np.bincount(text, minlength=sigma)
        self.first = np.concatenate(([0], np.cumsum(count)[:-1]))
        self.base = self.wavelet.descend(np.arange(sigma), np.zeros(sigma, np.int64))
        self.sigma = sigma

    def _ranker(self):
        """Ranks of the first k words of every suffix, by doubling."""
        n = self.n
        ranks = {1: self.text.astype(np.int64)}

        def shifted(x: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: max(0, n - k)] = x[k:] + 1
            return out

        def rank_of(k: int) -> np.ndarray:
            if k not in ranks:
                a = 1 << ((k - 1).bit_length() - 1)
                x, y = rank_of(a), shifted(rank_of(k - a), a)
                ranks[k] = np.unique(x * (int(y.max(initial=0)) + 1) + y, return_inverse=True)[1].reshape(-1).astype(np.int64)
            return ranks[k]

        return rank_of

    def widened(self, lo: np.ndarray, hi: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that agree with rows [lo, hi) on the first ``words`` words: a match that is shortened to those."""
        if words == 0:
            return np.zeros_like(lo), np.full_like(hi, self.n)
        if words not in self._levels:
            rank = self._ranker()(words)[self.suffixes]
            self._levels[words] = np.append(np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1]))), self.n)
        starts = self._levels[words]
        return starts[np.searchsorted(starts, lo, side="right") - 1], starts[np.searchsorted(starts, hi, side="left")]

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: rows that begin with ``symbol`` and then what [lo, hi) begin with; none for a symbol that isn't indexed."""
        known = symbol < self.sigma
        symbol = np.where(known, symbol, 0)
        shift = self.first[symbol] - self.base[symbol]
        lo, hi = self.wavelet.descend(symbol, lo) + shift, self.wavelet.descend(symbol, hi) + shift
        return lo, np.where(known, hi, lo)

    def steps(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Matching statistics of streamed sequences, capped at ``depth``.

        Sequences are read from their ends, a word of all of them at a time.  Yields
        (sequence numbers, offsets, matched words, first rows, end rows): the longest
        match that begins at that offset.  A match that can't be extended is shortened by
        its last words until it can be, or nothing is left of it.  Zeros match nothing.
        """
        todo = np.flatnonzero(lengths > 0)
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        have = np.zeros(len(lengths), np.int64)
        k = 0
        while len(todo):
            k += 1
            symbol = text[starts[todo] + lengths[todo] - k].astype(np.int64)
            a, b, m = lo[todo], hi[todo], have[todo]
            full = m == self.depth
            if full.any():
                row = a[full]
                a[full], b[full] = self.wide_lo[row], self.wide_hi[row]
                m = m - full
            x, y = self.extend(a, b, symbol)
            open_ = np.flatnonzero((y <= x) | (symbol == 0))
            found = np.ones(len(todo), bool)
            found[open_] = False
            open_ = open_[symbol[open_] != 0]
            while len(open_):
                open_ = open_[m[open_] > 0]
                m[open_] -= 1
                for words in np.unique(m[open_]):
                    these = open_[m[open_] == words]
                    a[these], b[these] = self.widened(a[these], b[these], int(words))
                x[open_], y[open_] = self.extend(a[open_], b[open_], symbol[open_])
                found[open_] = y[open_] > x[open_]
                open_ = open_[~found[open_]]
            lo[todo], hi[todo] = np.where(found, x, 0), np.where(found, y, self.n)
            have[todo] = np.where(found, m + 1, 0)
            yield todo, lengths[todo] - k, have[todo], lo[todo], hi[todo]
            todo = todo[lengths[todo] > k]

    def matches(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """(sequence numbers, offsets, first rows, end rows) of each place where ``depth`` words match, a step at a time."""
        for number, offset, have, lo, hi in self.steps(text, starts, lengths):
            hit = have == self.depth
            if hit.any():
                yield number[hit], offset[hit], lo[hit], hi[hit]
