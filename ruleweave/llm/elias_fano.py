"""Elias-Fano sequences in flat uint64 arrays that can be memory-mapped; all operations take arrays of queries."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: The zeros before every so many words are noted too.
_NOTED = 16


def _places() -> np.ndarray:
    """(byte, rank): the position of the set bit number ``rank`` of a byte."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.argsort(1 - bits, axis=1, kind="stable").astype(np.int64)


_PLACES = _places()


def _select_in_word(words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The position of the set bit number ``ranks`` (from 0) in each word."""
    bytes_ = np.ascontiguousarray(words).view(np.uint8)
    # byte k of a product with ones is the number of bits up to it
    upto = (np.bitwise_count(bytes_).view(_U) * _U(0x0101010101010101)).view(np.uint8).reshape(-1, 8)
    k = np.minimum((upto <= ranks[:, None].astype(np.uint8)).sum(axis=1), 7)
    at = np.arange(len(words)) * 8 + k
    before = np.where(k > 0, upto.reshape(-1)[at - 1], 0)
    return k * 8 + _PLACES[bytes_[at], np.clip(ranks - before, 0, 7)]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with a count of bits before every word."""

    def __init__(self, flat: np.ndarray) -> None:
        flat = np.asarray(flat).view(np.ndarray)
        self.n, self.low_bits, high, low, cum, noted = (int(x) for x in flat[:6])
        at = 6
        self.high, at = flat[at : at + high], at + high
        self.low, at = flat[at : at + low], at + low
        self.ones, at = flat[at : at + cum].view(np.uint32)[: high + 1], at + cum
        self.noted = flat[at : at + noted].view(np.uint32)[: high // _NOTED + 1]
        self.size = at + noted

    @staticmethod
    def pack(values: np.ndarray, universe: int) -> np.ndarray:
        values = values.astype(_U)
        n = len(values)
        bits = max(0, (int(universe) // max(1, n)).bit_length() - 1)
        tops = (values >> _U(bits)).astype(np.int64)
        size = n + (int(universe) >> bits) + 3
        marks = np.zeros(-(-size // 64) * 64, np.uint8)
        marks[tops + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").view(_U)
        low = np.zeros(-(-n * bits // 64) + 1, _U)
        if bits and n:
            tails = values & _U((1 << bits) - 1)
            offset = np.arange(n, dtype=np.int64) * bits
            word, shift = offset >> 6, (offset & 63).astype(_U)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] = np.add.reduceat(tails << shift, first)
            over = np.flatnonzero((offset & 63) + bits > 64)
            low[word[over] + 1] += tails[over] >> (_U(64) - shift[over])
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        noted = (np.arange(0, len(high) + 1, _NOTED) * 64 - ones[::_NOTED].astype(np.int64)).astype(np.uint32)
        ones, noted = (np.concatenate([x, np.zeros(len(x) % 2, np.uint32)]).view(_U) for x in (ones, noted))
        return np.concatenate([np.array([n, bits, len(high), len(low), len(ones), len(noted)], _U), high, low, ones, noted])

    def _tails(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        offset = i * self.low_bits
        word, shift = offset >> 6, (offset & 63).astype(_U)
        found = self.low[word] >> shift
        over = np.flatnonzero((offset & 63) + self.low_bits > 64)
        found[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return found & _U((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        if not len(i):
            return np.zeros(0, np.int64)
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        at = word * 64 + _select_in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return ((at - i) << self.low_bits) | self._tails(i).astype(np.int64)

    def _begin(self, tops: np.ndarray) -> np.ndarray:
        """The first place whose high part is at least ``tops``: behind the zero of the part before."""
        k = np.maximum(tops - 1, 0)
        # the word of the zero number k: from the noted words, by halving
        low = (np.searchsorted(self.noted, k.astype(np.uint32), side="right") - 1) * _NOTED
        step = _NOTED >> 1
        while step:
            mid = np.minimum(low + step, len(self.high))
            low = np.where(mid * 64 - self.ones[mid] <= k, mid, low)
            step >>= 1
        at = low * 64 + _select_in_word(~self.high[low], k - (low * 64 - self.ones[low]))
        return np.where(tops > 0, at - k, 0)

    def find(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place in [begin, end) of each value, or -1.

        The successor is sought within the bucket of the value's high part, by halving on the low bits alone.
        """
        found = np.full(len(values), -1, np.int64)
        if not len(values) or not self.n:
            return found
        tops = values >> self.low_bits
        ok = np.flatnonzero((begin < end) & (tops + 1 < len(self.high) * 64 - self.n))
        tops, tails = tops[ok], (values[ok] & ((1 << self.low_bits) - 1)).astype(_U)
        low, high = np.maximum(self._begin(tops), begin[ok]), np.minimum(self._begin(tops + 1), end[ok])
        last = high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            less = self._tails(mid) < tails[live]
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
            live = live[low[live] < high[live]]
        here = np.flatnonzero(low < last)
        hit = here[self._tails(low[here]) == tails[here]]
        found[ok[hit]] = low[hit]
        return found
