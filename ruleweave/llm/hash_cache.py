"""Worker-side stores of byte spans: 64-bit hashes find a span, its bytes confirm it. All in numpy."""

from __future__ import annotations

import numpy as np

from .common import gather, spans_equal


class HashTable:
    """A read-only open-addressing table of byte spans to int32 values; small enough to broadcast."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        """Distinct ``hashes``; the bytes of span k are data[at[k]:at[k + 1]]."""
        bits = max(4, int(4 * max(1, len(hashes)) - 1).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.zeros(mask + 1, np.uint64), np.full(mask + 1, -1, np.int32)
        self.values, self.data, self.at = np.asarray(values, np.int32), data, at
        self.probes = 1
        for k, key in enumerate(hashes.tolist()):
            slot = key >> (64 - bits)
            steps = 1
            while self.places[slot] >= 0:
                slot, steps = (slot + 1) & mask, steps + 1
            self.keys[slot], self.places[slot] = key, k
            self.probes = max(self.probes, steps)

    def find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The value of every span, or -1."""
        at = (hashes >> self.shift).astype(np.int64)
        place = np.where(self.keys[at] == hashes, self.places[at], np.int32(-1))
        left = np.flatnonzero((place < 0) & (self.places[at] >= 0))
        for k in range(1, self.probes):
            if not len(left):
                break
            slot = (at[left] + k) & (len(self.keys) - 1)
            hit = (self.keys[slot] == hashes[left]) & (self.places[slot] >= 0)
            place[left[hit]] = self.places[slot[hit]]
            left = left[~hit & (self.places[slot] >= 0)]
        out = np.full(len(hashes), -1, np.int64)
        hit = np.flatnonzero(place >= 0)
        place = place[hit]
        good = spans_equal(data, begin[hit], end[hit], self.data, self.at[place], self.at[place + 1])
        out[hit[good]] = self.values[place[good]]
        return out


class Growing:
    """An array that is appended to, with room for more."""

    def __init__(self, kind: type, shape: tuple[int, ...] = ()) -> None:
        self.buffer, self.n = np.zeros((1024, *shape), kind), 0

    def __len__(self) -> int:
        return self.n

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.buffer):
            grown = np.zeros((max(2 * len(self.buffer), self.n + len(more)), *self.buffer.shape[1:]), self.buffer.dtype)
            grown[: self.n] = self.buffer[: self.n]
            self.buffer = grown
        self.buffer[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.buffer[: self.n]


class SpanStore:
    """Distinct byte spans, numbered from 0; emptied when it would hold over ``most`` spans or ``most_bytes`` bytes.

    Sorted hashes in two levels find the number. A span whose bytes differ from those stored under its hash gets a number of
    its own, kept by its bytes.
    """

    def __init__(self, most: int, most_bytes: int = 64 << 20) -> None:
        self.most, self.most_bytes = most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64)) for _ in range(2)]
        self.data, self.at = Growing(np.uint8), Growing(np.int64)
        self.at.append(np.zeros(1, np.int64))
        self.others: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.at) - 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for keys, numbers in self.levels:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                out = np.where(keys[at] == hashes, numbers[at], out)
        return out

    def _index(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        large, small = self.levels
        small = self._merged(small, (hashes, numbers))
        if 4 * len(small[0]) > len(large[0]):
            large, small = self._merged(large, small), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.levels = [large, small]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order]

    def _keep(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.data.append(data[gather(begin, end - begin)])
        self.at.append(self.at.all[-1] + np.cumsum(end - begin))

    def numbers(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The number of every span; spans that hold the new numbers, in order; the first new number (0: all before are gone)."""
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        number = self._find(keys)
        new = np.flatnonzero(number < 0)
        size = int((end - begin)[first[new]].sum())
        if len(self) and (len(self) + len(new) > self.most or len(self.data) + size > self.most_bytes):
            self.clear()
            number, new = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        base = len(self)
        fresh = first[new]
        number[new] = np.arange(base, base + len(new))
        self._keep(data, begin[fresh], end[fresh])
        self._index(keys[new], number[new])
        used = number[back]
        at = self.at.all
        bad = np.flatnonzero(~spans_equal(data, begin, end, self.data.all, at[used], at[used + 1]))
        more = []
        for k in bad.tolist():
            word = data[begin[k] : end[k]].tobytes()
            if word not in self.others:
                self.others[word] = len(self) + len(more)
                more.append(k)
            used[k] = self.others[word]
        if more:
            fresh = np.concatenate([fresh, more])
            self._keep(data, begin[more], end[more])
        return used, fresh, base
