"""Texts as one byte array with offsets, cut, hashed and looked up by numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one larger text is worked on alone.
CHUNK = 1 << 20
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def _power_table(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(CHUNK + 1, n)
        inverse = pow(BASES[which], -1, 1 << 64)
        made = []
        for base in (BASES[which], inverse):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        have = (made[0], made[1])
        if size <= 4 * CHUNK:
            _powers[which] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], from one running sum over the data."""
    power, inverse = _power_table(which, len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=run[1:])
    h = (run[ends] - run[starts]) * inverse[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without blanks), and for each text the number of its first."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~BLANK[data]
    step = np.diff(solid)
    begins, stops = step == 1, step == -1
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    touch = inner[(solid[inner] == 1) & (solid[inner + 1] == 1)]
    begins[touch] = stops[touch] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start:start + length] of each, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return pool[np.repeat(starts - before, lengths) + np.arange(total)]


class Memo:
    """Results of pieces by their 128-bit hashes: an open hash table over a pool of numbers.

    It is emptied when it holds `most` pieces, so memory is bounded whatever the vocabulary.
    """

    def __init__(self, dtype, most: int = 1 << 20) -> None:
        self.least, self.dtype = most, dtype
        self.clear()

    def clear(self) -> None:
        self.most, self.bits = self.least, max(10, (2 * self.least - 1).bit_length())
        size = 1 << self.bits
        self.one, self.two = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.slot = np.full(size, -1, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.length, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        at = (one >> np.uint64(64 - self.bits)).astype(np.int64)
        found = self.slot[at]
        miss = np.flatnonzero((found >= 0) & ((self.one[at] != one) | (self.two[at] != two)))
        mask = (1 << self.bits) - 1
        while len(miss):
            at[miss] = (at[miss] + 1) & mask
            here = at[miss]
            found[miss] = self.slot[here]
            miss = miss[(found[miss] >= 0) & ((self.one[here] != one[miss]) | (self.two[here] != two[miss]))]
        return found

    def add(self, one: np.ndarray, two: np.ndarray, values: list) -> None:
        """Distinct pieces that find() doesn't know, with their results."""
        n, lengths = len(values), np.fromiter(map(len, values), np.int64, len(values))
        total = int(lengths.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.pool[self.used : self.used + total] = [x for v in values for x in v]
        self.start[self.n : self.n + n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + n] = lengths
        at, left, mask = (one >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(n), (1 << self.bits) - 1
        while len(left):
            free = left[self.slot[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slot[at[won]], self.one[at[won]], self.two[at[won]] = self.n + won, one[won], two[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            left = left[np.argsort(at[left], kind="stable")] if len(left) else left
            at[left] = np.where(self.slot[at[left]] >= 0, (at[left] + 1) & mask, at[left])
        self.n, self.used = self.n + n, self.used + total

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, work: Callable[[list[bytes]], list]) -> tuple[np.ndarray, np.ndarray]:
        """Results of the pieces data[start:end], joined, and their lengths; work makes those not known yet."""
        one, two = span_hashes(data, starts, ends, 0), span_hashes(data, starts, ends, 1)
        slot = self.find(one, two)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            if self.n + len(missing) > self.most:
                self.clear()
                if len(missing) < len(slot):
                    missing = np.arange(len(slot))
            while len(missing):
                _, first = np.unique(one[missing], return_index=True)
                new = missing[first]
                while self.n + len(new) > self.most:
                    self.grow()
                self.add(one[new], two[new], work([data[a:b].tobytes() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]))
                slot[missing] = self.find(one[missing], two[missing])
                missing = missing[slot[missing] < 0]
        lengths = self.length[slot]
        return gather(self.pool, self.start[slot], lengths), lengths

    def grow(self) -> None:
        """More room for this once: one chunk of text has more pieces than the table."""
        keep = np.flatnonzero(self.slot >= 0)
        one, two, slot = self.one[keep], self.two[keep], self.slot[keep]
        self.bits, self.most = self.bits + 1, self.most * 2
        size, mask = 1 << self.bits, (1 << self.bits) - 1
        self.one, self.two, self.slot = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        at, left = (one >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(one))
        while len(left):
            free = left[self.slot[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.slot[at[won]], self.one[at[won]], self.two[at[won]] = slot[won], one[won], two[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = np.where(self.slot[at[left]] >= 0, (at[left] + 1) & mask, at[left])
