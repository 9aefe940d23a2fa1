"""Elias-Fano sequences and an n-gram trie level, queried by successor search.

All structures are views of one buffer, so a level written to a file is used
through a memory map, without being read in.
"""
from __future__ import annotations

import mmap
import tempfile
from functools import cached_property

import numpy as np

ABSENT = 0xFFFF
MANY = 1                        # questions per word of 64 bits from which the places of all bits are listed
STEPS_PER_BIT = 2047            # of the quantised logarithm: 32 bits of range in 16 bits of code


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down by at most 0.034 %."""
    return np.minimum(np.ceil(-np.log2(np.maximum(p, 2.0 ** -32)) * STEPS_PER_BIT), ABSENT - 1).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    """Of codes; 0 where absent."""
    return np.where(code == ABSENT, 0.0, np.exp2(-code.astype(np.float64) / STEPS_PER_BIT))


def nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th set bit (from 0) of each word."""
    x, n, place = words.copy(), n.astype(np.int64), np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(x & np.uint64((1 << width) - 1)).astype(np.int64)
        beyond = n >= ones
        n = np.where(beyond, n - ones, n)
        place += width * beyond
        x = np.where(beyond, x >> np.uint64(width), x)
    return place


class EliasFano:
    """A sequence that never falls, as low bits and unary high bits."""

    def __init__(self, parts: list[np.ndarray]):
        (self.n, self.low_bits), self.high, low = (int(x) for x in parts[0]), parts[1], parts[2]
        # Eight bytes from any byte on; the buffer ends in eight spare ones.
        self.low = np.ndarray((max(1, len(low) - 7),), "<u8", buffer=low, strides=(1,))
        ones = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        self.zeros_before = np.concatenate(([0], 64 * np.arange(1, len(ones) + 1) - ones))
        self.ones_before = np.concatenate(([0], ones))

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(64 * ((int(places[-1]) if n else 0) // 64 + 2), np.uint8)
        high[places] = 1
        high = np.packbits(high, bitorder="little").view("<u8")
        octets = values.astype("<u8").view(np.uint8).reshape(n, 8)
        bits = np.unpackbits(octets[:, :-(-low_bits // 8)], axis=1, bitorder="little")[:, :low_bits]
        low = np.concatenate((np.packbits(bits.ravel(), bitorder="little"), np.zeros(8, np.uint8)))
        return [np.array([n, low_bits], np.int64), high, low]

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    @cached_property
    def ones(self) -> np.ndarray:
        """Places of the set high bits."""
        return np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))

    @cached_property
    def zeros(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(~self.high.view(np.uint8), bitorder="little"))

    def many(self, asked: np.ndarray) -> bool:
        """Whether a list of all places costs less than a search for each that is asked for."""
        return len(asked) >= MANY * len(self.high)

    def at(self, i: np.ndarray) -> np.ndarray:
        if self.many(i):
            place = self.ones[i]
        else:
            word = np.searchsorted(self.ones_before, i, side="right") - 1
            place = word * 64 + nth_bit(self.high[word], i - self.ones_before[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low_of(i)

    def after_zeros(self, k: np.ndarray) -> np.ndarray:
        """Index of the first element whose high bits are k or more."""
        before = np.maximum(k, 1) - 1
        if self.many(k):
            place = self.zeros[before] + 1
        else:
            word = np.searchsorted(self.zeros_before, before, side="right") - 1
            place = word * 64 + nth_bit(~self.high[word], before - self.zeros_before[word]) + 1
        return np.where(k == 0, 0, place - k)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first element not below x, whether it equals x)."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = high < int(self.zeros_before[-1]) - 1
        bound = np.where(inside, high, 0)
        start = np.where(inside, self.after_zeros(bound), self.n)
        end = np.where(inside, self.after_zeros(bound + 1), self.n)
        low = x & np.uint64((1 << self.low_bits) - 1)
        a, b = start, end.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):                                    # bisection among the elements with these high bits
            mid = (a[open_] + b[open_]) >> 1
            less = self.low_of(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        found = a < end
        at = np.flatnonzero(found)
        found[at] = self.low_of(a[at]) == low[at]
        return a, found


class TrieLevel:
    """Contexts, where their successors begin, the successors and their codes.

    A successor is stored relative to its context: its id plus the last stored
    value of the context before, which makes one rising sequence of all ranges.
    """

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 11)
        parts, at = [], 88
        for k in range(10):
            kind = (np.int64, np.uint64, np.uint8)[k % 3] if k < 9 else np.uint16
            size = int(head[k])
            parts.append(np.frombuffer(buffer, kind, size // np.dtype(kind).itemsize, at))
            at += -(-size // 8) * 8
        self.contexts, self.pointers, self.words = (EliasFano(parts[3 * k:3 * k + 3]) for k in range(3))
        self.codes = parts[9]

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, code: np.ndarray) -> bytes:
        """From entries sorted by (context, word), each once; ids from 1 up."""
        begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) \
            else np.zeros(0, np.int64)
        last = word[np.append(begin[1:], len(word)) - 1] if len(begin) else word
        base = np.concatenate(([0], np.cumsum(last, dtype=np.uint64)[:-1])).astype(np.uint64) if len(begin) else word
        relative = word + np.repeat(base, np.diff(np.append(begin, len(word)))) if len(begin) else word
        arrays = [*EliasFano.build(context[begin]), *EliasFano.build(np.append(begin, len(word)).astype(np.uint64)),
                  *EliasFano.build(relative), code.astype(np.uint16)]
        blobs = [a.tobytes() for a in arrays]
        head = np.array([*(len(b) for b in blobs), 0], np.int64).tobytes()
        return head + b"".join(b + b"\0" * (-len(b) % 8) for b in blobs)

    @classmethod
    def mapped(cls, raw: bytes) -> TrieLevel:
        """Through a memory map of an unnamed file of the task."""
        with tempfile.TemporaryFile() as file:
            file.write(raw)
            file.flush()
            return cls(mmap.mmap(file.fileno(), len(raw), access=mmap.ACCESS_READ))

    def look_up(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each pair, ABSENT if it isn't there."""
        out = np.full(len(context), ABSENT, np.uint16)
        if not self.contexts.n:
            return out
        # A run of equal contexts is looked up once.
        new = np.concatenate(([True], context[1:] != context[:-1]))[:len(context)]
        i, known = self.contexts.successor(context[new])
        low, high = (self.pointers.at(i[known] + k).astype(np.int64) for k in (0, 1))
        base = np.where(low > 0, self.words.at(np.maximum(low - 1, 0)), np.uint64(0))
        run = np.cumsum(new) - 1
        at = np.flatnonzero(known[run])
        run = (np.cumsum(known) - 1)[run[at]]
        low, high = low[run], high[run]
        j, there = self.words.successor(base[run] + word[at])
        hit = there & (j >= low) & (j < high)
        out[at[hit]] = self.codes[j[hit]]
        return out
