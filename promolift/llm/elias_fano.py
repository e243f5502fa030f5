"""Elias-Fano sequences and an n-gram trie made of them, as one block of memory.

A sequence of n rising numbers below u keeps the low log2(u / n) bits of each as
they are and the high bits in unary. ``successor`` and ``value`` work on arrays of
arguments. All parts are plain arrays, so a trie can be used from a mapped file.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

WORD, BLOCK = 64, 8
U = np.uint64
HALVES = [(U(half), U((1 << half) - 1)) for half in (32, 16, 8, 4, 2, 1)]


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits one after the other in 64-bit words, with a spare word."""
    out = np.zeros(len(values) * width // WORD + 2, U)
    if not width or not len(values):
        return out
    at = np.arange(len(values), dtype=U) * U(width)
    word, shift = (at >> U(6)).astype(np.int64), at & U(63)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = shift + U(width) > U(WORD)
    out[word[over] + 1] |= values[over] >> (U(WORD) - shift[over])
    return out


class EliasFano:
    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self.mask = U((1 << width) - 1)
        self.zeros = np.arange(len(ones), dtype=np.int64) * (WORD * BLOCK) - ones.astype(np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """From numbers that never fall."""
        values = values.astype(U)
        n = len(values)
        last = int(values[-1]) if n else 0
        width = max(0, (last // max(n, 1)).bit_length() - 1)
        at = (values >> U(width)).astype(np.int64) + np.arange(n)
        size = n + (last >> width) + 2
        bits = np.zeros(-(-size // (WORD * BLOCK)) * WORD * BLOCK, bool)
        bits[at] = True
        high = np.packbits(bits, bitorder="little").view(U)
        counts = np.bitwise_count(high).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        ones = np.append(0, np.cumsum(counts)).astype(U)
        return cls(n, width, pack_bits(values & U((1 << width) - 1), width), high, ones)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], U), self.low, self.high, self.ones]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> EliasFano:
        head, low, high, ones = parts
        return cls(int(head[0]), int(head[1]), low, high, ones)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th bit that is set (or not)."""
        before = self.ones.astype(np.int64) if ones else self.zeros
        block = np.searchsorted(before, k, side="right") - 1
        rest = k - before[block]
        word = block * BLOCK
        flip = U(0) if ones else ~U(0)
        moving = np.ones(len(k), bool)
        for _ in range(BLOCK - 1):
            count = np.bitwise_count(self.high[word] ^ flip).astype(np.int64)
            moving &= rest >= count
            rest -= np.where(moving, count, 0)
            word += moving
        bits = self.high[word] ^ flip
        place = word * WORD
        for half, mask in HALVES:
            count = np.bitwise_count(bits & mask).astype(np.int64)
            beyond = rest >= count
            rest -= np.where(beyond, count, 0)
            bits = np.where(beyond, bits >> half, bits)
            place += np.where(beyond, int(half), 0)
        return place

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        over = np.where(shift > 0, self.low[word + 1] << ((U(WORD) - shift) & U(63)), U(0))
        return ((self.low[word] >> shift) | over) & self.mask

    def value(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, True) - i
        return (high.astype(U) << U(self.width)) | self._lows(i)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have high bits less than these."""
        last = int(self.zeros[-1])
        zero = np.clip(high, 1, last) - 1
        found = self._select(zero, False) - zero
        return np.where(high <= 0, 0, np.where(high > last, self.n, np.minimum(found, self.n)))

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place with a number of at least x; n where there is none."""
        high = (x >> U(self.width)).astype(np.int64)
        begin, end, low = self._below(high), self._below(high + 1), x & self.mask
        while (open_ := begin < end).any():
            middle = np.where(open_, (begin + end) // 2, 0)
            less = self._lows(middle) < low
            begin, end = np.where(open_ & less, middle + 1, begin), np.where(open_ & ~less, middle, end)
        return begin


class Trie:
    """n-grams of word ids, one level for each word, with a 16-bit code for each n-gram.

    Children of a context are neighbours in the next level, between two pointers.
    Their ids are kept relative to their context: on top of the last number of
    the context before, so the whole level rises and a child is found by the
    successor of (base of the context + id).
    """

    def __init__(self, levels: list[EliasFano], pointers: list[EliasFano], codes: np.ndarray):
        self.levels, self.pointers, self.codes = levels, pointers, codes

    @classmethod
    def of(cls, grams: np.ndarray, codes: np.ndarray) -> Trie:
        """From different n-grams (rows of ids) in rising order."""
        n, order = grams.shape
        starts = np.zeros(n, bool)
        levels, pointers, parents = [], [], None
        for place in range(order):
            starts[:1] = True
            starts[1:] |= grams[1:, place] != grams[:-1, place]
            at = np.flatnonzero(starts)
            ids = grams[at, place].astype(U) + U(1)
            if parents is not None:
                first = np.searchsorted(at, parents)
                ends = np.append(first[1:], len(at))
                pointers.append(EliasFano.of(np.append(first, len(at))))
                tops = ids[ends - 1]
                base = np.append(U(0), np.cumsum(tops)[:-1]).astype(U) if len(tops) else tops
                ids = ids + np.repeat(base, ends - first)
            levels.append(EliasFano.of(ids))
            parents = at
        return cls(levels, pointers, codes.astype(np.uint16))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The place of each n-gram in the last level, -1 where it is not in the trie."""
        found = np.full(len(grams), -1, np.int64)
        if not self.levels[0].n:
            return found
        open_ = np.arange(len(grams))
        place = None
        for level, ids in enumerate(self.levels):
            wanted = grams[open_, level].astype(U) + U(1)
            if level:
                begin, end = (self.pointers[level - 1].value(place + step).astype(np.int64) for step in (0, 1))
                base = np.where(begin > 0, ids.value(np.maximum(begin, 1) - 1), U(0))
                wanted = wanted + base
            else:
                end = np.full(len(open_), ids.n)
            place = ids.successor(wanted)
            held = place < end
            held[held] = ids.value(place[held]) == wanted[held]
            open_, place = open_[held], place[held]
        found[open_] = place
        return found

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """The code of each n-gram, 0 where it is not in the trie."""
        place = self.find(grams)
        return np.where(place >= 0, self.codes[np.maximum(place, 0)] if len(self.codes) else 0, 0).astype(np.uint16)

    def image(self) -> bytes:
        """The trie as bytes: the sizes of its arrays, then the arrays, all in 64-bit words."""
        arrays = [part for sequence in (*self.levels, *self.pointers) for part in sequence.parts()]
        codes = np.append(self.codes, np.zeros(-len(self.codes) % 4, np.uint16)).view(U)
        head = np.array([len(self.levels), len(self.codes), *(len(a) for a in arrays)], U)
        return b"".join(a.tobytes() for a in (head, *arrays, codes))

    @classmethod
    def mapped(cls, image: bytes) -> Trie:
        """The trie in a file of the task's own, mapped into memory; it goes with the last array."""
        with tempfile.TemporaryFile() as file:
            file.write(image)
            file.flush()
            words = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), U)
        order, n_codes = int(words[0]), int(words[1])
        sequences = 2 * order - 1
        sizes = words[2:2 + 4 * sequences].astype(np.int64)
        cuts = np.append(0, np.cumsum(sizes)) + 2 + 4 * sequences
        arrays = [words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        made = [EliasFano.from_parts(arrays[i:i + 4]) for i in range(0, len(arrays), 4)]
        codes = words[cuts[-1]:].view(np.uint16)[:n_codes]
        return cls(made[:order], made[order:], codes)
