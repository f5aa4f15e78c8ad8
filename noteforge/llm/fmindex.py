"""A compressed full-text index of a shard of texts, searched backwards for many patterns at once.

The Burrows-Wheeler transform of the joined texts is kept as a wavelet matrix (one bit per
level, with counts per 64 bits). Every PLACE-th suffix place is kept, the others are found by
walking back; every BLOCK-th row is kept too, from which the texts themselves are read back,
so they are not stored.
"""

from __future__ import annotations

import io

import numpy as np


def _heads(new: np.ndarray) -> np.ndarray:
    """Place at which the run of each begins; new marks the beginnings."""
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes in order: by as many letters as fit one word, then those that are still equal by prefix doubling."""
    n = len(s)
    letter = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1  # 0 is after the end
    base = int(letter.max()) + 1
    key, k = letter.copy(), 1
    while k < n and base ** (k + 1) < 2**62:
        key *= base
        key[: n - k] += letter[k:]
        k += 1
    order = np.argsort(key)
    found = key[order]
    new = np.concatenate(([True], found[1:] != found[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = _heads(new)  # the first place of all that are equal so far
    todo = order[~(new & np.concatenate((new[1:], [True])))]
    while len(todo):
        second = np.zeros(len(todo), np.int64)
        inside = todo + k < n
        second[inside] = rank[todo[inside] + k] + 1
        by = np.argsort(rank[todo] * (n + 1) + second)
        todo, second = todo[by], second[by]
        first = rank[todo]
        new = np.concatenate(([True], first[1:] != first[:-1]))
        group = _heads(new)
        order[first + np.arange(len(todo)) - group] = todo
        new |= np.concatenate(([True], second[1:] != second[:-1]))
        rank[todo] = first + _heads(new) - group
        todo = todo[~(new & np.concatenate((new[1:], [True])))]
        k *= 2
    return order


#: Distance of the suffix places that are kept, and of the rows from which texts are read back.
PLACE = 4
BLOCK = 64


def _bits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits in words of 64 and the ones before each word."""
    packed = np.packbits(np.concatenate((bits, np.zeros(-len(bits) % 64 + 64, bool))), bitorder="little").view(np.uint64)
    return packed, np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1].astype(np.int32)


class FMIndex:
    ARRAYS = ("ids", "sizes", "letters", "before", "words", "ones", "zeros", "first", "marks", "marked", "places", "rows")

    def __init__(self, texts: list[np.ndarray], ids: np.ndarray):
        """texts: code points of each; ids: what to call them, a row of an array each."""
        self.ids = np.asarray(ids)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self._prepare()
        joined = np.ones(self.n, np.uint32)  # 1 parts the texts, 0 is the end
        joined[-1] = 0
        for t, at in zip(texts, self.starts):
            joined[at : at + len(t)] = t + np.uint32(2)
        self.letters, coded = np.unique(joined, return_inverse=True)
        order = suffix_array(coded)
        kept = order % PLACE == 0
        self.marks, self.marked = _bits(kept)
        small = np.int32 if self.n < 2**31 else np.int64
        self.places = order[kept].astype(small)
        rank = np.empty(self.n, small)
        rank[order] = np.arange(self.n)
        self.rows = rank[np.minimum(np.arange(BLOCK, self.n + BLOCK, BLOCK), self.n - 1)]
        seq = coded[order - 1].astype(np.int64)
        counts = np.bincount(seq, minlength=len(self.letters))
        self.before = np.concatenate(([0], np.cumsum(counts)))[:-1].astype(np.int64)
        self.levels = max(1, int(len(self.letters) - 1).bit_length())
        words, ones, zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = ((seq >> level) & 1).astype(bool)
            for out, value in zip((words, ones), _bits(bits)):
                out.append(value)
            zeros.append(int((~bits).sum()))
            seq = np.concatenate((seq[~bits], seq[bits]))
        self.words, self.ones, self.zeros = np.stack(words), np.stack(ones), np.array(zeros)
        self.first = self._descend(np.arange(len(self.letters)), np.zeros(len(self.letters), np.int64))

    def _prepare(self) -> None:
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1].astype(np.int64)
        self.n = int(self.sizes.sum()) + len(self.sizes) + 1

    def _descend(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i in range(self.levels):
            bit = ((c >> (self.levels - 1 - i)) & 1).astype(bool)
            w = at >> 6
            below = np.bitwise_count(self.words[i][w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            ones = self.ones[i][w] + below
            at = np.where(bit, self.zeros[i] + ones, at - ones)
        return at

    def encode(self, t: np.ndarray) -> np.ndarray:
        """Codes of a pattern; -1 for letters that the texts lack."""
        t = t.astype(np.uint32) + np.uint32(2)
        at = np.searchsorted(self.letters, t)
        at[at == len(self.letters)] = 0
        return np.where(self.letters[at] == t, at, -1)

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more letter on the left (c >= 0)."""
        both = self._descend(np.concatenate((c, c)), np.concatenate((lo, hi))) - np.concatenate((self.first[c], self.first[c])) + np.concatenate((self.before[c], self.before[c]))
        return both[: len(c)], both[len(c) :]

    def find(self, pattern: np.ndarray) -> list[tuple[int, int]]:
        """(text number, offset) of every occurrence of one pattern."""
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        for c in self.encode(pattern)[::-1]:
            if c < 0:
                return []
            lo, hi = self.step(np.array([c]), lo, hi)
        text, offset = self.locate(np.arange(lo[0], hi[0]))
        return list(zip(text.tolist(), offset.tolist()))

    def _back(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(letter before each suffix, row of the suffix that begins with it)."""
        at, c = rows, np.zeros(len(rows), np.int64)
        for i in range(self.levels):
            w, low = at >> 6, (at & 63).astype(np.uint64)
            word = self.words[i][w]
            bit = (word >> low & np.uint64(1)).astype(np.int64)
            ones = self.ones[i][w] + np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
            c = c << 1 | bit
        return c, at - self.first[c] + self.before[c]

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, offset) of suffixes: walks back to a place that is kept."""
        at, place = np.asarray(rows, np.int64).copy(), np.empty(len(rows), np.int64)
        todo = np.arange(len(at))
        for walked in range(PLACE):
            here = at[todo]
            w, low = here >> 6, (here & 63).astype(np.uint64)
            word = self.marks[w]
            kept = (word >> low & np.uint64(1)).astype(bool)
            number = self.marked[w[kept]] + np.bitwise_count(word[kept] & ((np.uint64(1) << low[kept]) - np.uint64(1)))
            place[todo[kept]] = self.places[number].astype(np.int64) + walked
            todo = todo[~kept]
            if not len(todo):
                break
            at[todo] = self._back(at[todo])[1]
        text = np.searchsorted(self.starts, place, "right") - 1
        return text, place - self.starts[text]

    def contents(self, texts: np.ndarray) -> list[np.ndarray]:
        """Code points of texts, read back from the index in blocks."""
        a, b = self.starts[texts], self.starts[texts] + self.sizes[texts]
        if not len(a):
            return []
        wanted = np.unique(np.concatenate([np.arange(x // BLOCK, max(x, y - 1) // BLOCK + 1) for x, y in zip(a.tolist(), b.tolist())]))
        rows = self.rows[wanted].astype(np.int64)
        end = np.minimum((wanted + 1) * BLOCK, self.n - 1)
        out = np.zeros((len(wanted), BLOCK), np.int64)
        for back in range(1, BLOCK + 1):
            live = np.flatnonzero(end - back >= wanted * BLOCK)
            c, rows[live] = self._back(rows[live])
            out[live, end[live] - back - wanted[live] * BLOCK] = c
        flat = self.letters[out.ravel()] - np.uint32(2)
        found = []
        for x, y in zip(a.tolist(), b.tolist()):
            at = int(np.searchsorted(wanted, x // BLOCK)) * BLOCK + x % BLOCK
            found.append(flat[at : at + y - x])
        return found

    def pieces(self, patterns: list[np.ndarray], rarest: int, lane: int = 512) -> tuple[np.ndarray, ...]:
        """Cuts each pattern from the right into matches that end where they hold at most `rarest` times.

        Returns (pattern, begin, length, lo, hi) of all pieces; lo = hi where a piece does not occur.
        Long patterns are searched in lanes, so the steps of a batch are at most `lane`.
        """
        owner, base, cells = [], [], []
        for p, t in enumerate(patterns):
            for a in range(0, len(t), lane):
                owner.append(p)
                base.append(a)
                cells.append(self.encode(t[a : a + lane]))
        size = np.array([len(c) for c in cells], np.int64)
        owner_a, base_a = np.array(owner, np.int64), np.array(base, np.int64)
        order = np.argsort(-size, kind="stable")
        size, owner_a, base_a = size[order], owner_a[order], base_a[order]
        flat = np.concatenate([cells[i] for i in order]) if cells else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        lo, hi, got = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64), np.zeros(len(size), np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for back in range(1, int(size[0]) + 1 if len(size) else 1):
            live = int(np.searchsorted(-size, -back, "right"))  # lanes still that long
            c = flat[ends[:live] - back]
            known = np.maximum(c, 0)
            a, b = self.step(known, lo[:live], hi[:live])
            b = np.where(c < 0, a, b)
            got[:live] += 1
            done = b - a <= rarest
            rows = np.flatnonzero(done)
            if len(rows):
                out.append((owner_a[rows], base_a[rows] + size[rows] - back, got[rows], a[rows], np.maximum(a, b)[rows]))
                got[rows] = 0
            lo[:live], hi[:live] = np.where(done, 0, a), np.where(done, self.n, b)
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        return tuple(np.concatenate(x) for x in zip(*out))

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **{name: getattr(self, name) for name in self.ARRAYS})
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> FMIndex:
        z = np.load(io.BytesIO(blob), allow_pickle=False)
        x = cls.__new__(cls)
        for name in cls.ARRAYS:
            setattr(x, name, z[name])
        x._prepare()
        x.levels = len(x.words)
        return x
