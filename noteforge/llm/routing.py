"""Which texts of a shard can lie within the edit budget of a text, from lists of short pieces.

A shard lists every piece of PIECE letters of its texts by hash and place. A text is cut into
disjoint pieces. One edit breaks at most one of them, so of any n pieces a pair within d edits
keeps n - d; one that is kept at a shift of s places, in a text longer by m letters, has at
least |s| edits on its left and |m - s| on its right, so only places with |s| + |m - s| <= d
are looked at. Of each text the pieces with fewest such places are used. Pairs that keep enough
are held against each other by their runs of 2 and of 3 letters, of which an edit changes at
most 4 and 6. Nothing within the budget is lost; the full-text index decides on what
is left.
"""

from __future__ import annotations

import io

import numpy as np

#: Letters of a piece. With fewer than 9 a text has more pieces than edits, whatever its length.
PIECE = 5
#: Pieces that a pair must keep, where a text has enough.
KEPT = 3
#: Letters of a run, and bits of the set of a text's runs for each of its letters.
SETS = ((2, 4), (3, 8))
#: Most bits of a set.
BITS = 32_768
#: Places, or pairs, at once.
PLACES = 1_000_000
#: Places beyond this are one.
FAR = 65_535

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _flat(texts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(texts).astype(np.uint64) if texts else np.zeros(0, np.uint64)


def signatures(texts: list[np.ndarray], run: int, bits: int) -> np.ndarray:
    """The runs of so many letters of each text as a set of so many bits; the first, second, ... of one run are apart."""
    out = np.zeros((len(texts), bits // 64), np.uint64)
    rows = max(1, 2**24 // bits)
    for at in range(0, len(texts), rows):
        part = texts[at : at + rows]
        flat = _flat(part)
        own = np.repeat(np.arange(len(part)), [len(t) for t in part])
        begin = np.flatnonzero(own[run - 1 :] == own[: len(own) - run + 1]) if len(own) >= run else np.zeros(0, np.int64)
        held = np.zeros((len(part), bits), bool)
        if len(begin):
            found = own[begin].astype(np.uint64) << np.uint64(40) | _hashed([flat[begin + k] for k in range(run)]) >> np.uint64(24)
            found.sort()
            new = np.concatenate(([True], found[1:] != found[:-1]))
            again = np.arange(len(found)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            bit = _hashed([found & np.uint64(2**40 - 1), again.astype(np.uint64)]) % np.uint64(bits)
            held[(found >> np.uint64(40)).astype(np.int64), bit.astype(np.int64)] = True
        out[at : at + rows] = np.packbits(held, axis=1, bitorder="little").view(np.uint64)
    return out


def _budget(share: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.floor(share * np.maximum(a, b) + 1e-9).astype(np.int64)


def _ranges(begin: np.ndarray, number: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each, one after the other."""
    return np.repeat(begin - np.cumsum(number) + number, number) + np.arange(int(number.sum()))


class Cut:
    """Texts in order of their size, cut into disjoint pieces; read by every shard."""

    def __init__(self, texts: list[np.ndarray]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.pieces = self.size // PIECE
        flat = _flat([t[: n * PIECE] for t, n in zip(texts, self.pieces.tolist())]).reshape(-1, PIECE)
        own = np.repeat(np.arange(len(texts)), self.pieces)
        begin = _ranges(np.zeros(len(texts), np.int64), self.pieces) * PIECE
        key = _hashed(list(flat.T))
        order = np.argsort(key)  # neighbours are looked up together
        self.own, self.begin, self.key = own[order], begin[order], key[order]
        self.texts, self.known = texts, {}

    def sets(self, run: int, bits: int, first: int, last: int) -> np.ndarray:
        """Sets of the texts first to last; shards of like texts ask for the same."""
        if (known := self.known.get(run)) is None or known[1].shape[1] * 64 != bits or not (known[0] <= first and last <= known[0] + len(known[1])):
            known = self.known[run] = (first, signatures(self.texts[first:last], run, bits))
        return known[1][first - known[0] : last - known[0]]


class PieceLists:
    """Of each place of a piece: the first bits of its hash, the place, the number of the text, in one sorted word."""

    def __init__(self, texts: list[np.ndarray]):
        """texts: code points of each, in order of their size."""
        self.sizes = np.array([len(t) for t in texts], np.int64)
        number = np.maximum(self.sizes - PIECE + 1, 0)
        flat = _flat(texts)
        begin = _ranges(np.zeros(len(texts), np.int64), number)
        at = begin + np.repeat(np.cumsum(self.sizes) - self.sizes, number)
        self._prepare()
        words = self._word(_hashed([flat[at + k] for k in range(PIECE)]), begin) | np.repeat(np.arange(len(texts), dtype=np.uint64), number)
        words.sort()
        self.words = words
        mean = max(1, int(self.sizes.mean())) if len(texts) else 1
        self.sets = [signatures(texts, run, min(BITS, max(256, 1 << (bits * mean - 1).bit_length()))) for run, bits in SETS]

    def _prepare(self) -> None:
        self.bits = np.uint64(max(1, len(self.sizes) - 1).bit_length())
        self.text = (np.uint64(1) << self.bits) - np.uint64(1)

    def _word(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((key >> (self.bits + np.uint64(16))) << np.uint64(16) | np.clip(place, 0, FAR).astype(np.uint64)) << self.bits

    def pairs(self, cut: Cut, first: int, last: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, number of the listed text) of all pairs that can be within the share, of the texts first to last."""
        size = cut.size[first:last]
        # listed texts of fitting length, and the most edits with any of them
        longest = np.floor(size / (1 - share) + 1e-9).astype(np.int64)
        begin, end = np.searchsorted(self.sizes, np.ceil(size * (1 - share) - 1e-9)), np.searchsorted(self.sizes, longest, "right")
        fitting = np.maximum(end - begin, 0)
        low, high = (self.sizes[np.clip(k, 0, len(self.sizes) - 1)] for k in (begin, end - 1))
        most = _budget(share, size, high)
        used = np.minimum(cut.pieces[first:last], most + KEPT)
        listed = (cut.own >= first) & (cut.own < last)
        own, place, key = cut.own[listed] - first, cut.begin[listed], cut.key[listed]
        least = place + -((most + size - low) // 2)[own]  # by the shift s with |s| + |m - s| <= most
        upto = place + ((most + high - size) // 2)[own]
        lo = np.searchsorted(self.words, self._word(key, least))
        hi = np.searchsorted(self.words, self._word(key, upto) | self.text, "right")
        n = np.maximum(hi - lo, 0)
        order = np.argsort(own << 32 | np.minimum(n, 2**31))
        own, place, lo, n = own[order], place[order], lo[order], n[order]
        rank = np.arange(len(own)) - (np.cumsum(cut.pieces[first:last]) - cut.pieces[first:last])[own]
        places = np.bincount(own, np.where(rank < used[own], n, 0), minlength=len(size)).astype(np.int64)
        whole = (fitting > 0) & ((used <= most) | (places > fitting))  # then all of fitting length are fewer
        use = (rank < used[own]) & (n > 0) & (fitting > 0)[own] & ~whole[own]
        own, place, lo, n = own[use], place[use], lo[use], n[use]
        xs, ys = [], []
        for a, b in self._parts(np.bincount(own, n, minlength=len(size)).astype(np.int64)):
            at = slice(*np.searchsorted(own, (a, b)))
            rows = _ranges(lo[at], n[at])
            word = self.words[rows]
            x, y = np.repeat(own[at], n[at]), (word & self.text).astype(np.int64)
            there = (word >> self.bits & np.uint64(FAR)).astype(np.int64)
            longer = self.sizes[y] - size[x]
            shift = there - np.repeat(place[at], n[at])
            budget = _budget(share, size[x], self.sizes[y])
            near = (np.abs(longer) <= budget) & ((np.abs(shift) + np.abs(longer - shift) <= budget) | (there == FAR))
            pair, held = np.unique(x[near] * len(self.sizes) + y[near], return_counts=True)
            x, y = pair // len(self.sizes), pair % len(self.sizes)
            enough = held >= used[x] - _budget(share, size[x], self.sizes[y])
            self._alike(cut, first, last, x[enough], y[enough], share, xs, ys)
        for a, b in self._parts(np.where(whole, fitting, 0)):
            number = np.where(whole, fitting, 0)[a:b]
            self._alike(cut, first, last, np.repeat(np.arange(a, b), number), _ranges(begin[a:b], number), share, xs, ys)
        return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    @staticmethod
    def _parts(number: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of texts with about PLACES in all."""
        upto, parts, a = np.cumsum(number), [], 0
        while a < len(number) and upto[-1] > (upto[a - 1] if a else 0):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PLACES, "right")))
            parts.append((a, b))
            a = b
        return parts

    def _alike(self, cut: Cut, first: int, last: int, x: np.ndarray, y: np.ndarray, share: float, xs: list, ys: list) -> None:
        for (run, _), ours in zip(SETS, self.sets):
            if not len(x):
                return
            theirs = cut.sets(run, ours.shape[1] * 64, first, last)
            most = 2 * run * _budget(share, cut.size[first + x], self.sizes[y])
            apart = np.zeros(len(x), np.int64)
            for k in range(ours.shape[1]):
                apart += np.bitwise_count(theirs[x, k] ^ ours[y, k])
                if k % 4 == 3:
                    left = apart <= most
                    x, y, most, apart = x[left], y[left], most[left], apart[left]
        xs.append(first + x)
        ys.append(y)

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, sizes=self.sizes, words=self.words, **{f"set{k}": s for k, s in enumerate(self.sets)})
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> PieceLists:
        z = np.load(io.BytesIO(blob), allow_pickle=False)
        x = cls.__new__(cls)
        x.sizes, x.words, x.sets = z["sizes"], z["words"], [z[f"set{k}"] for k in range(len(SETS))]
        x._prepare()
        return x
