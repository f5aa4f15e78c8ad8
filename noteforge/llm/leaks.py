"""Passages of evaluation items inside training notes, by q-gram lemma filtering.

Shared character q-grams of a note and an item are counted in overlapping diagonal bands. A
stretch of at least `stretch` characters with at most `edits` edits keeps at least
stretch + 1 - q * (edits + 1) of them within one band (the q-gram lemma), so a band with
fewer cannot hold one. The regions that remain are verified by banded alignment: from runs
of equal characters the furthest places are followed that the edit budget reaches on each
diagonal of the band. The q-gram index of the items is built in blocks where the items are
and read from the shared folder; the corpus is streamed once, whatever the number of items.
"""

from __future__ import annotations

import io
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.forms import content
from noteforge.session import cut, ship

Q = 5
#: Edits within a stretch, and diagonals by which bands overlap (edits may not exceed them).
EDITS = 1
BAND = 4
#: Shortest stretch that counts, in characters: scripts without spaces, and others.
STRETCH_WIDE, STRETCH = 12, 24
#: Characters of the items of one index block, and of a batch of notes that visits the blocks.
BLOCK_CHARS = 4_000_000
BATCH_CHARS = 2_000_000
#: Bits of the table that q-grams are looked up in first, as a power of two.
TABLE = 24

_MULT = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit values of all q-grams; equal grams have equal values, others collide by chance only."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    h = np.zeros(len(c) - q + 1, np.uint64)
    for i in range(q):
        h = (h ^ c[i : len(c) - q + 1 + i]) * _MULT
        h ^= h >> np.uint64(29)
    return h


def stretch_of(text: str) -> int:
    wide = sum("⺀" <= c <= "鿿" or c >= "\U00020000" for c in text)
    return STRETCH_WIDE if wide * 2 > len(text) else STRETCH


def bands_of(diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two overlapping bands that hold each diagonal."""
    b = diagonal // BAND
    return b, b - 1


class LeakIndex:
    """q-grams of a block of items: sorted values with the item and place of each."""

    ARRAYS = ("ids", "sizes", "codes", "stretch", "keys", "item", "place")

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        own = [codes(t) for _, t in items]
        self.sizes = np.array([len(c) for c in own], np.int64)
        self.codes = np.concatenate(own).astype(np.uint32) if own else np.empty(0, np.uint32)
        self.stretch = np.array([stretch_of(t) for _, t in items], np.int64)
        hashes = [grams(c) for c in own]
        keys = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        counts = [len(h) for h in hashes]
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.item = np.repeat(np.arange(len(items)), counts)[order].astype(np.int32)
        self.place = (np.concatenate([np.arange(n) for n in counts]) if counts else np.empty(0))[order].astype(np.int32)
        self._prepare()

    def _prepare(self) -> None:
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known = np.zeros(1 << TABLE, bool)
        self.known[self.keys >> np.uint64(64 - TABLE)] = True

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, **{name: getattr(self, name) for name in self.ARRAYS})
        return f.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> LeakIndex:
        z = np.load(io.BytesIO(blob), allow_pickle=False)
        x = cls.__new__(cls)
        for name in cls.ARRAYS:
            setattr(x, name, z[name])
        x._prepare()
        return x

    def regions(self, notes: np.ndarray, starts: np.ndarray, edits: int = EDITS) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
        """(note, item, regions) for notes laid end to end (`starts`, with the end as last): regions are
        (lowest and highest diagonal, first and last place in the note) of the bands that meet the bound."""
        h = grams(notes)
        at = np.flatnonzero(self.known[h >> np.uint64(64 - TABLE)])
        note = np.searchsorted(starts, at, "right") - 1
        inside = at + Q <= starts[note + 1]  # not over the seam of two notes
        at, note = at[inside], note[inside]
        lo, hi = np.searchsorted(self.keys, h[at], "left"), np.searchsorted(self.keys, h[at], "right")
        n = hi - lo
        at, note, lo, n = at[n > 0], note[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return
        k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, owner = self.item[k].astype(np.int64), np.repeat(note, n)
        pos = np.repeat(at, n) - starts[owner]
        need = np.maximum(1, self.stretch + 1 - Q * (edits + 1))
        found = []
        for band in bands_of(pos - self.place[k]):
            order = np.lexsort((band, item, owner))
            o, i, b, p = owner[order], item[order], band[order], pos[order]
            first = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]))))
            count = np.diff(np.append(first, len(o)))
            hit = count >= need[i[first]]
            low, high = np.minimum.reduceat(p, first)[hit], np.maximum.reduceat(p, first)[hit]
            first = first[hit]
            found.append(np.stack([o[first], i[first], b[first] * BAND, low, high + Q]))
        o, i, b, low, high = np.concatenate(found, axis=1)
        order = np.lexsort((i, o))
        o, i, b, low, high = (x[order] for x in (o, i, b, low, high))
        edge = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (i[1:] != i[:-1]), [True]))) if len(o) else np.zeros(1, int)
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield int(o[x]), int(i[x]), [(int(b[r]), int(b[r]) + 2 * BAND - 1, int(low[r]), int(high[r])) for r in range(x, y)]

    def leaks(self, texts: list[str], share: float = 0.5, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
        """(text, item id, characters held, characters of the item) where a text holds at least the share of an item."""
        own = [codes(t) for t in texts]
        if not own or not len(self.keys):
            return []
        notes = np.concatenate(own)
        starts = np.concatenate(([0], np.cumsum([len(c) for c in own])))
        out = []
        for note, item, regions in self.regions(notes, starts, edits):
            size = int(self.sizes[item])
            target = self.codes[self.starts[item] : self.starts[item] + size]
            covered = np.zeros(size, bool)
            for low, high, first, last in regions:
                for s, e in stretches(own[note], target, low, high, first, last, int(self.stretch[item]), edits):
                    covered[s:e] = True
            held = int(covered.sum())
            if held >= share * size:
                out.append((note, int(self.ids[item]), held, size))
        return out


def stretches(note: np.ndarray, item: np.ndarray, low: int, high: int, first: int, last: int, least: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """Spans of the item, of `least` characters or more, that align with the note within the edit budget in the band.

    Banded alignment: from each run of Q or more equal characters on a diagonal in [low, high],
    the furthest item places that 0, 1, ... edits reach on each diagonal are followed to both
    sides (a replacement stays on its diagonal, an insertion or deletion moves by one), and
    the budget is shared out between the sides. A span begins and ends with equal characters.
    """
    span = least + edits
    begin, end = max(0, first - high - span), min(len(item), last - low + span)
    unequal: dict[int, list[int]] = {}  # item places that differ from the note, with the ends of the diagonal
    runs = []
    for d in range(low - edits, high + edits + 1):  # note place = item place + d
        s, e = max(begin, -d), min(end, len(note) - d)
        if e <= s:
            continue
        at = np.concatenate(([s - 1], s + np.flatnonzero(note[s + d : e + d] != item[s:e]), [e]))
        unequal[d] = at.tolist()
        if low <= d <= high:
            runs += [(int(at[k]) + 1, int(at[k + 1]), d) for k in np.flatnonzero(np.diff(at) > Q)]

    def reach(place: int, d: int, side: int) -> list[int]:
        """Furthest place for each number of edits; side 1 is to the right, -1 to the left."""
        best = [place]
        now = {d: place}
        for _ in range(edits):
            step: dict[int, int] = {}
            top = best[-1]
            for x, p in now.items():
                # replacement, a character of the item more, a character of the note more
                for y, q in ((x, p + side), (x - side, p + side), (x + side, p)):
                    stops = unequal.get(y)
                    if stops is None:
                        continue
                    if side > 0:
                        k = bisect_left(stops, q)
                        got = stops[k] if 0 < k < len(stops) else None
                    else:
                        k = bisect_right(stops, q - 1) - 1
                        got = stops[k] + 1 if 0 <= k < len(stops) - 1 else None
                    if got is None:
                        continue
                    if y not in step or (got - step[y]) * side > 0:
                        step[y] = got
                    if got != q and (got - top) * side > 0:  # a span does not end with an edit
                        top = got
            now = step
            best.append(top)
        return best

    out = []
    for a, b, d in runs:
        right = reach(b, d, 1) if edits else [b]
        left = reach(a, d, -1) if edits else [a]
        for k in range(edits + 1):
            if right[k] - left[edits - k] >= least:
                out.append((left[edits - k], right[k]))
    return out


def _blocks(items: DataFrame, block_chars: int) -> DataFrame:
    """(block, blob): the index of each block of items; items are hashed to blocks of about block_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [content(t) for t in batch.column(1).to_pylist()]
            keep = [k for k, t in enumerate(texts) if t]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keep], pa.int64()), pa.array([texts[k] for k in keep], pa.string())], names=["i", "t"])

    known = cut(items.mapInArrow(read, "i bigint, t string"), "items")
    chars = known.agg(F.sum(F.length("t"))).first()[0] or 0
    number = max(1, -(-chars // block_chars))

    def build(group: pa.Table) -> pa.Table:
        index = LeakIndex(sorted(zip(group.column("i").to_pylist(), group.column("t").to_pylist())))
        return pa.table({"block": group.column("block").slice(0, 1), "blob": pa.array([index.dump()], pa.binary())})

    return known.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(number)).cast("int")).groupBy("block").applyInArrow(build, "block int, blob binary")


def _block_files(blocks: DataFrame) -> list[tuple[int, str]]:
    return sorted((r["block"], r["f"]) for r in blocks.select("block", F.input_file_name().alias("f")).collect())  # a row a block


def _load(uri: str, block: int) -> LeakIndex:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, path = fs.FileSystem.from_uri(uri)
    return LeakIndex.load(pq.read_table(path, columns=["block", "blob"], filesystem=system, filters=[("block", "==", block)]).column("blob")[0].as_py())


def leaked(notes: DataFrame, items: DataFrame, share: float = 0.5, note_id: str = "doc_id", item_id: str = "item_id", edits: int = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, held_chars, item_chars) of every note that holds at least `share` of an item.

    Texts are compared as content: look-alikes, case, spacing and punctuation do not count. A
    stretch may have `edits` edits (at most BAND) and must keep a whole q-gram.
    Null or empty texts on either side give nothing; long notes are read whole; repeated rows
    give repeated results; extra columns are ignored. The items' index lies in the shared
    folder in blocks of about block_chars characters; every task takes its batches of notes
    through the blocks, one in memory at a time, so the corpus is read once and no join is made.
    """
    if not 0 <= edits <= BAND:
        raise ValueError("edits must lie in [0, BAND]")
    spark = notes.sparkSession
    ship(spark)
    wanted = items.select(F.col(item_id).cast("bigint").alias("i"), F.col("text").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    files = _block_files(cut(_blocks(wanted, block_chars), "leaks"))
    source = notes.select(F.col(note_id).cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, LeakIndex] | None = None

        def flush(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            nonlocal last
            rows: tuple[list, ...] = ([], [], [], [])
            for block, uri in files:
                if last is None or last[0] != block:
                    last = (block, _load(uri, block))
                for note, *found in last[1].leaks(texts, share, edits):
                    for out, value in zip(rows, (ids[note], *found)):
                        out.append(value)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["doc_id", "item_id", "held_chars", "item_chars"])

        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and (t := content(text)):
                    ids.append(i)
                    texts.append(t)
                    chars += len(t)
                    if chars >= BATCH_CHARS:
                        yield flush(ids, texts)
                        ids, texts, chars = [], [], 0
        if ids:
            yield flush(ids, texts)

    return source.mapInArrow(run, "doc_id bigint, item_id bigint, held_chars bigint, item_chars bigint")


def leaked_documents(found: DataFrame) -> DataFrame:
    """Per note: how many items leaked and which holds the most."""
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max_by("item_id", F.struct(F.col("held_chars") / F.col("item_chars"), -F.col("item_id"))).alias("worst_item_id"))
