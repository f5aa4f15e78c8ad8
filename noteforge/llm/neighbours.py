"""The k most similar vectors for every vector, by cross-polytope hashing.

Vectors are turned by fast Hadamard pseudo-rotations (random signs and Walsh-Hadamard, three
times) and assigned to the nearest signed axis. The number of hashes of a bucket's path, and
of axes of the last, follow from the row count, so buckets stay of one mean size; each vector
is filed under the few paths of each table that lose least (multiprobe on both sides).
Buckets that are still too full are split by hashing what sets their vectors apart from their
mean, without more copies of a vector. Inside a bucket candidates are found by blocked
products and reranked exactly in double precision; a pair that meets in several buckets of a
pass is reported in one of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteforge.operators.retrieval import usual_length
from noteforge.session import cut, ship

#: Mean rows of a bucket, and rows from which a bucket is split.
LEAF = 2_048
MAX_BUCKET = 8_192
#: Copies of vectors that are shuffled at once.
COPIES = 4
#: Further hashes of full buckets; what they leave together is compared as one bucket.
DEPTH = 24
#: Copies of one vector from which they are handled as one.
MAX_COPIES = 4_096


@dataclass(frozen=True)
class Layout:
    """Axes of each hash of a path, tables, and paths of each table that a vector is filed under."""

    axes: tuple[int, ...]
    tables: int
    probes: int


def layout(rows: int, dim: int, leaf: int = LEAF, probes_of_one: int = 2) -> Layout:
    """One hash while its axes give small enough buckets, then two, and so on; the last has as many axes as are needed.

    A path of one hash needs two probes, longer ones four, from three hashes on also a third table.
    """
    size = 1 << max(1, (dim - 1).bit_length())
    levels = 1
    while True:
        probes = probes_of_one if levels == 1 else COPIES
        last = rows * probes / leaf / float(2 * size) ** (levels - 1) / 2
        if last <= size or levels == 8:
            least = 8 if levels == 1 else 2
            axes = min(size, max(least, 1 << max(0, math.ceil(math.log2(max(1.0, last))))))
            return Layout((size,) * (levels - 1) + (axes,), 2 if levels < 3 else 3, probes)
        levels += 1


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _child(parent: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Key of a path with one more digit: 62 mixed bits."""
    h = (parent.astype(np.uint64) + np.uint64(1)) * _MIX ^ (digit.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ h >> np.uint64(29)) >> np.uint64(2)).astype(np.int64)


class Hasher:
    """Paths of signed axes. Full buckets have a mean; their vectors go on by the direction from it."""

    def __init__(self, dim: int, plan: Layout, seed: int = 7):
        self.dim, self.plan = dim, plan
        self.size = 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1, 1], np.float32), (plan.tables, len(plan.axes) + DEPTH, 3, self.size))
        self.full = np.empty(0, np.int64)  # keys of full buckets in order, and their means
        self.means = np.empty((0, self.size), np.float32)

    def split(self, full: dict[int, np.ndarray]) -> None:
        """Adds full buckets with their means."""
        known = dict(zip(self.full.tolist(), self.means))
        for key, mean in full.items():
            known[key] = np.pad(np.asarray(mean, np.float32), (0, self.size - len(mean)))
        self.full = np.array(sorted(known), np.int64)
        self.means = np.stack([known[k] for k in self.full.tolist()])

    def rotate(self, x: np.ndarray, table: int, level: int) -> np.ndarray:
        for signs in self.signs[table, level]:
            x = x * signs
            h = 1
            while h < self.size:
                y = x.reshape(len(x), -1, 2, h)
                x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), self.size)
                h *= 2
        return x

    def nearest(self, x: np.ndarray, table: int, level: int, axes: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, n) nearest signed axes of the first `axes`, and what the second and later lose."""
        r = self.rotate(x, table, level)[:, :axes]
        a = np.abs(r)
        n = min(n, axes)
        rows = np.arange(len(x))
        best = np.empty((len(x), n), np.int64)
        value = np.empty((len(x), n), np.float32)
        for j in range(n):
            best[:, j] = a.argmax(axis=1)
            value[:, j] = a[rows, best[:, j]]
            a[rows, best[:, j]] = -1
        norm = np.maximum(np.sqrt((r * r).sum(axis=1)), 1e-30)[:, None]
        return best * 2 + (np.take_along_axis(r, best, 1) > 0), ((value[:, :1] - value) / norm) ** 2

    def keys(self, x: np.ndarray, tables: list[int]) -> np.ndarray:
        """(rows, probes x tables) keys of buckets; places not used hold -1."""
        if x.shape[1] < self.size:
            x = np.pad(x, ((0, 0), (0, self.size - x.shape[1])))
        out = []
        for t in tables:
            key, loss = np.full((len(x), 1), t, np.int64), np.zeros((len(x), 1), np.float32)
            for level, axes in enumerate(self.plan.axes):
                digit, lost = self.nearest(x, t, level, axes, self.plan.probes)
                key, loss = self._least(_child(key[:, :, None], digit[:, None, :]).reshape(len(x), -1), (loss[:, :, None] + lost[:, None, :]).reshape(len(x), -1))
            for deeper in range(DEPTH if len(self.full) else 0):
                at = np.minimum(np.searchsorted(self.full, key), len(self.full) - 1)
                hot = (self.full[at] == key) & (key >= 0)
                if not hot.any():
                    break
                rows, cols = np.nonzero(hot)
                digit, lost = self.nearest(x[rows] - self.means[at[rows, cols]], t, len(self.plan.axes) + deeper, self.size, 2)
                more_key, more_loss = np.full((len(x), 2 * key.shape[1]), -1, np.int64), np.full((len(x), 2 * key.shape[1]), np.inf, np.float32)
                more_key[:, ::2], more_loss[:, ::2] = key, loss
                for j in range(digit.shape[1]):
                    more_key[rows, 2 * cols + j] = _child(key[rows, cols], digit[:, j])
                    more_loss[rows, 2 * cols + j] = loss[rows, cols] + lost[:, j]
                key, loss = self._least(more_key, more_loss)
            out.append(key)
        return np.concatenate(out, axis=1)

    def _least(self, key: np.ndarray, loss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paths that lose least, as many as are kept; equal losses in a fixed order."""
        if key.shape[1] <= self.plan.probes:
            return key, loss
        order = np.argsort(loss, axis=1, kind="stable")[:, : self.plan.probes]
        key, loss = np.take_along_axis(key, order, 1), np.take_along_axis(loss, order, 1)
        return np.where(np.isfinite(loss), key, -1), loss


def _unit(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, float32 unit vectors) of the usable rows."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
        ok = np.isfinite(norm) & (norm > 0)
        return ids[ok].astype(np.int64), (x[ok] / norm[ok, None]).astype(np.float32)


def _digest(x: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x + np.float32(0)]


def bucket_pairs(ids: np.ndarray, x: np.ndarray, keys: np.ndarray, key: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directed pairs (a, b, cosine) of one bucket: for each row its k best at `least` or more.

    Pairs that also share a smaller key are left to that bucket.
    """
    out_a, out_b, out_c = [], [], []
    wide = x.astype(np.float64)
    wide /= np.sqrt((wide * wide).sum(axis=1))[:, None]
    for at in range(0, len(ids), 1024):
        block = x[at : at + 1024] @ x.T
        rows = np.arange(len(block))
        block[rows, at + rows] = -2
        limit = np.float32(least - 1e-4)
        hit = block >= max(limit, np.float32(-1.5))
        if hit.sum() > 64 * len(block) and block.shape[1] > k:  # raise the limit to each row's k-th best
            kth = np.partition(block, block.shape[1] - k, axis=1)[:, block.shape[1] - k] - np.float32(1e-4)
            hit &= block >= kth[:, None]
        i, j = np.nonzero(hit)
        if not len(i):
            continue
        i += at
        cos = np.einsum("ij,ij->i", wide[i], wide[j])
        keep = cos >= least
        i, j, cos = i[keep], j[keep], cos[keep]
        order = np.lexsort((ids[j], -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        start = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, int)
        rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
        top = rank < k
        i, j, cos = i[top], j[top], cos[top]
        ki, kj = keys[i], keys[j]
        smaller = np.zeros(len(i), bool)
        for c in range(keys.shape[1]):
            smaller |= ((ki == kj[:, c : c + 1]) & (ki >= 0) & (ki < key)).any(axis=1)
        out_a.append(ids[i[~smaller]])
        out_b.append(ids[j[~smaller]])
        out_c.append(cos[~smaller])
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_c)


def nearest(df: DataFrame, id_col: str = "row_id", vec_col: str = "embedding", k: int = 5, least: float = -1.0, leaf: int = LEAF, max_bucket: int = MAX_BUCKET, max_copies: int = MAX_COPIES, seed: int = 7) -> DataFrame:
    """(row_id, neighbour_id, cosine): up to k most similar other vectors of each, by cosine, ties to the smaller id.

    Approximate: a neighbour is found if the two vectors share a bucket. Null vectors, zero
    vectors, vectors with null, NaN or infinite components and vectors whose length is not
    the most frequent one take no part; the norm does not matter; repeated vectors are neighbours
    of each other. Neighbours below `least` are not reported. Every row is indexed, under
    `probes` paths of each table of its layout whatever the size of buckets. Buckets over
    max_bucket rows are split again by the direction from their mean. Tables are searched in
    passes of at most COPIES copies of each vector. A vector with more than max_copies exact
    copies is indexed once. The driver gets the full buckets with their means (at most
    rows x probes x tables / max_bucket; evenly spread vectors have none) and the list of such
    vectors (at most rows / max_copies).
    """
    spark = df.sparkSession
    ship(spark)
    sized = df.select(F.col(id_col).cast("bigint").alias("i"), F.col(vec_col).cast("array<float>").alias("v")).where("i IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    dim = usual_length(sized, "v")
    result = "row_id bigint, neighbour_id bigint, cosine double"
    if dim is None:
        return spark.createDataFrame([], result)
    sized = sized.where(F.size("v") == dim)
    rows = sized.count()
    plan = layout(rows, dim, leaf)
    hasher = Hasher(dim, plan, seed)
    every = list(range(plan.tables))
    full, copied = _survey(sized, hasher, every, max_bucket, max_copies)
    if full:  # paths get longer, so more of them are needed
        plan = layout(rows, dim, leaf, COPIES)
        plan = Layout(plan.axes, plan.tables + 1, COPIES)
        hasher, every = Hasher(dim, plan, seed), list(range(plan.tables))
        full, _ = _survey(sized, hasher, every, max_bucket, 0, copied)
    spare = {}
    if copied:
        spare = _first_ids(sized, dim, copied, k + 1)
        for r in spare.values():
            r.sort()
    for _ in range(DEPTH):
        if not full:
            break
        hasher.split(_means(sized, hasher, every, full, copied))
        full = _survey(sized, hasher, every, max_bucket, 0, copied)[0]
    best = Window.partitionBy("row_id").orderBy(F.desc("cosine"), "neighbour_id")

    def first(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("_r", F.row_number().over(best)).where(f"_r <= {k}").drop("_r")

    at_once = max(1, COPIES // plan.probes)
    passes = [every[a : a + at_once] for a in range(0, plan.tables, at_once)]
    if len(passes) == 1:
        pairs = _pass(sized, hasher, passes[0], copied, k, least)
    else:
        done = None
        for tables in passes:
            part = cut(first(_pass(sized, hasher, tables, copied, k, least)), "pass")
            done = part if done is None else done.unionByName(part)
            spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffle files of the pass
        pairs = done.repartition("row_id").groupBy("row_id", "neighbour_id").agg(F.max("cosine").alias("cosine"))
    if spare:
        pairs = _spread_copies(spark, sized, dim, pairs, copied, spare, k)
    return first(pairs)


def _once(ids: np.ndarray, x: np.ndarray, copied: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Without further copies of much-copied vectors."""
    if not copied or not len(ids):
        return ids, x
    keep = np.array([copied.get(d, i) == i for i, d in zip(ids.tolist(), _digest(x))], bool)
    return ids[keep], x[keep]


def _survey(sized: DataFrame, hasher: Hasher, tables: list[int], max_bucket: int, max_copies: int, copied: dict[bytes, int] | None = None) -> tuple[list[int], dict[bytes, int]]:
    """(keys of full buckets, first id of each much-copied vector unless max_copies is 0)."""
    dim, shared = hasher.dim, sized.sparkSession.sparkContext.broadcast((hasher, copied))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, copied = shared.value
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            ids, x = _once(*_unit(batch, dim), copied)
            if not len(ids):
                continue
            found = hasher.keys(x, tables)
            keys = np.concatenate((keys, found[found >= 0]))
            counts = np.concatenate((counts, np.ones(len(keys) - len(counts), np.int64)))
            keys, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, counts, len(keys)).astype(np.int64)
            if max_copies:
                yield pa.RecordBatch.from_arrays([pa.array(_digest(x), pa.binary()), pa.array(np.full(len(ids), -1)), pa.array(ids), pa.array(np.ones(len(ids), np.int64))], names=["d", "key", "i", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([b""] * len(keys), pa.binary()), pa.array(keys), pa.array(np.zeros(len(keys), np.int64)), pa.array(counts)], names=["d", "key", "i", "n"])

    counted = sized.mapInArrow(run, "d binary, key bigint, i bigint, n bigint").groupBy("d", "key").agg(F.sum("n").alias("n"), F.min("i").alias("first"))
    got = counted.where(f"(key >= 0 AND n > {max_bucket}) OR (key < 0 AND n > {max_copies})").collect()
    return [r["key"] for r in got if r["key"] >= 0], {bytes(r["d"]): r["first"] for r in got if r["key"] < 0}


def _means(sized: DataFrame, hasher: Hasher, tables: list[int], full: list[int], copied: dict[bytes, int]) -> dict[int, np.ndarray]:
    """Mean vector of each full bucket."""
    dim, shared = hasher.dim, sized.sparkSession.sparkContext.broadcast((hasher, copied, np.array(sorted(full), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, copied, wanted = shared.value
        sums, n = np.zeros((len(wanted), dim)), np.zeros(len(wanted), np.int64)
        for batch in batches:
            ids, x = _once(*_unit(batch, dim), copied)
            if not len(ids):
                continue
            keys = hasher.keys(x, tables)
            at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            rows, cols = np.nonzero(wanted[at] == keys)
            np.add.at(sums, at[rows, cols], x[rows])
            n += np.bincount(at[rows, cols], minlength=len(wanted))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[used]), pa.array(n[used]), pa.array([r.tobytes() for r in sums[used]], pa.binary())], names=["key", "n", "v"])

    def add(group: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(v) for v in group.column("v").to_pylist()) / sum(group.column("n").to_pylist())
        return pa.table({"key": group.column("key").slice(0, 1), "v": pa.array([whole.astype(np.float32).tobytes()], pa.binary())})

    got = sized.mapInArrow(run, "key bigint, n bigint, v binary").groupBy("key").applyInArrow(add, "key bigint, v binary").collect()
    return {r["key"]: np.frombuffer(bytes(r["v"]), np.float32) for r in got}


def _pass(sized: DataFrame, hasher: Hasher, tables: list[int], copied: dict[bytes, int], k: int, least: float) -> DataFrame:
    """(row_id, neighbour_id, cosine) of the pairs that share a bucket of some tables."""
    dim, shared = hasher.dim, sized.sparkSession.sparkContext.broadcast((hasher, copied))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, copied = shared.value
        for batch in batches:
            ids, x = _once(*_unit(batch, dim), copied)
            if not len(ids):
                continue
            keys = hasher.keys(x, tables)
            rows, cols = np.nonzero(keys >= 0)
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows, cols]), pa.array(ids[rows]), pa.array([raw[r] for r in rows], pa.binary())], names=["key", "i", "v"])

    def compare(group: pa.Table) -> pa.Table:
        hasher, _ = shared.value
        ids = group.column("i").to_numpy()
        x = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float32).reshape(len(ids), dim)
        a, b, cos = bucket_pairs(ids, x, hasher.keys(x, tables), group.column("key")[0].as_py(), k, least)
        return pa.table({"row_id": pa.array(a, pa.int64()), "neighbour_id": pa.array(b, pa.int64()), "cosine": pa.array(cos, pa.float64())})

    filed = sized.mapInArrow(file, "key bigint, i bigint, v binary")
    return filed.groupBy("key").applyInArrow(compare, "row_id bigint, neighbour_id bigint, cosine double")


def _members(sized: DataFrame, dim: int, copied: dict[bytes, int]) -> DataFrame:
    """(first, i): the rows of each much-copied vector."""
    shared = sized.sparkSession.sparkContext.broadcast(copied)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _unit(batch, dim)
            found = [(shared.value[d], i) for i, d in zip(ids.tolist(), _digest(x)) if d in shared.value]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.int64()), pa.array([i for _, i in found], pa.int64())], names=["first", "i"])

    return sized.mapInArrow(run, "first bigint, i bigint")


def _first_ids(sized: DataFrame, dim: int, copied: dict[bytes, int], n: int) -> dict[int, list[int]]:
    """The n smallest ids of each much-copied vector (at most n x rows / max_copies)."""
    w = Window.partitionBy("first").orderBy("i")
    out: dict[int, list[int]] = {}
    for r in _members(sized, dim, copied).withColumn("_r", F.row_number().over(w)).where(f"_r <= {n}").collect():
        out.setdefault(r["first"], []).append(r["i"])
    return out


def _spread_copies(spark, sized: DataFrame, dim: int, pairs: DataFrame, copied, spare, k: int) -> DataFrame:
    """Neighbours that are copies stand for their k first; copies are neighbours of each other."""
    table = spark.createDataFrame([(f, ids) for f, ids in spare.items()], "first bigint, ids array<bigint>")
    table = F.broadcast(table)
    others = pairs.join(table, pairs["row_id"] == table["first"], "left_anti")  # their k best are copies
    spread = others.join(table, others["neighbour_id"] == table["first"], "left").select("row_id", F.explode(F.coalesce(F.slice("ids", 1, k), F.array("neighbour_id"))).alias("neighbour_id"), "cosine")
    among = _members(sized, dim, copied).join(table, "first").select(F.col("i").alias("row_id"), F.explode(F.slice(F.filter("ids", lambda x: x != F.col("i")), 1, k)).alias("neighbour_id"), F.lit(1.0).alias("cosine"))
    return spread.unionByName(among)


def similar_pairs(df: DataFrame, id_col: str = "row_id", vec_col: str = "embedding", k: int = 5, least: float = 0.85, **how) -> DataFrame:
    """(row_id_a, row_id_b), a < b, where one is among the k nearest of the other at `least` or more."""
    n = nearest(df, id_col, vec_col, k, least, **how)
    return n.select(F.least("row_id", "neighbour_id").alias("row_id_a"), F.greatest("row_id", "neighbour_id").alias("row_id_b")).distinct()
