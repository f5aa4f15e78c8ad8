"""Embedding extraction with a pluggable encoder, resumable (R8, T03), and a clustered index."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.functions.vectors import is_unit
from noteforge.operators.retrieval import _best, _matrix, query_blocks, ranked
from noteforge.session import cut, ship
from noteforge.sinks import store
from noteforge.sinks.files import commit_files, json_text


class Encoder(Protocol):
    """What a model must offer; instances are shipped to the tasks."""

    dimension: int
    fingerprint: str

    def encode(self, values: list) -> np.ndarray: ...


class HashEncoder:
    """A deterministic encoder without a model: hashed letter trigrams, L2-normalised. For tests and fallbacks."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.fingerprint = f"hash-trigrams-{dimension}"

    def encode(self, values: list) -> np.ndarray:
        out = np.zeros((len(values), self.dimension), np.float32)
        for row, value in enumerate(values):
            t = f"  {value} "
            for i in range(len(t) - 2):
                h = hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest()
                out[row, int.from_bytes(h[:4], "little") % self.dimension] += 1 if h[4] & 1 else -1
            if not out[row].any():
                out[row, 0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def extract(df: DataFrame, key: str, value: str, encoder: Encoder, done: DataFrame | None = None) -> DataFrame:
    """(key, embedding) of rows that are not done yet, in Arrow batches; null values are left out.

    Equal values are encoded once: distinct values come first and are joined back.
    """
    ship(df.sparkSession)
    todo = df.where(F.col(value).isNotNull()).select(key, value)
    if done is not None:
        todo = todo.join(done.select(key), key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"_v": b["_v"], "embedding": [r.tolist() for r in encoder.encode(b["_v"].tolist()).astype(np.float32)]})

    distinct = todo.select(F.col(value).alias("_v")).distinct()
    coded = distinct.mapInPandas(run, "_v string, embedding array<float>")
    return todo.join(coded, F.col(value) == F.col("_v")).select(key, "embedding")


def extract_into(df: DataFrame, key: str, value: str, encoder: Encoder, path: str) -> int:
    """Appends what is missing in the Parquet directory `path`; returns the rows added. Safe to repeat."""
    spark = df.sparkSession
    done = spark.read.parquet(path) if store.exists(spark, path) else None  # a store that cannot be read is an error
    new = cut(extract(df, key, value, encoder, done), "encoded")
    new.write.mode("append").parquet(path)
    return new.count()


def fit_cells(vectors: DataFrame, cells: int, sample: int = 50_000, seed: int = 1) -> np.ndarray:
    """Cell centres of a clustered index, fitted by k-means on a bounded seeded sample; every vector is indexed later."""
    rows = vectors.withColumn("_o", F.xxhash64(F.lit(seed), *[c for c in vectors.columns if c != "v"])).orderBy("_o").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in rows], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(12):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def indexed(vectors: DataFrame, row: str, centres: np.ndarray) -> DataFrame:
    """(cell, row, v): every vector under its nearest cell; write it partitioned or bucketed by cell."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = (_matrix(b.column(1)) @ centres.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), b.column(0), b.column(1)], names=["cell", row, "v"])

    return vectors.select(F.col(row).cast("bigint").alias(row), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"cell bigint, `{row}` bigint, v array<double>")


def probe(queries: DataFrame, index: DataFrame, row: str, centres: np.ndarray, k: int, nprobe: int = 8) -> DataFrame:
    """T4: (qid, row, score, rank): the k best rows of the nprobe nearest cells of each query (approximate)."""
    spark = queries.sparkSession
    ship(spark)
    schema = f"qid bigint, `{row}` bigint, score double"
    found: DataFrame | None = None
    for ids, q in query_blocks(queries):
        cells = np.argsort(-(q @ centres.T), axis=1)[:, :nprobe]
        wanted: dict[int, list[int]] = {}
        for i, cs in enumerate(cells):
            for c in cs:
                wanted.setdefault(int(c), []).append(i)
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), q, wanted))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, wanted = shared.value
            for b in batches:
                cell, rows, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), _matrix(b.column(2))
                for c in np.unique(cell):
                    if int(c) not in wanted:
                        continue
                    at = np.flatnonzero(cell == c)
                    qs = wanted[int(c)]
                    scores = np.round(q[qs] @ v[at].T, 12)
                    own = rows[at]
                    best = [_best(s, own, k) for s in scores]
                    n = [len(b) for b in best]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[qs], n)), pa.array(own[np.concatenate(best)]), pa.array(np.concatenate([s[b] for s, b in zip(scores, best)]))], names=["qid", row, "score"])

        part = index.where(F.col("cell").isin(list(wanted))).select("cell", row, "v").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    return ranked(found.select("qid", F.col(row).alias("doc_row"), F.col("score").alias("score_mm")), k).select("qid", F.col("doc_row").alias(row), F.col("score_mm").alias("score"), "rank")


class ClusteredIndex:
    """Vectors filed under their nearest cell, stored partitioned by cell, with the contract they were built under."""

    def __init__(self, frame: DataFrame, row: str, centres: np.ndarray, contract: dict):
        self.frame, self.row, self.centres, self.contract = frame, row, centres, contract

    def find(self, nprobe: int = 8):
        """A finder for operators.retrieval.search: (queries, k) -> (qid, row, score, rank) of the nprobe nearest cells."""
        return lambda queries, k: probe(queries, self.frame, self.row, self.centres, k, nprobe)


#: Vectors that must find themselves before an index is put in place.
CHECKED = 200


def write_index(vectors: DataFrame, row: str, path: str, contract: dict, cells: int | None = None, sample: int = 50_000, seed: int = 1) -> ClusteredIndex:
    """Builds, checks and commits the index of (row, v); an earlier one at `path` stays until the new one is in its place.

    Refused: a contract without its fields, vectors of another dimension or not in unit length,
    repeated or null rows. The cells are fitted on a seeded sample of at most `sample` vectors
    (their number is the root of the rows unless given), every vector is filed. What was written is read back:
    as many rows, and CHECKED seeded vectors find themselves (or an equal one) first.
    """
    spark = vectors.sparkSession
    missing = [f for f in ("model_fingerprint", "data_manifest_hash", "dimension", "normalization") if not contract.get(f)]
    if missing:
        raise ValueError(f"the contract lacks {', '.join(missing)}")
    if str(contract["normalization"]).lower() != "l2":
        raise ValueError("the contract is not of unit vectors")
    source = cut(vectors.select(F.col(row).cast("bigint").alias(row), F.col("v").cast("array<double>").alias("v")), "vectors")
    size = F.coalesce(F.size("v"), F.lit(-1))
    n, wrong, long, distinct = source.agg(F.count("*"), F.count_if(size != int(contract["dimension"])), F.count_if(~is_unit(F.col("v"))), F.count_distinct(row)).first()
    if wrong or long:
        raise ValueError(f"{wrong} vectors are not of dimension {contract['dimension']}, {long} not in unit length")
    if distinct != n:
        raise ValueError("rows repeat or are null")
    centres = fit_cells(source, cells or max(1, int(n**0.5)), sample, seed)
    staging = f"{path}.building"
    store.delete(spark, staging)
    try:
        indexed(source, row, centres).repartition("cell").write.partitionBy("cell").parquet(f"{staging}/cells")
        store.write_text(spark, f"{staging}/index.json", json_text({**contract, "row": row, "count": n, "centres": centres.tolist()}))
        built = open_index(spark, staging)
        if built.frame.count() != n:
            raise ValueError("the index reads back other rows than were written")
        asked = source.withColumn("_o", F.xxhash64(F.lit(seed), row)).orderBy("_o").limit(CHECKED).select(F.col(row).alias("qid"), "v")
        lost = asked.join(probe(asked, built.frame, row, centres, 1, 1).where("score >= 0.999999"), "qid", "left_anti").count() if n else 0
        if lost:
            raise ValueError(f"{lost} vectors do not find themselves")
        commit_files(spark, [(staging, path)])
    except BaseException:
        store.delete(spark, staging)
        raise
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str, contract: dict | None = None) -> ClusteredIndex:
    """The index at a path; if a contract is given, one that differs in a field is refused."""
    known = json.loads(store.read_text(spark, f"{path}/index.json"))
    for field in ("model_fingerprint", "data_manifest_hash", "dimension", "normalization"):
        if contract is not None and str(contract.get(field)).lower() != str(known.get(field)).lower():
            raise ValueError(f"{field} is {known.get(field)} in the index and {contract.get(field)} here")
    row = known["row"]
    files = f"{path}/cells"
    if known["count"]:
        frame = spark.read.schema(f"`{row}` bigint, v array<double>, cell bigint").parquet(files).select("cell", row, "v")
    else:
        frame = spark.createDataFrame([], f"cell bigint, `{row}` bigint, v array<double>")
    return ClusteredIndex(frame, row, np.array(known["centres"], np.float64), known)


def image_faults(images: DataFrame, least_side: int = 32) -> DataFrame:
    """(path, sha256, fault) of image payloads (path, size, content): empty, not decodable, too small.

    Decoding needs the imaging library; without it only the size and known file heads are checked.
    """
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"GIF8", b"RIFF", b"BM")
        try:
            import io

            from PIL import Image
        except ImportError:
            Image = None
        for b in batches:
            out = []
            for content in b["content"]:
                data, fault = bytes(content or b""), None
                if not data:
                    fault = "empty"
                elif Image is None:
                    fault = None if data.startswith(heads) else "not decodable"
                else:
                    try:
                        with Image.open(io.BytesIO(data)) as im:
                            im.load()
                            fault = "too small" if min(im.size) < least_side else None
                    except Exception:
                        fault = "not decodable"
                out.append((hashlib.sha256(data).hexdigest(), fault))
            yield pd.DataFrame({"path": b["path"], "sha256": [o[0] for o in out], "fault": [o[1] for o in out]})

    return images.select("path", "content").mapInPandas(run, "path string, sha256 string, fault string")
