"""Search over documents with text and image vectors.

Tables: texts (doc_row, v), images (image_row, v), edges (doc_row, image_row), queries
(qid, modality, v) with modality `text` or `image`; vectors in unit length. Scores are
compared to 12 decimals, so equal vectors tie whatever the order of summation; ties go to
the smaller row.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteforge.functions.text import clean_query
from noteforge.functions.vectors import dot
from noteforge.session import cut, ship

#: Queries that are shipped to the tasks at once (a block of 4,096 vectors of 512 doubles is 16 MB).
BLOCK = 4_096
#: Documents whose vectors meet in one task in exhaustive scoring.
CHUNK = 20_000
#: Bytes of one matrix of scores.
STEP_BYTES = 64 << 20
PLACES = 12


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usual_length(df: DataFrame, vec_col: str) -> int | None:
    """The most frequent length of the vectors that are not empty, of equally frequent ones the larger; None without any."""
    found = df.groupBy(F.size(vec_col).alias("dim")).agg(F.count("*").alias("n")).where("dim > 0").orderBy(F.desc("n"), F.desc("dim")).first()
    return found and found["dim"]


def unit_rows(df: DataFrame, id_col: str, vec_col: str, row: str) -> DataFrame:
    """(row, v): finite, non-zero vectors in unit length, in Arrow batches.

    Null vectors, vectors with null, NaN or infinite components, zero vectors and vectors of
    another length than the most frequent one are left out.
    """
    ship(df.sparkSession)
    t = df.select(F.col(id_col).cast("bigint").alias(row), F.col(vec_col).cast("array<double>").alias("v")).where(f"`{row}` IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    dim = usual_length(t, "v")
    if dim is None:
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            with np.errstate(all="ignore"):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                n = np.sqrt((x * x).sum(axis=1))
                ok = np.isfinite(n) & (n > 0)
                x = x[ok] / n[ok, None]
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), v], names=[row, "v"])

    return t.where(F.size("v") == dim).mapInArrow(run, f"`{row}` bigint, v array<double>")


def query_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[tuple[list, np.ndarray]]:
    """(qids, matrix) of at most `block` queries each; the stated query set is read in a stream."""
    head = queries.select("qid", "v").limit(block + 1).collect()
    if len(head) <= block:  # one block, one job
        if head:
            yield [r["qid"] for r in head], np.array([r["v"] for r in head], np.float64)
        return
    ids, rows = [], []
    for r in queries.select("qid", "v").orderBy("qid").toLocalIterator():
        ids.append(r["qid"])
        rows.append(r["v"])
        if len(ids) == block:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query, ties to the smaller row."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= limit)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((rows[at], -scores[at]))][:k]


def top_k(queries: DataFrame, vectors: DataFrame, row: str, k: int, block: int = BLOCK) -> DataFrame:
    """(qid, row, score, rank): exact k best rows per query.

    Queries (qid, v) go to the vectors in blocks; every batch of vectors keeps k per query, and
    a window over those picks the final k. Queries of a dimension other than the vectors' fail.
    """
    spark = queries.sparkSession
    ship(spark)
    schema = f"qid bigint, `{row}` bigint, score double"
    source = vectors.select(F.col(row).cast("bigint").alias(row), "v")
    found: DataFrame | None = None
    for ids, q in query_blocks(queries, block):
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                every, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                step = max(k, STEP_BYTES // (8 * max(1, len(ids))))  # rows whose scores fit
                for a in range(0, len(every), step):
                    rows = every[a : a + step]
                    scores = np.round(q @ x[a : a + step].T, PLACES)
                    best = [_best(s, rows, k) for s in scores]
                    n = [len(b) for b in best]
                    at = np.concatenate(best)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(rows[at]), pa.array(scores[np.repeat(np.arange(len(ids)), n), at])], names=["qid", row, "score"])

        part = source.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), row)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k_sql(queries: DataFrame, vectors: DataFrame, row: str, k: int) -> DataFrame:
    """top_k with built-in functions only, for a query set of at most BLOCK rows (its size is checked; beyond it the other way is taken)."""
    if queries.limit(BLOCK + 1).count() > BLOCK:
        return top_k(queries, vectors, row, k)
    scored = vectors.select(row, F.col("v").alias("_v")).join(F.broadcast(queries.select("qid", "v"))).select("qid", row, F.round(dot(F.col("_v"), F.col("v")), PLACES).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), row)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_hits(hits: DataFrame, row: str) -> DataFrame:
    """Best score per query and row; negative rows (no hit) are dropped."""
    return hits.where(F.col(row) >= 0).groupBy("qid", row).agg(F.max("score").alias("score"))


def expand_to_documents(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Image hits (qid, image_row, score, rank) to owner documents; of one document's images the best score, then the earliest hit."""
    owned = hits.join(edges, "image_row")
    best = owned.groupBy("qid", "doc_row").agg(F.min_by(F.struct("image_row", "score", "rank"), F.struct(-F.col("score"), F.col("rank"))).alias("b"))
    return best.select("qid", "doc_row", "b.image_row", "b.score", "b.rank")


#: Finds the k best rows of each query: (queries (qid, v), k) -> (qid, row, score, rank), exactly or by an index.
Finder = Callable[[DataFrame, int], DataFrame]


def adaptive_candidates(queries: DataFrame, images: DataFrame, edges: DataFrame, target: int, multiplier: int = 4, find: Finder | None = None) -> DataFrame:
    """T5: (qid, doc_row) of the image route.

    Depth starts at max(target, multiplier * target) images and doubles for those queries that
    have fewer than `target` distinct documents, until the images are exhausted; all documents
    of the last depth are kept. Each level is written before the next is planned, so no scan is
    repeated. `find` replaces the exact search; where an index finds fewer than asked for, the
    images are exhausted too.
    """
    find = find or (lambda q, k: top_k(q, images, "image_row", k))
    total = images.count()
    depth = min(total, max(target, multiplier * target))
    todo, done = queries, None
    while True:
        hits = cut(find(todo, max(1, depth)).select("qid", "image_row"), "hits")
        docs = hits.join(edges, "image_row").select("qid", "doc_row").distinct()
        last = depth >= total
        if not last:
            found = docs.groupBy("qid").agg(F.count("*").alias("docs"))
            short = hits.groupBy("qid").agg(F.count("*").alias("hits")).join(found, "qid", "left").where((F.coalesce("docs", F.lit(0)) < target) & (F.col("hits") >= depth)).select("qid")
            last = short.isEmpty()
        if not last:
            todo = cut(todo.join(short, "qid", "left_semi"), "todo")
        part = docs if last else docs.join(todo.select("qid"), "qid", "left_anti")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        depth = min(total, depth * 2)


def candidates(queries: DataFrame, texts: DataFrame, images: DataFrame, edges: DataFrame, recall: int, multiplier: int = 4, find_text: Finder | None = None, find_image: Finder | None = None) -> DataFrame:
    """Distinct (qid, doc_row): text-index hits of every query vector and the adaptive image route."""
    find_text = find_text or (lambda q, k: top_k(q, texts, "doc_row", k))
    out = None
    for modality in ("text", "image"):
        q = queries.where(F.col("modality") == modality).select("qid", "v")
        part = find_text(q, recall).select("qid", "doc_row").unionByName(adaptive_candidates(q, images, edges, recall, multiplier, find_image))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _query_pairs(queries: DataFrame, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(qids in order, text matrix, image matrix, number of modalities) of at most `block` queries each; a missing vector is zero."""
    wide = queries.groupBy("qid").agg(F.max(F.when(F.col("modality") == "text", F.col("v"))).alias("t"), F.max(F.when(F.col("modality") == "image", F.col("v"))).alias("i"))

    def close(rows: list) -> tuple:
        empty = [0.0] * len(next(x for r in rows for x in (r["t"], r["i"]) if x is not None))
        matrix = [np.array([r[m] or empty for r in rows], np.float64) for m in ("t", "i")]
        return np.array([r["qid"] for r in rows], np.int64), *matrix, np.array([(r["t"] is not None) + (r["i"] is not None) for r in rows], np.float64)

    head = wide.limit(block + 1).collect()
    if len(head) <= block:  # one block, one job
        if head:
            yield close(sorted(head, key=lambda r: r["qid"]))
        return
    rows = []
    for r in wide.orderBy("qid").toLocalIterator():
        rows.append(r)
        if len(rows) == block:
            yield close(rows)
            rows = []
    if rows:
        yield close(rows)


def _scored(rows: DataFrame, block: tuple, keys: list[str]) -> DataFrame:
    """(keys, t, i, n): rounded products of row vectors with the text and image vector of their query, and its number of modalities, in Arrow batches.

    keys are bigint and begin with qid; rows of other blocks' queries are left out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qt, qi, n = shared.value
        for b in batches:
            qid = b.column(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
            if b.num_rows and not (ids[at] == qid).all():
                b = b.filter(pa.array(ids[at] == qid))
                at = at[ids[at] == qid]
            if b.num_rows:
                v = _matrix(b.column(len(keys)))
                scores = [pa.array(np.round(np.einsum("ij,ij->i", q[at], v), PLACES)) for q in (qt, qi)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), *scores, pa.array(n[at])], names=[*keys, "t", "i", "n"])

    return rows.select(*[F.col(k).cast("bigint") for k in keys], "v").mapInArrow(run, ", ".join(f"`{k}` bigint" for k in keys) + ", t double, i double, n double")


def rescored(cands: DataFrame, queries: DataFrame, texts: DataFrame, images: DataFrame, edges: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Exact scores of candidate documents (deduplicated).

    (qid, doc_row, score_tt, score_ti, score_it, score_ii, score_text_index, score_image_index,
    score_mm, best_image_row). A query without a modality has 0 there and the mean is over those
    it has; the best image has the highest mean score, ties to the smaller row. Only ids go
    through the joins with the vectors; queries are sent to them in blocks.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    spark = queries.sparkSession
    ship(spark)
    pairs = cands.select("qid", "doc_row").distinct()
    out = None
    for block in _query_pairs(queries):
        c = pairs.where(F.col("qid").between(int(block[0][0]), int(block[0][-1])))
        text_side = _scored(c.join(texts.select("doc_row", "v"), "doc_row"), block, ["qid", "doc_row"])
        image_side = _scored(c.join(edges, "doc_row").join(images.select("image_row", "v"), "image_row"), block, ["qid", "doc_row", "image_row"])
        best = image_side.groupBy("qid", "doc_row").agg(F.max("t").alias("score_ti"), F.max("i").alias("score_ii"), F.max_by("image_row", F.struct(F.round(F.col("t") + F.col("i"), PLACES), -F.col("image_row"))).alias("best_image_row"))
        part = text_side.withColumnsRenamed({"t": "score_tt", "i": "score_it"}).join(best, ["qid", "doc_row"])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "qid bigint, doc_row bigint, score_tt double, score_it double, n double, score_ti double, score_ii double, best_image_row bigint")
    out = out.withColumn("score_text_index", (F.col("score_tt") + F.col("score_it")) / F.col("n")).withColumn("score_image_index", (F.col("score_ti") + F.col("score_ii")) / F.col("n"))
    out = out.withColumn("score_mm", F.round(alpha * F.col("score_text_index") + (1 - alpha) * F.col("score_image_index"), PLACES))
    return out.select("qid", "doc_row", "score_tt", "score_ti", "score_it", "score_ii", "score_text_index", "score_image_index", "score_mm", "best_image_row")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best per query by score_mm, ties to the smaller document; none if k <= 0."""
    w = Window.partitionBy("qid").orderBy(F.desc("score_mm"), "doc_row")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, k))


def search(queries: DataFrame, texts: DataFrame, images: DataFrame, edges: DataFrame, recall: int = 100, final: int = 10, alpha: float = 0.5, find_text: Finder | None = None, find_image: Finder | None = None) -> DataFrame:
    """Candidates by index routes, exact rescoring, the `final` best of each query; all queries in one job.

    The routes are exact unless finders of an index are given (operators.encoding.open_index).
    """
    if recall <= 0:
        raise ValueError("recall must be positive")
    if final <= 0:
        raise ValueError("final must be positive")
    cands = candidates(queries, texts, images, edges, max(recall, final), find_text=find_text, find_image=find_image)
    return ranked(rescored(cands, queries, texts, images, edges, alpha), final)


def request_faults(requests: DataFrame) -> DataFrame:
    """(qid) of requests (qid, text, image) that name neither a text nor an image once both are trimmed."""
    return requests.where(clean_query(F.col("text")).isNull() & clean_query(F.col("image")).isNull()).select("qid")


def query_vectors(requests: DataFrame, text_encoder, image_encoder) -> DataFrame:
    """(qid, modality, v): the unit vectors of requests (qid, text, image); an empty request is an error.

    Texts and images are trimmed, blank ones count as missing. Encoders have `encode(values) -> matrix`.
    """
    ship(requests.sparkSession)
    empty = [r["qid"] for r in request_faults(requests).limit(5).collect()]
    if empty:
        raise ValueError(f"requests without text and image: {empty}")
    out = None
    for modality, encoder in (("text", text_encoder), ("image", image_encoder)):
        def run(batches: Iterator[pa.RecordBatch], encoder=encoder) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.asarray(encoder.encode(b.column(1).to_pylist()), np.float64)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["qid", "v"])

        asked = requests.select(F.col("qid").cast("bigint").alias("qid"), clean_query(F.col(modality)).alias("value")).where("value IS NOT NULL")
        part = unit_rows(asked.mapInArrow(run, "qid bigint, v array<double>"), "qid", "v", "qid").select("qid", F.lit(modality).alias("modality"), "v")
        out = part if out is None else out.unionByName(part)
    return out


def collected(queries: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of all queries in one job, stored, with latency_ms: the time of the job over its queries."""
    n = queries.select("qid").distinct().count()
    began = time.time()
    results = cut(run(queries), "collected")
    return results.withColumn("latency_ms", F.lit((time.time() - began) * 1000 / max(1, n)))


def with_metadata(results: DataFrame, docs: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Results with document fields and the image paths of each, joined after the ranking."""
    few = results.select("doc_row").distinct()
    lists = edges.join(few, "doc_row", "left_semi").join(paths.select("image_row", "image_path"), "image_row").groupBy("doc_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("image_row", "image_path"))), lambda x: x["image_path"]).alias("image_paths"))
    best = paths.select(F.col("image_row").alias("best_image_row"), F.col("image_path").alias("best_image_path"))
    return results.join(docs, "doc_row").join(lists, "doc_row", "left").join(best, "best_image_row", "left").withColumn("image_count", F.size("image_paths"))


def exhaustive(queries: DataFrame, texts: DataFrame, images: DataFrame, edges: DataFrame, k: int, alpha: float = 0.5, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """R2: the k best of all documents, scored exactly: (qid, doc_row, score_text_index, score_image_index, score_mm, rank).

    Vectors of a chunk of documents meet in one task, which scores them against the query
    block with matrix products and keeps k per query. A document without image counts as
    minus infinity on the image side, unless alpha is 1.
    """
    spark = queries.sparkSession
    ship(spark)
    schema = "qid bigint, doc_row bigint, score_text_index double, score_image_index double, score_mm double"
    rows = texts.select("doc_row", F.lit(-1).cast("bigint").alias("image_row"), "v").unionByName(edges.join(images, "image_row").select("doc_row", "image_row", "v"))
    rows = rows.withColumn("chunk", F.floor(F.col("doc_row") / chunk).cast("bigint"))
    rows = cut(rows, "exhaustive")
    found: DataFrame | None = None

    def part(block: tuple) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(group: pa.Table) -> pa.Table:
            ids, qt, qi, n = shared.value
            doc, image = group.column("doc_row").to_numpy(), group.column("image_row").to_numpy()
            v = _matrix(group.column("v").combine_chunks())
            order = np.lexsort((image, doc))
            doc, image, v = doc[order], image[order], v[order]
            is_text = image < 0
            docs, dv = doc[is_text], v[is_text]
            owner, iv = doc[~is_text], v[~is_text]
            has, start = np.unique(owner, return_index=True)
            at = np.searchsorted(docs, has)
            known = (at < len(docs)) & (docs[np.minimum(at, len(docs) - 1)] == has) if len(docs) else np.zeros(len(has), bool)
            out: tuple[list, ...] = ([], [], [], [], [])
            step = max(1, STEP_BYTES // (8 * max(1, len(v))))  # queries whose scores fit
            for a in range(0, len(ids) if len(docs) else 0, step):
                t, i, m = qt[a : a + step], qi[a : a + step], n[a : a + step, None]
                text_index = (np.round(t @ dv.T, PLACES) + np.round(i @ dv.T, PLACES)) / m
                image_index = np.full(text_index.shape, -np.inf)
                if len(owner):
                    both = np.maximum.reduceat(np.round(t @ iv.T, PLACES), start, axis=1) + np.maximum.reduceat(np.round(i @ iv.T, PLACES), start, axis=1)
                    image_index[:, at[known]] = (both / m)[:, known]
                mm = np.round(alpha * text_index + ((1 - alpha) * image_index if alpha < 1 else 0.0), PLACES)
                for q, s in enumerate(mm):
                    best = _best(s, docs, k)
                    for column, values in zip(out, (np.full(len(best), ids[a + q]), docs[best], text_index[q, best], image_index[q, best], s[best])):
                        column.append(values)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            return pa.table({name: pa.array(np.concatenate(c) if c else [], t) for name, c, t in zip(("qid", "doc_row", "score_text_index", "score_image_index", "score_mm"), out, kinds)})

        return rows.groupBy("chunk").applyInArrow(run, schema)

    for q in _query_pairs(queries, block):
        p = part(q)
        found = p if found is None else found.unionByName(p)
    if found is None:
        found = spark.createDataFrame([], schema)
    return ranked(found, k)


def recall_benchmark(exact: DataFrame, approximate: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(qid, recall_at_k...): share of the first k exact documents among the first k approximate ones.

    A query with fewer than k of either is an error there; here its recall is null.
    """
    both = exact.select("qid", "doc_row", F.col("rank").alias("r1")).join(approximate.select("qid", "doc_row", F.col("rank").alias("r2")), ["qid", "doc_row"], "full")
    cols = []
    for k in ks:
        hits = F.count_if((F.col("r1") <= k) & (F.col("r2") <= k))
        full = (F.count_if(F.col("r1") <= k) == k) & (F.count_if(F.col("r2") <= k) == k)
        cols.append(F.when(full, hits / F.lit(float(k))).alias(f"recall_at_{k}"))
    return both.groupBy("qid").agg(*cols)


def weighted_batches(batches: DataFrame) -> DataFrame:
    """Batches (mode, sample_size, recall_at_5, recall_at_10) to a mean per mode weighted by size, and the plain mean of the modes as `overall`."""
    per = batches.groupBy("mode").agg(*[(F.sum(F.col(c) * F.col("sample_size")) / F.sum("sample_size")).alias(c) for c in ("recall_at_5", "recall_at_10")])
    return per.unionByName(per.agg(F.avg("recall_at_5").alias("recall_at_5"), F.avg("recall_at_10").alias("recall_at_10")).select(F.lit("overall").alias("mode"), "recall_at_5", "recall_at_10"))
