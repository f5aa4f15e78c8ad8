"""Retrieval over the note corpus: queries are all notes whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge.operators import retrieval as R
from noteforge.plans.base import Book
from noteforge.plans.corpus import IMAGE_SQL, RELATION_SQL, TEXT_SQL, bundle, index
from noteforge.session import cut, table

book = Book()
query = book.query
QUERIES = book.QUERIES
C = F.col


def corpus(spark, d):
    """texts, images, edges of documents that have a usable text vector and a usable image (corpus.bundle)."""
    return bundle(spark, d)


def query_vectors(texts, images, edges, modes=("text", "image")):
    """Own text vector, and the vector of the lowest image, of notes with id divisible by 100."""
    t = texts.where("doc_row % 100 = 0").select(C("doc_row").alias("qid"), F.lit("text").alias("modality"), "v")
    low = edges.where("doc_row % 100 = 0").groupBy(C("doc_row").alias("qid")).agg(F.min("image_row").alias("image_row"))
    i = low.join(images, "image_row").select("qid", F.lit("image").alias("modality"), "v")
    return cut(t.unionByName(i).where(C("modality").isin(*modes)), "queries")


_BASE = f"""{TEXT_SQL}, {IMAGE_SQL}, {RELATION_SQL},
    edges AS MATERIALIZED (SELECT r.doc_row, r.image_row FROM relation r WHERE doc_row IN (SELECT doc_row FROM text_vec) AND image_row IN (SELECT image_row FROM image_vec)),
    texts AS (SELECT * FROM text_vec WHERE doc_row IN (SELECT doc_row FROM edges)), images AS (SELECT * FROM image_vec WHERE image_row IN (SELECT image_row FROM edges)),
    qt AS (SELECT doc_row AS qid, v FROM texts WHERE doc_row % 100 = 0),
    qi AS (SELECT e.qid, i.v FROM (SELECT doc_row AS qid, min(image_row) AS image_row FROM edges WHERE doc_row % 100 = 0 GROUP BY 1) e JOIN images i ON i.image_row = e.image_row)"""


def _dots(q: str, side: str, row: str) -> str:
    return f"(SELECT qid, {row}, round(list_dot_product({q}.v, {side}.v), 12) AS score FROM {q}, {side})"


def _adaptive(q: str, target: int, name: str) -> str:
    start = f"least((SELECT count(*) FROM images), {4 * target})"
    return f"""{name}_r AS (SELECT qid, image_row, row_number() OVER (PARTITION BY qid ORDER BY score DESC, image_row) AS rank FROM {_dots(q, 'images', 'image_row')}),
    {name}_f AS (SELECT qid, doc_row, min(rank) AS first FROM {name}_r JOIN edges USING (image_row) GROUP BY 1, 2),
    {name}_n AS (SELECT qid, CASE WHEN count(*) < {target} THEN (SELECT count(*) FROM images) ELSE list_sort(list(first))[{target}] END AS need FROM {name}_f GROUP BY 1),
    {name} AS (SELECT f.qid, f.doc_row FROM {name}_f f JOIN {name}_n n ON n.qid = f.qid WHERE first <= least((SELECT count(*) FROM images), {start} * power(2, greatest(0, ceil(log2(need / CAST({start} AS DOUBLE)))))))"""


def _cands(mode: str, recall: int) -> str:
    parts, ctes = [], []
    for m, q in (("text", "qt"), ("image", "qi")):
        if mode in (m, "joint"):
            ctes.append(_adaptive(q, recall, f"ad_{m}"))
            parts += [f"SELECT qid, doc_row FROM ad_{m}", f"SELECT qid, doc_row FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_row) AS r FROM {_dots(q, 'texts', 'doc_row')}) WHERE r <= {recall}"]
    return ", ".join(ctes) + ", cands AS (" + " UNION ".join(parts) + ")"


def _scores(mode: str, cands: str, alpha: float = 0.5) -> str:
    t, i = mode in ("text", "joint"), mode in ("image", "joint")
    n = t + i
    ft = "round(list_dot_product(qt.v, {v}), 12)" if t else "0.0::DOUBLE"
    fi = "round(list_dot_product(qi.v, {v}), 12)" if i else "0.0::DOUBLE"
    join = (" JOIN qt ON qt.qid = c.qid" if t else "") + (" JOIN qi ON qi.qid = c.qid" if i else "")
    return f"""ts AS (SELECT c.qid, c.doc_row, {ft.format(v='x.v')} AS tt, {fi.format(v='x.v')} AS it FROM {cands} c JOIN texts x ON x.doc_row = c.doc_row{join}),
    im AS (SELECT c.qid, c.doc_row, e.image_row, {ft.format(v='y.v')} AS ti, {fi.format(v='y.v')} AS ii FROM {cands} c JOIN edges e ON e.doc_row = c.doc_row JOIN images y ON y.image_row = e.image_row{join}),
    b AS (SELECT qid, doc_row, max(ti) AS ti, max(ii) AS ii, (list(image_row ORDER BY round(ti + ii, 12) DESC, image_row))[1] AS best_image_row FROM im GROUP BY 1, 2),
    s AS (SELECT ts.qid, ts.doc_row, tt, ti, it, ii, (tt + it) / {n} AS text_index, (ti + ii) / {n} AS image_index, round({alpha} * ((tt + it) / {n}) + {1 - alpha} * ((ti + ii) / {n}), 12) AS mm, best_image_row FROM ts JOIN b ON b.qid = ts.qid AND b.doc_row = ts.doc_row),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY mm DESC, doc_row) AS INTEGER) AS rank FROM s)"""


_OUT = "qid, rank, doc_row, round(tt, 6) AS score_tt, round(ti, 6) AS score_ti, round(it, 6) AS score_it, round(ii, 6) AS score_ii, round(mm, 6) AS score_mm, best_image_row"


def _shown(df):
    return df.select("qid", "rank", "doc_row", *[F.round(f"score_{s}", 6).alias(f"score_{s}") for s in ("tt", "ti", "it", "ii", "mm")], "best_image_row")


RECALL = 20


def _search(mode):
    modes = ("text", "image") if mode == "joint" else (mode,)

    def run(spark, d):
        texts, images, edges = corpus(spark, d)
        return _shown(R.search(query_vectors(texts, images, edges, modes), texts, images, edges, RECALL, 10))

    return run


for _mode in ("text", "image", "joint"):
    query(f"r3_search_{_mode}", f"WITH {_BASE}, {_cands(_mode, RECALL)}, {_scores(_mode, 'cands')} SELECT {_OUT} FROM ranked WHERE rank <= 10")(_search(_mode))


@query("r1_rescored", f"WITH {_BASE}, {_cands('joint', 5)}, {_scores('joint', 'cands', 0.3)} SELECT {_OUT} FROM ranked")
def r1(spark, d):
    texts, images, edges = corpus(spark, d)
    q = query_vectors(texts, images, edges)
    return _shown(R.ranked(R.rescored(R.candidates(q, texts, images, edges, 5), q, texts, images, edges, 0.3), 1 << 30))


_ALL = "cands AS (SELECT q.qid, t.doc_row FROM qt q, texts t)"


@query("r2_exhaustive", f"WITH {_BASE}, {_ALL}, {_scores('joint', 'cands')} SELECT qid, rank, doc_row, round(text_index, 6) AS score_text_index, round(image_index, 6) AS score_image_index, round(mm, 6) AS score_mm FROM ranked WHERE rank <= 10")
def r2(spark, d):
    texts, images, edges = corpus(spark, d)
    out = R.exhaustive(query_vectors(texts, images, edges), texts, images, edges, 10)
    return out.select("qid", "rank", "doc_row", *[F.round(c, 6).alias(c) for c in ("score_text_index", "score_image_index", "score_mm")])


@query("r5_candidates", f"WITH {_BASE}, {_cands('joint', 10)} SELECT qid, doc_row FROM cands")
def r5(spark, d):
    texts, images, edges = corpus(spark, d)
    return R.candidates(query_vectors(texts, images, edges), texts, images, edges, 10)


@query("t5_adaptive", f"WITH {_BASE}, {_adaptive('qt', 40, 'ad')} SELECT qid, doc_row FROM ad")
def t5(spark, d):
    texts, images, edges = corpus(spark, d)
    return R.adaptive_candidates(query_vectors(texts, images, edges, ("text",)), images, edges, 40)


@query("t3_top_k", f"WITH {_BASE} SELECT qid, rank, doc_row, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_row) AS INTEGER) AS rank FROM {_dots('qt', 'texts', 'doc_row')}) WHERE rank <= 10")
def t3(spark, d):
    texts, images, edges = corpus(spark, d)
    return R.top_k(query_vectors(texts, images, edges, ("text",)), texts, "doc_row", 10).select("qid", "rank", "doc_row", F.round("score", 6).alias("score"))


@query("t2_top_k_builtin", f"WITH {_BASE} SELECT qid, rank, image_row, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, image_row) AS INTEGER) AS rank FROM {_dots('qt', 'images', 'image_row')}) WHERE rank <= 5")
def t2(spark, d):
    texts, images, edges = corpus(spark, d)
    return R.top_k_sql(query_vectors(texts, images, edges, ("text",)), images, "image_row", 5).select("qid", "rank", "image_row", F.round("score", 6).alias("score"))


_HITS = f"hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, image_row) AS rank FROM {_dots('qt', 'images', 'image_row')}) WHERE rank <= 50)"


@query("j01_expanded", f"WITH {_BASE}, {_HITS} SELECT qid, doc_row, (list(image_row ORDER BY score DESC, rank))[1] AS image_row, round(max(score), 6) AS score FROM hits JOIN edges USING (image_row) GROUP BY 1, 2")
def j01(spark, d):
    texts, images, edges = corpus(spark, d)
    hits = R.top_k(query_vectors(texts, images, edges, ("text",)), images, "image_row", 50)
    return R.expand_to_documents(hits, edges).select("qid", "doc_row", "image_row", F.round("score", 6).alias("score"))


@query("a03_best_hits", f"WITH {_BASE}, {_HITS} SELECT qid, doc_row, round(max(score), 6) AS score FROM hits JOIN edges USING (image_row) WHERE doc_row % 10 <> 3 GROUP BY 1, 2")
def a03(spark, d):
    texts, images, edges = corpus(spark, d)
    hits = R.top_k(query_vectors(texts, images, edges, ("text",)), images, "image_row", 50).join(edges, "image_row")
    hits = hits.withColumn("doc_row", F.when(C("doc_row") % 10 == 3, -1).otherwise(C("doc_row")))  # -1: no hit
    return R.best_hits(hits, "doc_row").select("qid", "doc_row", F.round("score", 6).alias("score"))


@query("j03_with_metadata", f"""WITH {_BASE}, {_cands('text', RECALL)}, {_scores('text', 'cands')}, p AS (SELECT image_row_id AS image_row, image_path FROM image_assets)
    SELECT qid, rank, r.doc_row, doc_key, title, bp.image_path AS best_image_path, l.image_paths, CAST(len(l.image_paths) AS INTEGER) AS image_count FROM ranked r JOIN documents d ON d.doc_id = r.doc_row
    JOIN (SELECT doc_row, list(image_path ORDER BY image_row) AS image_paths FROM edges JOIN p USING (image_row) GROUP BY 1) l ON l.doc_row = r.doc_row JOIN p bp ON bp.image_row = r.best_image_row WHERE rank <= 10""")
def j03(spark, d):
    texts, images, edges = corpus(spark, d)
    res = R.search(query_vectors(texts, images, edges, ("text",)), texts, images, edges, RECALL, 10)
    docs = table(spark, d, "documents").select(C("doc_id").alias("doc_row"), "doc_key", "title")
    paths = table(spark, d, "image_assets").select(C("image_row_id").alias("image_row"), "image_path")
    return R.with_metadata(res, docs, edges, paths).select("qid", "rank", "doc_row", "doc_key", "title", "best_image_path", "image_paths", "image_count")


@query("r6_recall", f"""WITH {_BASE}, {_cands('joint', RECALL)}, {_scores('joint', 'cands')},
    {_scores('joint', '(SELECT q.qid, t.doc_row FROM qt q, texts t)').replace('ts AS', 'ts2 AS').replace('im AS', 'im2 AS').replace('b AS (SELECT', 'b2 AS (SELECT').replace(' s AS (', ' s2 AS (').replace('ranked AS', 'ranked2 AS').replace('FROM im GROUP', 'FROM im2 GROUP').replace('FROM ts JOIN b ON b.qid = ts.qid AND b.doc_row = ts.doc_row', 'FROM ts2 ts JOIN b2 b ON b.qid = ts.qid AND b.doc_row = ts.doc_row').replace('FROM s)', 'FROM s2)')}
    SELECT a.qid, sum(CASE WHEN a.rank <= 5 AND r.rank <= 5 THEN 1 ELSE 0 END) / 5.0::DOUBLE AS recall_at_5, sum(CASE WHEN a.rank <= 10 AND r.rank <= 10 THEN 1 ELSE 0 END) / 10.0::DOUBLE AS recall_at_10
    FROM ranked2 a LEFT JOIN ranked r ON r.qid = a.qid AND r.doc_row = a.doc_row WHERE a.rank <= 10 GROUP BY 1""")
def r6(spark, d):
    texts, images, edges = corpus(spark, d)
    q = query_vectors(texts, images, edges)
    return R.recall_benchmark(R.exhaustive(q, texts, images, edges, 10), R.search(q, texts, images, edges, RECALL, 10))


def _recall_sql(mode: str) -> str:
    """Recall of one mode's search against all documents' scores; each ranking is a subquery with its own tables."""
    every = f"(SELECT q.qid, t.doc_row FROM {'qi' if mode == 'image' else 'qt'} q, texts t)"
    found, exact = (f"(WITH {w} SELECT qid, doc_row, rank FROM ranked WHERE rank <= 10)" for w in (f"{_cands(mode, RECALL)}, {_scores(mode, 'cands')}", _scores(mode, every)))
    return f"""SELECT '{mode}' AS mode, a.qid, sum(CASE WHEN a.rank <= 5 AND r.rank <= 5 THEN 1 ELSE 0 END) / 5.0::DOUBLE AS recall_at_5, sum(CASE WHEN r.rank <= 10 THEN 1 ELSE 0 END) / 10.0::DOUBLE AS recall_at_10
    FROM {exact} a LEFT JOIN {found} r ON r.qid = a.qid AND r.doc_row = a.doc_row GROUP BY a.qid"""


_MODES = ("text", "image", "joint")


@query("r6_recall_modes", f"WITH {_BASE} " + " UNION ALL ".join(_recall_sql(m) for m in _MODES))
def r6_modes(spark, d):
    texts, images, edges = corpus(spark, d)
    q = query_vectors(texts, images, edges)
    parts = []
    for mode in _MODES:
        own = q if mode == "joint" else q.where(C("modality") == mode)
        found = R.recall_benchmark(R.exhaustive(own, texts, images, edges, 10), R.search(own, texts, images, edges, RECALL, 10))
        parts.append(cut(found.select(F.lit(mode).alias("mode"), "qid", "recall_at_5", "recall_at_10"), "recall"))  # one plan at a time in the driver
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("t4_all_cells", f"WITH {_BASE} SELECT qid, rank, image_row, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, image_row) AS INTEGER) AS rank FROM {_dots('qi', 'images', 'image_row')}) WHERE rank <= 10")
def t4_all_cells(spark, d):
    """The written index with all its cells probed is exact."""
    texts, images, edges = corpus(spark, d)
    found = index(spark, d, "image").find(1 << 30)(query_vectors(texts, images, edges, ("image",)), 10)
    return found.select("qid", "rank", "image_row", F.round("score", 6).alias("score"))


@query("r3_index_search")
def r3_index(spark, d):
    """Joint search through the written indexes, half of the cells probed."""
    texts, images, edges = corpus(spark, d)
    by_text, by_image = index(spark, d, "text"), index(spark, d, "image")
    q = query_vectors(texts, images, edges)
    return _shown(R.search(q, texts, images, edges, RECALL, 10, find_text=by_text.find(len(by_text.centres) // 2 + 1), find_image=by_image.find(len(by_image.centres) // 2 + 1)))


@query("r6_index_recall")
def r6_index(spark, d):
    """Recall at 5 and 10 of each mode's search through the indexes against exact search."""
    texts, images, edges = corpus(spark, d)
    q = query_vectors(texts, images, edges)
    finders = {f"find_{m}": (lambda i: i.find(len(i.centres) // 2 + 1))(index(spark, d, m)) for m in ("text", "image")}
    parts = []
    for mode in _MODES:
        own = q if mode == "joint" else q.where(C("modality") == mode)
        found = R.recall_benchmark(R.search(own, texts, images, edges, RECALL, 10), R.search(own, texts, images, edges, RECALL, 10, **finders))
        parts.append(cut(found.select(F.lit(mode).alias("mode"), "qid", "recall_at_5", "recall_at_10"), "recall"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("r4_collected", f"WITH {_BASE}, {_cands('text', RECALL)}, {_scores('text', 'cands')} SELECT qid, count(*) AS n_results, true AS timed FROM ranked WHERE rank <= 10 GROUP BY 1")
def r4(spark, d):
    """All queries in one job, with its time per query."""
    texts, images, edges = corpus(spark, d)
    got = R.collected(query_vectors(texts, images, edges, ("text",)), lambda q: R.search(q, texts, images, edges, RECALL, 10))
    return got.groupBy("qid").agg(F.count("*").alias("n_results"), (F.min("latency_ms") > 0).alias("timed"))


@query("k13_gallery", f"""WITH {_BASE}, {_cands('text', RECALL)}, {_scores('text', 'cands')}, p AS (SELECT image_row_id AS image_row, image_path FROM image_assets)
    SELECT qid, rank, r.doc_row, CAST(row_number() OVER (PARTITION BY qid, r.doc_row ORDER BY image_row) - 1 AS INTEGER) AS position, image_path, printf('#%d %.4f', rank, round(mm, 4)) AS caption FROM ranked r JOIN edges e ON e.doc_row = r.doc_row JOIN p USING (image_row) WHERE rank <= 10""")
def k13_gallery(spark, d):
    from noteforge.operators.evaluation import gallery

    texts, images, edges = corpus(spark, d)
    res = R.search(query_vectors(texts, images, edges, ("text",)), texts, images, edges, RECALL, 10)
    docs = table(spark, d, "documents").select(C("doc_id").alias("doc_row"), "doc_key")
    return gallery(R.with_metadata(res, docs, edges, table(spark, d, "image_assets").select(C("image_row_id").alias("image_row"), "image_path")))


@query("a21_weighted_batches", """WITH b AS (SELECT event_type AS mode, user_id AS sample_size, value AS r5, value / 2 AS r10 FROM events), p AS (SELECT mode, sum(r5 * sample_size) / sum(sample_size) AS r5, sum(r10 * sample_size) / sum(sample_size) AS r10 FROM b GROUP BY 1)
    SELECT mode, round(r5, 6) AS recall_at_5, round(r10, 6) AS recall_at_10 FROM (SELECT * FROM p UNION ALL SELECT 'overall', avg(r5), avg(r10) FROM p)""")
def a21(spark, d):
    b = table(spark, d, "events").select(C("event_type").alias("mode"), C("user_id").alias("sample_size"), C("value").alias("recall_at_5"), (C("value") / 2).alias("recall_at_10"))
    return R.weighted_batches(b).select("mode", F.round("recall_at_5", 6).alias("recall_at_5"), F.round("recall_at_10", 6).alias("recall_at_10"))
