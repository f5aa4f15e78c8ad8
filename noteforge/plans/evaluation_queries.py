"""Metrics, samplers and losses over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge.functions.vectors import dot
from noteforge.operators import evaluation as E
from noteforge.operators import losses, retrieval, sampling
from noteforge.plans.base import Book
from noteforge.plans.retrieval_queries import _BASE, corpus
from noteforge.session import cut, table

book = Book()
query = book.query
QUERIES = book.QUERIES
C = F.col


def labelled(spark, d):
    """Labelled results: one query per user, its events in order, a label by rule, the value as latency."""
    return table(spark, d, "events").select(C("user_id").alias("query_id"), C("event_id").alias("position"), (C("event_id") * 7 % 10 % 3).cast("int").alias("label"), C("value").alias("latency_ms"))


_LAB = "lab AS (SELECT user_id AS query_id, event_id AS position, CAST(event_id * 7 % 10 % 3 AS INTEGER) AS label, value AS latency_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events)"


def _gain(k: int, order: str) -> str:
    return f"(SELECT query_id, sum((power(2, label) - 1) / log2(p + 1)) AS g FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS p FROM lab WHERE pos <= {k}) GROUP BY 1)"


_METRICS = f"""{_LAB}, met AS (SELECT m.query_id, m.count, m.p5 AS precision_at_5, m.p10 AS precision_at_10, CASE WHEN i5.g > 0 THEN a5.g / i5.g ELSE 0 END AS ndcg_at_5, CASE WHEN i10.g > 0 THEN a10.g / i10.g ELSE 0 END AS ndcg_at_10, m.l AS avg_latency_ms FROM
    (SELECT query_id, count(*) AS count, sum(CASE WHEN pos <= 5 AND label >= 1 THEN 1 ELSE 0 END) / 5.0::DOUBLE AS p5, sum(CASE WHEN pos <= 10 AND label >= 1 THEN 1 ELSE 0 END) / 10.0::DOUBLE AS p10, avg(coalesce(latency_ms, 0)) AS l FROM lab GROUP BY 1) m
    JOIN {_gain(5, 'pos')} a5 USING (query_id) JOIN {_gain(5, 'label DESC')} i5 USING (query_id) JOIN {_gain(10, 'pos')} a10 USING (query_id) JOIN {_gain(10, 'label DESC')} i10 USING (query_id))"""


def _six(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


_M = ("precision_at_5", "precision_at_10", "ndcg_at_5", "ndcg_at_10", "avg_latency_ms", "p95_latency_ms")


@query("a15_query_metrics", f"WITH {_METRICS} SELECT query_id, count, round(precision_at_5, 6) AS precision_at_5, round(precision_at_10, 6) AS precision_at_10, round(ndcg_at_5, 6) AS ndcg_at_5, round(ndcg_at_10, 6) AS ndcg_at_10, round(avg_latency_ms, 6) AS avg_latency_ms FROM met")
def a15(spark, d):
    return _six(E.query_metrics(labelled(spark, d)), *_M)


@query("a15_macro_metrics", f"""WITH {_METRICS} SELECT count(*) AS num_queries, CAST(sum(count) AS BIGINT) AS num_results, round(avg(precision_at_5), 6) AS precision_at_5, round(avg(precision_at_10), 6) AS precision_at_10, round(avg(ndcg_at_5), 6) AS ndcg_at_5, round(avg(ndcg_at_10), 6) AS ndcg_at_10,
    round(avg(avg_latency_ms), 6) AS avg_latency_ms, round((list_sort(list(avg_latency_ms)))[CAST(ceil(0.95 * count(*)) AS INTEGER)], 6) AS p95_latency_ms FROM met""")
def a15_macro(spark, d):
    return _six(E.macro_metrics(E.query_metrics(labelled(spark, d))), *_M)


@query("a12_nearest_rank", "SELECT quantile_disc(value, 0.95) AS value FROM events")
def a12(spark, d):
    return E.nearest_rank(table(spark, d, "events"), "value", 0.95)


_CASE = "CASE WHEN label = 0 THEN 'false_positive' WHEN pos <= 5 AND label = 1 THEN 'weak_top_rank' WHEN pos > 5 AND label = 2 THEN 'relevant_ranked_low' END"


def _ranked(spark, d):
    from pyspark.sql import Window

    rows = labelled(spark, d)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))


@query("f26_bad_cases", f"WITH {_LAB} SELECT query_id, position, CAST(pos AS INTEGER) AS rank, {_CASE} AS bad_case_type FROM lab WHERE {_CASE} IS NOT NULL")
def f26(spark, d):
    return E.bad_cases(_ranked(spark, d), rank="rank").select("query_id", "position", "rank", "bad_case_type")


@query("a16_bad_queries", f"""WITH {_METRICS}, c AS (SELECT query_id, {_CASE} AS t FROM lab), n AS (SELECT query_id, count(*) AS b, count(*) FILTER (t = 'false_positive') AS f, count(*) FILTER (t = 'weak_top_rank') AS w, count(*) FILTER (t = 'relevant_ranked_low') AS r FROM c WHERE t IS NOT NULL GROUP BY 1)
    SELECT query_id, coalesce(b, 0) AS bad_case_count, coalesce(f, 0) AS false_positive_count, coalesce(w, 0) AS weak_top_rank_count, coalesce(r, 0) AS relevant_ranked_low_count,
    CASE WHEN precision_at_5 < 1 THEN 'head_noise' WHEN precision_at_10 < 1 THEN 'tail_noise' WHEN ndcg_at_10 < 0.85 THEN 'order' WHEN coalesce(b, 0) > 0 THEN 'local' ELSE 'none' END AS verdict
    FROM met LEFT JOIN n USING (query_id) WHERE precision_at_5 < 1 OR precision_at_10 < 1 OR ndcg_at_10 < 0.85""")
def a16(spark, d):
    rows = _ranked(spark, d)
    out = E.bad_queries(E.query_metrics(rows), E.bad_cases(rows, rank="rank"))
    return out.select("query_id", "bad_case_count", "false_positive_count", "weak_top_rank_count", "relevant_ranked_low_count", "verdict")


@query("f28_label_faults", "SELECT event_id, CASE WHEN l IS NULL THEN 'missing' WHEN TRY_CAST(l AS INTEGER) IS NULL THEN 'not an integer' ELSE 'out of range' END AS fault FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN event_type ELSE CAST(event_id % 5 AS VARCHAR) END AS l FROM events) WHERE l IS NULL OR TRY_CAST(l AS INTEGER) IS NULL OR TRY_CAST(l AS INTEGER) NOT IN (0, 1, 2)")
def f28(spark, d):
    n = C("event_id") % 9
    t = table(spark, d, "events").select("event_id", F.when(n == 0, None).when(n == 1, C("event_type")).otherwise((C("event_id") % 5).cast("string")).alias("l"))
    return E.label_faults(t, "event_id", "l")


_NAMES = "['muge', 'flickr', 'coco']"


def _bundle(spark, d, merged=False):
    """Rankings, answers, queries and pools of three datasets (notes and images by id modulo 3), both directions."""
    texts, images, edges = corpus(spark, d)
    names = F.array(*[F.lit(n) for n in ("muge", "flickr", "coco")])
    name = lambda c: F.element_at(names, (C(c) % 3 + 1).cast("int"))
    t, i = texts.withColumn("dataset", name("doc_row")), images.withColumn("dataset", name("image_row"))
    answers = edges.where("doc_row % 3 = image_row % 3").withColumn("dataset", name("doc_row"))
    out = []
    for direction, q, qrow, c, crow in (("text_to_image", t, "doc_row", i, "image_row"), ("image_to_text", i, "image_row", t, "doc_row")):
        for n in ("muge", "flickr", "coco"):
            if n == "muge" and direction == "image_to_text":
                continue
            qs = cut(q.where((C("dataset") == n) & (C(qrow) % 50 == 0)).select(C(qrow).alias("qid"), "v"), "qs")
            pool = c if merged else c.where(C("dataset") == n)
            r = retrieval.top_k(qs, pool, crow, 10).select(F.lit(n).alias("dataset"), F.lit(direction).alias("direction"), "qid", C(crow).alias("cand"), "rank")
            tag = lambda df: df.select(F.lit(n).alias("dataset"), F.lit(direction).alias("direction"), *df.columns)
            out.append((r, tag(answers.where(C("dataset") == n).select(C(qrow).alias("qid"), C(crow).alias("cand"))), tag(qs.select("qid")), tag(pool.select(C(crow).alias("cand")))))
    return [retrieval_union(x) for x in zip(*out)]


def retrieval_union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _bundle_sql(merged: bool) -> str:
    rank = lambda q, qr, s, r, lo: f"""SELECT {_NAMES}[q.{qr} % 3 + 1] AS dataset, '{lo}' AS direction, q.{qr} AS qid, c.{r} AS cand, row_number() OVER (PARTITION BY q.{qr} ORDER BY round(list_dot_product(q.v, c.v), 12) DESC, c.{r}) AS rank
      FROM {q} q, {s} c WHERE q.{qr} % 50 = 0 {'' if merged else f'AND q.{qr} % 3 = c.{r} % 3'}{" AND q." + qr + " % 3 <> 0" if lo == 'image_to_text' else ''}"""  # noqa: E731
    return f"""{_BASE}, rk AS ({rank('texts', 'doc_row', 'images', 'image_row', 'text_to_image')} UNION ALL {rank('images', 'image_row', 'texts', 'doc_row', 'image_to_text')}),
    ans AS (SELECT 'text_to_image' AS direction, doc_row AS qid, image_row AS cand FROM edges WHERE doc_row % 3 = image_row % 3 UNION ALL SELECT 'image_to_text', image_row, doc_row FROM edges WHERE doc_row % 3 = image_row % 3),
    st AS (SELECT q.dataset, q.direction, q.qid, bool_or(a.cand IS NOT NULL) AS has, min(CASE WHEN a.cand IS NOT NULL THEN rank END) AS best FROM rk q LEFT JOIN ans a ON a.direction = q.direction AND a.qid = q.qid AND a.cand = q.cand GROUP BY 1, 2, 3),
    rec AS (SELECT dataset, direction, count(*) FILTER (has) AS num_queries, count(*) FILTER (NOT has) AS num_queries_without_answers, avg(CASE WHEN best <= 1 THEN 1.0::DOUBLE ELSE 0 END) FILTER (has) AS recall_at_1, avg(CASE WHEN best <= 5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (has) AS recall_at_5,
      avg(CASE WHEN best <= 10 THEN 1.0::DOUBLE ELSE 0 END) FILTER (has) AS recall_at_10 FROM st GROUP BY 1, 2), res AS (SELECT *, (recall_at_1 + recall_at_5 + recall_at_10) / 3 AS mean_recall FROM rec)"""


_R = ("recall_at_1", "recall_at_5", "recall_at_10", "mean_recall")
_RES = "SELECT dataset, direction, num_queries, num_queries_without_answers, round(recall_at_1, 6) AS recall_at_1, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10, round(mean_recall, 6) AS mean_recall FROM res"


def _recalls(spark, d, merged=False):
    return E.recall_at_k(*_bundle(spark, d, merged), by=["dataset", "direction"])


@query("a17_recall_at_k", f"WITH {_bundle_sql(False)} {_RES}")
def a17(spark, d):
    return _six(_recalls(spark, d), *_R)


@query("a20_merged_pool", f"WITH {_bundle_sql(True)} {_RES}")
def a20(spark, d):
    return _six(_recalls(spark, d, True), *_R)


@query("a19_dataset_means", f"WITH {_bundle_sql(False)} SELECT dataset, round(avg(mean_recall), 6) AS dataset_mean_recall FROM res GROUP BY 1")
def a19(spark, d):
    return _six(E.dataset_means(_recalls(spark, d)), "dataset_mean_recall")


@query("a19_macro_mean", f"WITH {_bundle_sql(False)} SELECT count(mean_recall) AS scored_tasks, round(CASE WHEN count(mean_recall) = 5 THEN avg(mean_recall) END, 6) AS five_task_macro_mean FROM res")
def a19_macro(spark, d):
    return _six(E.macro_mean(_recalls(spark, d)), "five_task_macro_mean")


@query("v7_acceptance", """WITH s AS (SELECT CASE source WHEN 'reedbank_diary' THEN 'muge' WHEN 'tidewater_goods' THEN 'flickr' WHEN 'paperboat_notes' THEN 'coco' END AS dataset, avg(n_chars) AS m, median(n_chars) AS r FROM documents GROUP BY 1),
    t AS (SELECT dataset, r / 1000 AS c1, r / 1010 AS b1, m / 1000 AS cm, m / 995 AS bm FROM s WHERE dataset IS NOT NULL)
    SELECT true AS macro_improved, count(*) FILTER (c1 > b1) AS t2i_r1_improved, count(*) FILTER (bm - cm <= 0.02 + 1e-12) AS drops_passed, count(*) FILTER (c1 > b1) >= 2 AND count(*) FILTER (bm - cm <= 0.02 + 1e-12) = 3 AS core_passed, true AS demo_provided, count(*) FILTER (c1 > b1) >= 2 AND count(*) FILTER (bm - cm <= 0.02 + 1e-12) = 3 AS deployment_passed FROM t""")
def v7(spark, d):
    name = F.when(C("source") == "reedbank_diary", "muge").when(C("source") == "tidewater_goods", "flickr").when(C("source") == "paperboat_notes", "coco")
    s = table(spark, d, "documents").groupBy(name.alias("dataset")).agg(F.avg("n_chars").alias("m"), F.median("n_chars").alias("r")).where("dataset IS NOT NULL")
    cand = s.select("dataset", (C("r") / 1000).alias("t2i_r1"), (C("m") / 1000).alias("dataset_mean"))
    base = s.select("dataset", (C("r") / 1010).alias("t2i_r1"), (C("m") / 995).alias("dataset_mean"))
    return E.acceptance(cand, base, (0.86, 0.78), demo=(0.9, 0.905, 104.0, 100.0))


@query("k10_submission", f"WITH {_BASE} SELECT CAST(qid AS VARCHAR) AS text_id, list(CAST(image_row AS VARCHAR) ORDER BY r) AS image_ids FROM (SELECT qt.qid, i.image_row, row_number() OVER (PARTITION BY qt.qid ORDER BY round(list_dot_product(qt.v, i.v), 12) DESC, i.image_row) AS r FROM qt, images i) WHERE r <= 10 GROUP BY 1")
def k10(spark, d):
    texts, images, _ = corpus(spark, d)
    q = cut(texts.where("doc_row % 100 = 0").select(C("doc_row").alias("qid"), "v"), "qs")
    r = retrieval.top_k(q, images, "image_row", 10)
    return E.submission(r.select(F.concat(F.lit("muge:"), "qid").alias("text_uid"), F.concat(F.lit("muge:"), "image_row").alias("image_uid"), "rank"))


@query("k13_result_lines", "SELECT user_id AS qid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS VARCHAR) || '. doc ' || event_id || ' score ' || printf('%.4f', round(value, 4)) AS line FROM events")
def k13(spark, d):
    from pyspark.sql import Window

    t = table(spark, d, "events").select(C("user_id").alias("qid"), C("event_id").alias("doc_row"), C("value").alias("score_mm"))
    return E.result_lines(t.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score_mm"), "doc_row"))))


@query("t6_seeded_sample")
def t6(spark, d):
    """A sample of 100 notes: the size is the feature."""
    return sampling.seeded_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100, 7, 50)


_ALLOC = """c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT source, n, sqrt(n) / sum(sqrt(n)) OVER () AS p FROM c), x AS (SELECT *, floor(p * 20000) AS b, round(p * 20000 - floor(p * 20000), 9) AS f FROM w),
    a AS (SELECT source, n, p, CAST(b + CASE WHEN row_number() OVER (ORDER BY f DESC, source) <= 20000 - sum(b) OVER () THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM x)"""


@query("w08_allocation", f"WITH {_ALLOC} SELECT source, n, round(p, 9) AS p, allocated FROM a")
def w08(spark, d):
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sampling.allocate(sizes, "source", "n", 20000).withColumn("p", F.round("p", 9))


@query("t8_balanced_counts", f"WITH {_ALLOC} SELECT source, allocated AS n_rows, least(n, allocated) AS n_distinct, CAST(ceil(allocated / n) AS BIGINT) AS n_passes FROM a WHERE allocated > 0")
def t8_counts(spark, d):
    e = sampling.balanced_epoch(table(spark, d, "documents"), "source", "doc_id", 20000, 3)
    return e.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_distinct"), (F.max("pass") + 1).alias("n_passes"))


@query("t8_balanced_epoch")
def t8(spark, d):
    return sampling.balanced_epoch(table(spark, d, "documents"), "source", "doc_id", 20000, 3)


@query("w07_best_so_far", """WITH t AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events),
    i AS (SELECT *, coalesce(value > best_before OR (best_before IS NULL AND value IS NOT NULL), false) AS improved FROM t), g AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM i),
    b AS (SELECT *, CAST(sum(CASE WHEN improved THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bad_steps FROM g)
    SELECT user_id, event_id, value, best_before, improved, bad_steps, bad_steps >= 5 AS stop FROM b""")
def w07(spark, d):
    return sampling.best_so_far(table(spark, d, "events"), "user_id", "event_id", "value", 5)


def _batch(spark, d):
    """Batches of 32 labelled vectors each as texts and images; related if the labels are the same."""
    v = table(spark, d, "embeddings").select(F.floor(C("vec_id") / 32).alias("batch"), "vec_id", "label", "embedding")
    t = v.select("batch", C("vec_id").alias("text_uid"), C("label").alias("tl"), C("embedding").alias("te"))
    i = v.select("batch", C("vec_id").alias("image_uid"), C("label").alias("il"), C("embedding").alias("ie"))
    edges = t.join(i, (t["batch"] == i["batch"]) & (t["tl"] == i["il"])).where("(text_uid + image_uid) % 2 = 0").select("text_uid", "image_uid")
    return t, i, edges


_BATCH = "b AS (SELECT a.vec_id // 32 AS batch, a.vec_id AS text_uid, c.vec_id AS image_uid, a.label = c.label AND (a.vec_id + c.vec_id) % 2 = 0 AS positive, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) * 14.285714 AS logit FROM embeddings a JOIN embeddings c ON a.vec_id // 32 = c.vec_id // 32)"


@query("j08_positive_mask", f"WITH {_BATCH} SELECT batch, text_uid, image_uid, positive FROM b")
def j08(spark, d):
    t, i, edges = _batch(spark, d)
    return losses.positive_mask(t, i, edges)


@query("j09_bare_anchors", f"WITH {_BATCH}, m AS (SELECT batch, text_uid, image_uid, positive AND text_uid % 3 <> 0 AS p FROM b) SELECT batch, 'text' AS axis, text_uid AS uid FROM m GROUP BY 1, 3 HAVING NOT bool_or(p) UNION ALL SELECT batch, 'image', image_uid FROM m GROUP BY 1, 3 HAVING NOT bool_or(p)")
def j09(spark, d):
    t, i, edges = _batch(spark, d)
    return losses.bare_anchors(losses.positive_mask(t, i, edges.where("text_uid % 3 <> 0")))


def _logits(spark, d):
    t, i, edges = _batch(spark, d)
    mask = losses.positive_mask(t, i, edges)
    return mask.join(t.select("text_uid", "te"), "text_uid").join(i.select("image_uid", "ie"), "image_uid").select("batch", "text_uid", "image_uid", "positive", (dot(C("te"), C("ie")) * 14.285714).alias("logit"))


_LOSS = "(SELECT batch, {a}, ln(sum(exp(logit))) - ln(sum(exp(logit)) FILTER (positive)) AS loss FROM b GROUP BY 1, 2 HAVING bool_or(positive))"


@query("a28_multi_positive_loss", f"WITH {_BATCH} SELECT batch, text_uid, round(loss, 6) AS loss FROM {_LOSS.format(a='text_uid')}")
def a28(spark, d):
    return _six(losses.multi_positive_loss(_logits(spark, d), "text_uid", ["batch"], strict=False), "loss")


@query("a29_symmetric_loss", f"""WITH {_BATCH}, t AS (SELECT batch, avg(loss) AS l FROM {_LOSS.format(a='text_uid')} GROUP BY 1), i AS (SELECT batch, avg(loss) AS l FROM {_LOSS.format(a='image_uid')} GROUP BY 1)
    SELECT t.batch, round(t.l, 6) AS text_loss, round(i.l, 6) AS image_loss, round((t.l + i.l) / 2, 6) AS loss FROM t JOIN i ON t.batch = i.batch""")
def a29(spark, d):
    return _six(losses.symmetric_loss(_logits(spark, d), strict=False), "text_loss", "image_loss", "loss")


@query("a30_parameter_counts", "WITH p AS (SELECT source AS \"group\", CAST(sum(n_chars) AS BIGINT) AS parameters, CAST(sum(CASE WHEN split = 'train' THEN n_chars ELSE 0 END) AS BIGINT) AS trainable FROM documents GROUP BY 1), q AS (SELECT * FROM p UNION ALL SELECT 'all', CAST(sum(parameters) AS BIGINT), CAST(sum(trainable) AS BIGINT) FROM p) SELECT \"group\", parameters, trainable, round(trainable * 100.0::DOUBLE / parameters, 6) AS percent FROM q")
def a30(spark, d):
    p = table(spark, d, "documents").select(C("source").alias("group"), C("n_chars").alias("numel"), (C("split") == "train").alias("trainable"))
    return _six(losses.parameter_counts(p), "percent")


@query("w01_ranks", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank FROM events")
def w01(spark, d):
    return E.ranked_rows(table(spark, d, "events"), "user_id", "value", "event_id").select("user_id", "event_id", "rank")


@query("a18_list_overlap", """WITH l AS (SELECT dataset, list(DISTINCT image_id ORDER BY image_id) AS a FROM image_entries GROUP BY 1), t AS (SELECT dataset, list(DISTINCT image_id ORDER BY image_id) AS b FROM text_entries WHERE image_id IS NOT NULL GROUP BY 1)
    SELECT l.dataset, CASE WHEN len(a) >= 20 AND len(b) >= 20 THEN len(list_intersect(a[1:20], b[1:20])) / 20.0::DOUBLE END AS overlap FROM l JOIN t ON t.dataset = l.dataset""")
def a18(spark, d):
    from pyspark.sql import Window

    def first(name):
        t = table(spark, d, name).where("image_id IS NOT NULL").select("dataset", "image_id").distinct()
        t = t.withColumn("r", F.row_number().over(Window.partitionBy("dataset").orderBy("image_id"))).where("r <= 20")  # the first k are the feature
        return t.groupBy("dataset").agg(F.array_sort(F.collect_list("image_id")).alias(name))

    return first("image_entries").join(first("text_entries"), "dataset").select("dataset", E.list_overlap(C("image_entries"), C("text_entries"), 20).alias("overlap"))


@query("t9_latest", "SELECT dataset, image_id, path FROM image_entries WHERE sha256 IS NOT NULL ORDER BY loaded_at DESC, path DESC LIMIT 1")
def t9(spark, d):
    return sampling.latest(table(spark, d, "image_entries").where("sha256 IS NOT NULL"), "loaded_at", "path").select("dataset", "image_id", "path")
