"""Metrics of labelled candidates and of retrieval."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.session import cut

TASKS = [("muge", "text_to_image"), ("flickr", "text_to_image"), ("flickr", "image_to_text"), ("coco", "text_to_image"), ("coco", "image_to_text")]


def label_faults(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, fault) of rows whose label is missing, no integer, or outside 0, 1, 2."""
    n = F.expr(f"try_cast({label} AS INT)")
    raw = F.col(label).cast("string")
    fault = F.when(raw.isNull() | (F.trim(raw) == ""), "missing").when(n.isNull(), "not an integer").when(~n.isin(0, 1, 2), "out of range")
    return df.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def bad_case(rank: Column, label: Column) -> Column:
    """what is wrong with a labelled result at a rank; null if nothing."""
    return F.when(label == 0, "false_positive").when((rank <= 5) & (label == 1), "weak_top_rank").when((rank > 5) & (label == 2), "relevant_ranked_low")


def _precision(labels: Column, k: int) -> Column:
    """Labels of 1 or more among the first k, over k even if there are fewer rows."""
    return F.size(F.filter(F.slice(labels, 1, k), lambda x: x >= 1)) / F.lit(float(k))


def _dcg(labels: Column) -> Column:
    """A10: sum of (2^label - 1) / log2(position + 1)."""
    return F.aggregate(F.transform(labels, lambda x, i: (F.pow(F.lit(2.0), x) - 1) / F.log2((i + 2).cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _ndcg(labels: Column, k: int) -> Column:
    """A10: against the best order of the same first k labels; 0 if that is 0."""
    top = F.slice(labels, 1, k)
    ideal = _dcg(F.sort_array(top, asc=False))
    return F.when(ideal > 0, _dcg(top) / ideal).otherwise(0.0)


def query_metrics(rows: DataFrame, query: str = "query_id", position: str = "position", label: str = "label", latency: str = "latency_ms") -> DataFrame:
    """Per query count, precision and NDCG at 5 and 10 (over the first rows by position), mean latency.

    Only the first ten rows of a query are gathered; counts and latency are plain aggregates,
    so a query of any size is fine. Missing latency counts 0.
    """
    w = Window.partitionBy(query).orderBy(position)
    top = rows.select(query, position, label).withColumn("_r", F.row_number().over(w)).where("_r <= 10")
    labels = top.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(label).cast("int").alias("l")))), lambda x: x["l"]).alias("_l"))
    rest = rows.groupBy(query).agg(F.count("*").alias("count"), F.avg(F.coalesce(F.col(latency), F.lit(0.0))).alias("avg_latency_ms"))
    m = [f(F.col("_l"), k).alias(f"{name}_at_{k}") for name, f in (("precision", _precision), ("ndcg", _ndcg)) for k in (5, 10)]
    return rest.join(labels, query).select(query, "count", *m, "avg_latency_ms")


def nearest_rank(df: DataFrame, value: str, ratio: float) -> DataFrame:
    """The value at ceil(ratio * n) of the sorted values; 0 if there is none (one row). Null values do not count.

    Equal values are counted first and the counts laid out in ranges of the value; the driver
    sees one sum a range, and one range is numbered. Runs when it is called.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counted = cut(counted.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()), "ranks")
    sums = sorted((r["_p"], r["n"]) for r in counted.groupBy("_p").agg(F.sum("_n").alias("n")).collect())
    wanted = max(1, math.ceil(round(ratio * sum(n for _, n in sums), 9)))
    for part, n in sums:
        if wanted <= n:
            upto = F.sum("_n").over(Window.partitionBy("_p").orderBy("_v"))
            return counted.where(F.col("_p") == part).withColumn("_upto", upto).where(F.col("_upto") >= wanted).agg(F.min("_v").alias("value"))
        wanted -= n
    return df.sparkSession.createDataFrame([(0.0,)], "value double")


def macro_metrics(per_query: DataFrame) -> DataFrame:
    """One row: number of queries and rows, means of the metrics (0 without queries), p95 of the mean latencies."""
    p95 = nearest_rank(per_query, "avg_latency_ms", 0.95).first()["value"]
    names = ["precision_at_5", "precision_at_10", "ndcg_at_5", "ndcg_at_10", "avg_latency_ms"]
    return per_query.agg(
        F.count("*").alias("num_queries"), F.coalesce(F.sum("count"), F.lit(0)).alias("num_results"), *[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names],
        F.lit(float(p95)).alias("p95_latency_ms"),
    )


def bad_cases(rows: DataFrame, query: str = "query_id", rank: str = "position", label: str = "label") -> DataFrame:
    """Candidate rows with their bad case type."""
    return rows.withColumn("bad_case_type", bad_case(F.col(rank), F.col(label))).where("bad_case_type IS NOT NULL")


def bad_queries(per_query: DataFrame, cases: DataFrame, threshold: float = 0.85, query: str = "query_id") -> DataFrame:
    """Queries below full precision or the NDCG threshold, with counts per type and a verdict code."""
    kinds = ["false_positive", "weak_top_rank", "relevant_ranked_low"]
    n = cases.groupBy(query).agg(F.count("*").alias("bad_case_count"), *[F.count_if(F.col("bad_case_type") == k).alias(f"{k}_count") for k in kinds])
    joined = per_query.join(n, query, "left").fillna(0, ["bad_case_count", *[f"{k}_count" for k in kinds]])
    verdict = F.when(F.col("precision_at_5") < 1, "head_noise").when(F.col("precision_at_10") < 1, "tail_noise").when(F.col("ndcg_at_10") < threshold, "order").when(F.col("bad_case_count") > 0, "local").otherwise("none")
    return joined.withColumn("verdict", verdict).where((F.col("precision_at_5") < 1) | (F.col("precision_at_10") < 1) | (F.col("ndcg_at_10") < threshold))


def recall_at_k(rankings: DataFrame, answers: DataFrame, queries: DataFrame, pool: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: list[str] | None = None) -> DataFrame:
    """Multi-positive recall per group `by`.

    rankings (by, qid, cand, rank), answers (by, qid, cand), queries (by, qid), pool (by, cand).
    A query counts if one of its answers is in the pool; it is hit at k if the best rank of an
    answer is at most k. Groups without such queries have null recalls. Repeated or
    non-positive ks are dropped.
    """
    by = by or []
    ks = tuple(sorted({int(k) for k in ks if int(k) > 0}))
    if not ks:
        raise ValueError("ks needs a positive integer")
    known = answers.select(*by, "qid", "cand").distinct().join(pool.select(*by, "cand").distinct(), [*by, "cand"], "left_semi")
    hits = rankings.join(known, [*by, "qid", "cand"], "left_semi").groupBy(*by, "qid").agg(F.min("rank").alias("_best"))
    state = queries.select(*by, "qid").distinct().join(known.select(*by, "qid").distinct().withColumn("_has", F.lit(1)), [*by, "qid"], "left").join(hits, [*by, "qid"], "left")
    cols = [F.avg(F.when(F.col("_has") == 1, F.when(F.col("_best") <= k, 1.0).otherwise(0.0))).alias(f"recall_at_{k}") for k in ks]
    g = state.groupBy(*by).agg(F.count("_has").alias("num_queries"), F.count_if(F.col("_has").isNull()).alias("num_queries_without_answers"), *cols)
    return g.withColumn("mean_recall", reduce(lambda a, b: a + b, [F.col(f"recall_at_{k}") for k in ks]) / len(ks))


def dataset_means(per_direction: DataFrame) -> DataFrame:
    """(dataset, dataset_mean_recall) over the directions that were scored."""
    return per_direction.groupBy("dataset").agg(F.avg("mean_recall").alias("dataset_mean_recall"))


def macro_mean(per_direction: DataFrame) -> DataFrame:
    """One row: mean over the five tasks, null unless all five are scored."""
    wanted = reduce(lambda a, b: a | b, [(F.col("dataset") == n) & (F.col("direction") == x) for n, x in TASKS])
    scored = per_direction.where(wanted & F.col("mean_recall").isNotNull())
    return scored.agg(F.count("*").alias("scored_tasks"), F.when(F.count("*") == len(TASKS), F.avg("mean_recall")).alias("five_task_macro_mean"))


def acceptance(candidate: DataFrame, baseline: DataFrame, macros: tuple[float | None, float | None], max_drop: float = 0.02, demo: tuple[float, float, float, float] | None = None, max_ndcg_drop: float = 0.01, max_latency_increase: float = 0.1) -> DataFrame:
    """One row of gates from (dataset, t2i_r1, dataset_mean) of both sides.

    Core: the macro mean rises, text-to-image R@1 rises in at least two of the three datasets,
    and no dataset mean drops by more than max_drop. Deployment also needs the demo figures
    (candidate ndcg, baseline ndcg, candidate latency, baseline latency) and that they hold.
    """
    names = candidate.sparkSession.createDataFrame([("muge",), ("flickr",), ("coco",)], "dataset string")
    c = candidate.select("dataset", F.col("t2i_r1").alias("c1"), F.col("dataset_mean").alias("cm"))
    b = baseline.select("dataset", F.col("t2i_r1").alias("b1"), F.col("dataset_mean").alias("bm"))
    all3 = names.join(c, "dataset", "left").join(b, "dataset", "left")
    dropped = F.coalesce(F.col("bm") - F.col("cm") <= max_drop + 1e-12, F.lit(False))
    cm, bm = macros
    g = all3.agg(F.count_if(F.col("c1") > F.col("b1")).alias("t2i_r1_improved"), F.count_if(dropped).alias("drops_passed"))
    macro = cm is not None and bm is not None and cm > bm
    core = F.lit(macro) & (F.col("t2i_r1_improved") >= 2) & (F.col("drops_passed") == 3)
    held = demo is not None and demo[0] >= demo[1] - max_ndcg_drop and demo[2] <= demo[3] * (1 + max_latency_increase)
    return g.select(F.lit(macro).alias("macro_improved"), "t2i_r1_improved", "drops_passed", core.alias("core_passed"), F.lit(demo is not None).alias("demo_provided"), (core & F.lit(held)).alias("deployment_passed"))


def submission(rankings: DataFrame, k: int = 10) -> DataFrame:
    """(text_id, image_ids): per text the first k image ids in order, without their source prefix."""
    def bare(c: str) -> Column:
        return F.regexp_replace(c, r"(?s)^[^:]*:", "")

    top = rankings.where(F.col("rank") <= k).select(bare("text_uid").alias("text_id"), "rank", bare("image_uid").alias("image"))
    return top.groupBy("text_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "image"))), lambda x: x["image"]).alias("image_ids"))


def gallery(results: DataFrame, paths: str = "image_paths") -> DataFrame:
    """(qid, rank, doc_row, position, image_path, caption): a row per image of a result, in order, with the score to 4 places."""
    caption = F.format_string("#%d %.4f", F.col("rank"), F.round("score_mm", 4))
    return results.select("qid", "rank", "doc_row", F.posexplode(paths).alias("position", "image_path"), caption.alias("caption"))


def result_lines(results: DataFrame) -> DataFrame:
    """(qid, line): results as text rows, scores to 4 places."""
    return results.select("qid", F.format_string("%d. doc %d score %.4f", F.col("rank"), F.col("doc_row"), F.round("score_mm", 4)).alias("line"))


def list_overlap(exact: Column, found: Column, k: int) -> Column:
    """Share of the first k of one list among the first k of the other; null if either is shorter."""
    full = (F.size(exact) >= k) & (F.size(found) >= k)
    return F.when(full, F.size(F.array_intersect(F.slice(exact, 1, k), F.slice(found, 1, k))) / F.lit(float(k)))


def ranked_rows(df: DataFrame, query: str, score: str, tie: str) -> DataFrame:
    """Df with its 1-based rank within the query, best score first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), tie)))
