"""Streaming folds, extraction and the clustered index over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge.operators import encoding, retrieval
from noteforge.plans.base import Book
from noteforge.plans.retrieval_queries import corpus
from noteforge.session import cut, scratch, table
from noteforge.streaming import progress

book = Book()
query = book.query
QUERIES = book.QUERIES
C = F.col


def _events(spark, d):
    value = F.when(C("event_id") % 4 == 0, None).otherwise(C("value").cast("decimal(20,4)").cast("string"))
    return table(spark, d, "events").select("user_id", C("event_id").alias("seq"), C("event_type").alias("event"), F.create_map(F.concat(F.lit("k"), C("event_id") % 3), value).alias("values"))


_ITEMS = """WITH i AS (SELECT user_id, event_id AS seq, 'k' || event_id % 3 AS key, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(20, 4)) AS VARCHAR) END AS value FROM events
    UNION ALL SELECT user_id, event_id, 'last_event', event_type FROM events)"""


@query("t02_snapshot", f"{_ITEMS} SELECT user_id, key, seq, value FROM i QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY seq DESC) = 1")
def t02(spark, d):
    return progress.folded(_events(spark, d), ["user_id"])


@query("t02_merged_snapshots", f"{_ITEMS} SELECT user_id, key, seq, value FROM i QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY seq DESC) = 1")
def t02_merged(spark, d):
    e = _events(spark, d)
    return progress.merged(progress.folded(e.where("seq % 2 = 0"), ["user_id"]), progress.folded(e.where("seq % 2 = 1"), ["user_id"]), ["user_id"])


@query("t02_streamed_snapshot", """WITH i AS (SELECT event_id AS seq, 'k' || event_id % 3 AS key, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(CAST(value AS DECIMAL(20, 4)) AS VARCHAR) END AS value FROM events
    UNION ALL SELECT event_id, 'last_event', event_type FROM events) SELECT key, seq, value FROM i QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1""")
def t02_streamed(spark, d):
    """The events as two deliveries of files, folded by a stream run twice from its checkpoint."""
    root = scratch(spark, "stream")
    e = _events(spark, d).drop("user_id")
    for part in (0, 1):
        e.where(C("seq") % 2 == part).write.mode("append").option("ignoreNullFields", "false").json(f"{root}/in")
        progress.keep_snapshot(spark, f"{root}/in", f"{root}/snapshot", f"{root}/checkpoint").awaitTermination()
    return progress.newest(spark, f"{root}/snapshot").select("key", "seq", "value")


@query("x1_windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x1(spark, d):
    return progress.windowed_counts(table(spark, d, "events"), "ts", "event_type").withColumn("total", F.round("total", 4))


@query("r8_extraction")
def r8(spark, d):
    return encoding.extract(table(spark, d, "text_entries"), "entry_id", "text", encoding.HashEncoder())


@query("t4_probed_recall")
def t4(spark, d):
    """Recall of the clustered index at 10 for notes with id divisible by 100, against exact search."""
    texts, images, edges = corpus(spark, d)
    q = cut(texts.where("doc_row % 100 = 0").select(C("doc_row").alias("qid"), "v"), "qs")
    centres = encoding.fit_cells(images, 64)
    approx = encoding.probe(q, encoding.indexed(images, "image_row", centres), "image_row", centres, 10, 32)
    exact = retrieval.top_k(q, images, "image_row", 10)
    both = exact.select("qid", "image_row").join(approx.select("qid", "image_row", F.lit(1).alias("hit")), ["qid", "image_row"], "left")
    return both.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall_at_10"))
