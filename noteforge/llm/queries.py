"""Queries of the training-data operators over the test tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.llm import copies, leaks, lookalikes, mixing, neighbours, overlap, sentences
from noteforge.session import table


def _two_tables(spark: SparkSession, d: str, entry_text: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("id"), "text")
    entries = table(spark, d, "text_entries").select(F.lit("text_entries").alias("table_name"), F.col("entry_id").alias("id"), F.col(entry_text).alias("text"))
    return docs.unionByName(entries)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_twins(_two_tables(spark, d, "raw_text"))


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_text(_two_tables(spark, d, "raw_text"), "text").select("table_name", "id", "consistent_text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "documents"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [neighbours.similar_pairs(table(spark, d, f"{m}_embeddings")).select(F.lit(m).alias("modality"), "row_id_a", "row_id_b") for m in ("text", "image")]
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_members(_two_tables(spark, d, "text"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse_copies(_two_tables(spark, d, "text"))


def _train(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("split = 'train'").select("doc_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(_train(spark, d), table(spark, d, "eval_passages")).select("doc_id", "item_id")


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_documents(leaks.leaked(_train(spark, d), table(spark, d, "eval_passages")))


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_chosen(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).chosen()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p7_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).uses()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def p1_stable(spark: SparkSession, d: str) -> DataFrame:
    """Consistent texts are consistent: read again they stay as they are."""
    t = _two_tables(spark, d, "raw_text").where("text IS NOT NULL")
    model = lookalikes.bigram_model(t)
    once = lookalikes.consistent_text(t, "text", "once", model)
    twice = lookalikes.consistent_text(once, "once", "twice", model)
    return twice.groupBy("table_name").agg(F.count("*").alias("n_texts"), F.count_if(~F.col("once").eqNullSafe(F.col("twice"))).alias("n_unstable"))


def p3_images(spark: SparkSession, d: str) -> DataFrame:
    """The part of the report that SQL can say: notes of evaluation splits whose cover image is in train."""
    return overlap.overlap_report(table(spark, d, "documents")).select("split", "source", "n_docs", "n_image")


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """No row has more neighbours than asked for; they occur once and reach the cosine that is asked for."""
    parts = []
    for m in ("text", "image"):
        n = neighbours.nearest(table(spark, d, f"{m}_embeddings"), least=0.85)
        g = n.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "neighbour_id"))).alias("l"), F.count_distinct("neighbour_id").alias("d"), F.min("cosine").alias("low"))
        parts.append(g.agg(F.count_if(F.size("l") > 5).alias("n_too_many"), F.count_if(F.col("d") != F.size("l")).alias("n_repeated"), F.count_if(F.col("low") < 0.85).alias("n_below")).select(F.lit(m).alias("modality"), "*"))
    return parts[0].unionByName(parts[1])


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The copies of all contents together are all records that take part."""
    return p5_collapsed(spark, d).groupBy("table_name").agg(F.sum("n_copies").alias("n_records"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """No note is used more than its source's cap, and every one is a note of its source."""
    caps = table(spark, d, "mix_targets").select("source", "max_repeats")
    notes = table(spark, d, "documents").select("doc_id", F.col("source").alias("own"))
    used = p7_chosen(spark, d).join(notes, "doc_id", "left").join(F.broadcast(caps), "source")
    used = used.groupBy("source").agg((F.max(F.col("repeats") - F.col("max_repeats")) <= 0).alias("cap"), F.every(F.coalesce(F.col("own") == F.col("source"), F.lit(False))).alias("known"))
    listed = notes.select(F.col("own").alias("source")).distinct().join(F.broadcast(caps), "source").join(used, "source", "left")  # sources of no use keep every rule
    return listed.select("source", F.coalesce("cap", F.lit(True)).alias("within_cap"), F.coalesce("known", F.lit(True)).alias("known_notes"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every note with a word has sentences; they lie within it, do not overlap, and begin and end without white space."""
    notes = table(spark, d, "documents").select("doc_id", "text")
    s = p8_found(spark, d).join(notes, "doc_id")
    text = F.col("text").substr(F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int"))
    outside = (F.col("start_char") < 0) | (F.col("end_char") <= F.col("start_char")) | (F.col("end_char") > F.char_length("text"))
    s = s.select("doc_id", "start_char", "end_char", outside.alias("outside"), text.rlike(r"^\s|\s$").alias("padded"))
    spans = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("l"), F.count_if("outside").alias("o"), F.count_if("padded").alias("p"))
    later = F.zip_with(F.slice("l", 1, F.size("l") - 1), F.slice("l", 2, F.size("l")), lambda a, b: b["start_char"] < a["end_char"])
    return spans.agg(F.count("*").alias("n_notes"), F.sum("o").alias("n_outside"), F.count_if((F.size("l") > 1) & F.exists(later, lambda x: x)).alias("n_overlapping"), F.sum("p").alias("n_padded"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_consistent": p1_consistent,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_collapsed": p5_collapsed,
    "p6_found": p6_found,
    "p6_documents": p6_documents,
    "p7_chosen": p7_chosen,
    "p7_shares": p7_shares,
    "p7_schedule": p7_schedule,
    "p8_found": p8_found,
    "p1_stable": p1_stable,
    "p3_images": p3_images,
    "p4_checks": p4_checks,
    "p5_records": p5_records,
    "p7_checks": p7_checks,
    "p8_checks": p8_checks,
}

ORACLE: dict[str, str] = {
    "p1_stable": "SELECT 'documents' AS table_name, count(*) AS n_texts, CAST(0 AS BIGINT) AS n_unstable FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'text_entries', count(*), CAST(0 AS BIGINT) FROM text_entries WHERE raw_text IS NOT NULL",
    "p3_images": r"""WITH d AS (SELECT split, source, nullif(regexp_replace(image_path, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS path FROM documents)
        SELECT split, source, count(*) AS n_docs, CAST(sum(CASE WHEN path IN (SELECT path FROM d WHERE split = 'train' AND path IS NOT NULL) THEN 1 ELSE 0 END) AS BIGINT) AS n_image FROM d WHERE split IN ('valid', 'test') GROUP BY 1, 2""",
    "p4_checks": "SELECT 'text' AS modality, CAST(0 AS BIGINT) AS n_too_many, CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_below UNION ALL SELECT 'image', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)",
    "p5_records": r"SELECT 'documents' AS table_name, count(*) AS n_records FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]') UNION ALL SELECT 'text_entries', count(*) FROM text_entries WHERE regexp_matches(text, '[\p{L}\p{N}]')",
    "p7_checks": "SELECT source, true AS within_cap, true AS known_notes FROM mix_targets t WHERE EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source)",
    "p8_checks": r"SELECT count(*) AS n_notes, CAST(0 AS BIGINT) AS n_outside, CAST(0 AS BIGINT) AS n_overlapping, CAST(0 AS BIGINT) AS n_padded FROM documents WHERE regexp_matches(text, '[\p{L}\p{N}]')",
}
