"""Text and scalar functions over the note tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge.functions import schedules, text, vectors
from noteforge.plans.base import Book, sql_nfkc
from noteforge.session import table

book = Book()
query = book.query
QUERIES = book.QUERIES
C = F.col
_TERMINAL = ", ".join(f"'{c}'" for c in text.TERMINAL)


def _terminated(x: str) -> str:
    return f"CASE WHEN {x} <> '' AND right({x}, 1) NOT IN ({_TERMINAL}) THEN {x} || '。' ELSE {x} END"


@query("f01_document_key", """SELECT doc_id, coalesce(nullif(source, ''), 'unknown') || ':' || coalesce(nullif(split, ''), 'unknown') || ':' ||
    coalesce(nullif(text_id, ''), nullif(item_id, ''), CAST(doc_id AS VARCHAR)) AS key FROM documents""")
def f01(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.document_key(C("source"), C("split"), C("text_id"), C("item_id"), F.lit(None).cast("string"), C("doc_id")).alias("key"))


@query("f02_resolved_text", """SELECT doc_id, CASE WHEN text IS NOT NULL THEN trim(text, ' ') ELSE concat_ws(' ', nullif(trim(title, ' '), ''), nullif(trim(array_to_string(tags, ' '), ' '), '')) END AS text FROM documents""")
def f02(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.resolved_text(C("text"), C("title"), F.array_join("tags", " ")).alias("text"))


@query("f03_resolved_text_loose", """SELECT doc_id, coalesce(nullif(text, ''), nullif(concat_ws(' ', nullif(title, ''), nullif(array_to_string(tags, ' '), '')), ''), ' ') AS text FROM documents""")
def f03(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", text.resolved_text_loose(C("text"), C("title"), F.array_join("tags", " ")).alias("text"))


@query("f05_prefixed_uid", "SELECT entry_id, dataset || ':' || CAST(text_id AS VARCHAR) AS uid FROM text_entries")
def f05(spark, d):
    return table(spark, d, "text_entries").select("entry_id", text.prefixed_uid(C("dataset"), C("text_id")).alias("uid"))


@query("f06_canonical_dataset", r"""SELECT n.name, CASE WHEN c LIKE '%muge%' THEN 'muge' WHEN c LIKE '%flickr%' THEN 'flickr' WHEN c LIKE '%coco%' THEN 'coco' ELSE coalesce(nullif(c, ''), 'dataset') END AS canonical
    FROM (SELECT name, regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g') AS c FROM
    (SELECT DISTINCT source AS name FROM documents UNION SELECT DISTINCT dataset FROM text_entries UNION SELECT * FROM (VALUES ('MUGE-test'), ('Flickr30k_CN'), ('coco cn'), ('--')))) n""")
def f06(spark, d):
    names = table(spark, d, "documents").select(C("source").alias("name")).union(table(spark, d, "text_entries").select("dataset")).union(spark.createDataFrame([("MUGE-test",), ("Flickr30k_CN",), ("coco cn",), ("--",)], "name string")).distinct()
    return names.select("name", text.canonical_dataset(C("name")).alias("canonical"))


@query("f07_namespaced_uid", "SELECT row_id, dataset || '::' || text_uid AS uid FROM text_embeddings")
def f07(spark, d):
    return table(spark, d, "text_embeddings").select("row_id", text.namespaced(C("dataset"), C("text_uid")).alias("uid"))


@query("f08_without_controls", r"SELECT doc_id, regexp_replace(text, '\p{C}', '', 'g') AS text FROM documents")
def f08(spark, d):
    return table(spark, d, "documents").select("doc_id", text.without_controls(C("text")).alias("text"))


@query("f09_normalized", rf"SELECT doc_id, trim(regexp_replace(regexp_replace({sql_nfkc('text')}, '\p{{C}}', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'), ' ') AS text FROM documents")
def f09(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalized(C("text")).alias("text"))


@query("f10_terminated", f"SELECT doc_id, {_terminated('text')} AS text FROM documents")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id", text.terminated(C("text")).alias("text"))


_CLEAN = rf"regexp_replace({sql_nfkc('raw_text')}, '\p{{C}}', '', 'g')"


@query("f11_restored_segments", rf"""WITH t AS (SELECT entry_id, trim({_CLEAN}, ' ') AS t FROM text_entries),
    p AS (SELECT entry_id, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[\s\p{{Z}}]{{2,}}'), lambda x: regexp_replace(x, '[\s\p{{Z}}]+', '', 'g')), lambda x: x <> ''), '，') AS t FROM t)
    SELECT entry_id, {_terminated('t')} AS text FROM p""")
def f11(spark, d):
    return table(spark, d, "text_entries").select("entry_id", text.restored_segments(C("raw_text")).alias("text"))


@query("f12_without_tags", rf"""WITH t AS (SELECT entry_id, {_CLEAN} AS t FROM text_entries),
    p AS (SELECT entry_id, array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[\s\p{{Z}}]+'), lambda x: regexp_replace(x, ':[A-Za-z]+$', '')), lambda x: x <> ''), '') AS t FROM t)
    SELECT entry_id, {_terminated('t')} AS text FROM p""")
def f12(spark, d):
    return table(spark, d, "text_entries").select("entry_id", text.without_tags(C("raw_text")).alias("text"))


_SCENE = "CASE WHEN image_id % 3 = 0 THEN 'COCO_train2014_' WHEN image_id % 3 = 1 THEN 'COCO_val2014_' ELSE 'COCO_test2014_' END || lpad(CAST(image_id AS VARCHAR), 12, '0')"


@query("f13_scene_id", f"""SELECT source_id, CASE WHEN m THEN CAST(CASE WHEN source_id LIKE 'COCO_train%' THEN '1' ELSE '2' END || right(source_id, 12) AS BIGINT) END AS image_id
    FROM (SELECT s AS source_id, regexp_full_match(s, 'COCO_(train|val)2014_[0-9]{{12}}') AS m FROM (SELECT {_SCENE} AS s FROM image_entries))""")
def f13(spark, d):
    ids = table(spark, d, "image_entries").select(F.expr(_SCENE.replace("VARCHAR", "STRING")).alias("source_id"))
    return ids.select("source_id", text.scene_id(C("source_id")).alias("image_id"))


@query("f14_clean_query", "SELECT doc_id, nullif(trim(title, ' '), '') AS query, nullif(trim(image_path, ' '), '') AS path FROM documents")
def f14(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_query(C("title")).alias("query"), text.clean_query(C("image_path")).alias("path"))


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"
_BAD = "(embedding IS NULL OR list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))))"


@query("f15_unit_vectors", f"SELECT row_id, CAST(u.i - 1 AS INTEGER) AS position, CAST(embedding[u.i] AS DOUBLE) / n AS value FROM (SELECT row_id, embedding, greatest({_NORM}, 1e-12) AS n FROM text_embeddings WHERE NOT {_BAD}), range(1, 65) u(i) WHERE u.i <= len(embedding)")
def f15(spark, d):
    v = table(spark, d, "text_embeddings").where(vectors.finite(C("embedding")))
    return v.select("row_id", F.posexplode(vectors.unit(C("embedding"))).alias("position", "value"))


@query("f16_vector_faults", f"""SELECT modality, row_id, fault FROM (SELECT 'text' AS modality, row_id, CASE WHEN embedding IS NULL THEN 'null' WHEN {_BAD} THEN 'not finite' WHEN {_NORM} <= 0 THEN 'zero' END AS fault FROM text_embeddings
    UNION ALL SELECT 'image', row_id, CASE WHEN embedding IS NULL THEN 'null' WHEN {_BAD} THEN 'not finite' WHEN {_NORM} <= 0 THEN 'zero' END FROM image_embeddings) WHERE fault IS NOT NULL""")
def f16(spark, d):
    parts = [table(spark, d, f"{m}_embeddings").select(F.lit(m).alias("modality"), "row_id", vectors.vector_fault(C("embedding")).alias("fault")) for m in ("text", "image")]
    return parts[0].unionByName(parts[1]).where("fault IS NOT NULL")


@query("f17_not_unit", f"SELECT row_id FROM image_embeddings WHERE {_BAD} OR abs({_NORM} - 1) > 2e-4")
def f17(spark, d):
    return table(spark, d, "image_embeddings").where(~vectors.is_unit(C("embedding"))).select("row_id")


@query("f18_inner_product", """SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 6) AS product
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def f18(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    w = v.select((C("vec_id") - 1).alias("vec_id"), C("vec_id").alias("b"), C("embedding").alias("other"))
    return v.join(w, "vec_id").select(C("vec_id").alias("a"), "b", F.round(vectors.dot(C("embedding"), C("other")), 6).alias("product"))


@query("f19_rounded", "SELECT event_id, round(value, 3) AS value FROM events")
def f19(spark, d):
    return table(spark, d, "events").select("event_id", text.rounded(C("value"), 3).alias("value"))


@query("f20_clock", """SELECT event_id, lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
    FROM (SELECT event_id, CAST(greatest(floor(value * 100), 0) AS BIGINT) AS s FROM events)""")
def f20(spark, d):
    return table(spark, d, "events").select("event_id", text.clock(C("value") * 100).alias("clock"))


@query("f21_digests", "SELECT entry_id, sha256(raw_text) AS sha FROM text_entries")
def f21(spark, d):
    return table(spark, d, "text_entries").select("entry_id", text.digest(C("raw_text")).alias("sha"))


@query("f22_base64", "SELECT entry_id, raw_text AS decoded FROM text_entries")
def f22(spark, d):
    sent = F.rtrim(F.translate(F.base64(F.encode("raw_text", "UTF-8")), "+/", "-_"), F.lit("="))  # as delivered: other alphabet, no padding
    return table(spark, d, "text_entries").select("entry_id", F.decode(text.from_base64(sent), "UTF-8").alias("decoded"))


@query("f23_warmup_cosine", "SELECT s AS step, round(CASE WHEN s < 50 THEN s / 50.0::DOUBLE ELSE greatest(0, 0.5 * (1 + cos(pi() * least((s - 50) / 950.0::DOUBLE, 1)))) END, 9) AS factor FROM range(1001) t(s)")
def f23(spark, d):
    return spark.range(1001).select(C("id").alias("step"), F.round(schedules.warmup_cosine(C("id"), 50, 1000), 9).alias("factor"))


@query("f24_group_sizes", "SELECT b AS batch, CAST(least(8, 1003 - b // 8 * 8) AS INTEGER) AS size, CAST(126 AS BIGINT) AS steps FROM range(1003) t(b)")
def f24(spark, d):
    return spark.range(1003).select(C("id").alias("batch"), schedules.group_size(C("id"), 1003, 8).alias("size"), schedules.optimizer_steps(F.lit(1003), F.lit(8)).alias("steps"))


@query("f25_batches", "SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 256 AS batch, doc_id FROM documents")
def f25(spark, d):
    from noteforge.operators.ordering import batched

    return batched(table(spark, d, "documents").select("source", "doc_id"), "doc_id", 256, "batch", ["source"]).select("source", "batch", "doc_id")


@query("s22_resolved_paths", "SELECT doc_id, CASE WHEN image_path LIKE '/%' THEN image_path ELSE '/data/' || image_path END AS path FROM documents")
def s22(spark, d):
    return table(spark, d, "documents").select("doc_id", text.resolved_path(C("image_path"), "/data").alias("path"))
