"""Document model, relations, sources and set operations over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge.operators import sets
from noteforge.operators import documents as D
from noteforge.operators.ordering import dense_ids, running
from noteforge.plans.base import Book
from noteforge.plans.corpus import PAIRS_SQL, RELATION_SQL, pairs, relation
from noteforge.session import table

book = Book()
query = book.query
QUERIES = book.QUERIES
C = F.col

_DOCS = "docs AS (SELECT row_number() OVER (ORDER BY o) - 1 AS doc_row, * FROM (SELECT doc_key, min(ordinal) AS o, arg_min(text, ordinal) AS text, arg_min(source, ordinal) AS source, arg_min(split, ordinal) AS split FROM good GROUP BY 1))"
_IMAGES = "images AS (SELECT row_number() OVER (ORDER BY o) - 1 AS image_row, * FROM (SELECT image_path, min(ordinal) AS o, (list(image_id ORDER BY ordinal))[1] AS image_id FROM good GROUP BY 1))"
_WITH = f"WITH {PAIRS_SQL}, {_DOCS}, {_IMAGES}"


@query("a01_documents", f"{_WITH} SELECT doc_row, doc_key, text, source, split FROM docs")
def a01_documents(spark, d):
    return D.documents_of(pairs(spark, d)).drop("first_ordinal")


@query("a01_images", f"{_WITH} SELECT image_row, image_path, image_id FROM images")
def a01_images(spark, d):
    return D.images_of(pairs(spark, d)).drop("first_ordinal")


@query("a01_relation", f"{_WITH} SELECT DISTINCT doc_row, image_row FROM good JOIN docs USING (doc_key) JOIN images USING (image_path)")
def a01_relation(spark, d):
    return D.relation_of(pairs(spark, d)).drop("first_ordinal")


@query("a01_text_conflicts", f"WITH {PAIRS_SQL} SELECT doc_key FROM good GROUP BY doc_key HAVING count(DISTINCT text) > 1")
def a01_text_conflicts(spark, d):
    return D.text_conflicts(pairs(spark, d))


@query("a01_item_lists", f"WITH {PAIRS_SQL} SELECT doc_key, list(item_id ORDER BY o) AS item_ids FROM (SELECT doc_key, item_id, min(ordinal) AS o FROM good WHERE item_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def a01_item_lists(spark, d):
    return D.item_lists(pairs(spark, d))


@query("a01_pair_faults", "SELECT doc_id AS ordinal, CASE WHEN doc_key IS NULL THEN 'no key' WHEN coalesce(trim(text, ' '), '') = '' THEN 'no text' ELSE 'no image' END AS fault FROM documents WHERE doc_key IS NULL OR coalesce(trim(text, ' '), '') = '' OR coalesce(trim(image_path, ' '), '') = ''")
def a01_pair_faults(spark, d):
    return D.pair_faults(pairs(spark, d))


@query("j11_pair_rows", f"{_WITH} SELECT ordinal, doc_row, image_row FROM good JOIN docs USING (doc_key) JOIN images USING (image_path)")
def j11_pair_rows(spark, d):
    return D.pair_rows(pairs(spark, d))


def _listed(spark, d):
    """Documents with an image list in which paths repeat: the owner's images, forwards and again."""
    assets = table(spark, d, "image_assets").select("image_row_id", "image_id", "image_path", F.explode(F.array_distinct("doc_row_ids")).alias("ordinal")).where("ordinal IS NOT NULL")
    images = assets.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("image_row_id", "image_id", "image_path"))).alias("l"))
    images = images.select("ordinal", F.transform(F.concat("l", "l"), lambda x: F.struct(x["image_id"].alias("image_id"), x["image_path"].alias("image_path"))).alias("images"))
    return images.join(table(spark, d, "documents").select(C("doc_id").alias("ordinal"), "doc_key"), "ordinal")


_LISTED = """listed AS (SELECT x.doc AS ordinal, d.doc_key, a.image_row_id AS r, a.image_id, a.image_path FROM (SELECT DISTINCT image_row_id, u.doc AS doc FROM image_assets, unnest(doc_row_ids) AS u(doc)) x
    JOIN image_assets a ON a.image_row_id = x.image_row_id JOIN documents d ON d.doc_id = x.doc),
    firsts AS (SELECT ordinal, doc_key, image_path, min(r) AS r, arg_min(coalesce(image_id, '~'), r) AS image_id FROM listed WHERE trim(image_path, ' ') <> '' GROUP BY ALL)"""


@query("a02_normalized_documents", f"""WITH {_LISTED}, ids AS (SELECT ordinal, row_number() OVER (ORDER BY ordinal) - 1 AS doc_row FROM (SELECT DISTINCT ordinal FROM listed))
    SELECT doc_row, doc_key, CAST(row_number() OVER (PARTITION BY ordinal ORDER BY r) - 1 AS INTEGER) AS position, nullif(image_id, '~') AS image_id, image_path FROM firsts JOIN ids USING (ordinal)""")
def a02_normalized_documents(spark, d):
    return D.normalized_documents(_listed(spark, d))


@query("f04_kept_images", f"WITH {_LISTED} SELECT doc_key, ordinal, count(*) AS n_images FROM firsts GROUP BY ALL")
def f04_kept_images(spark, d):
    return _listed(spark, d).select("doc_key", "ordinal", F.size(D.kept_images(C("images"))).cast("bigint").alias("n_images")).where("n_images > 0")


@query("a07_image_lists", f"WITH {RELATION_SQL} SELECT doc_row, list(image_row ORDER BY image_row) AS image_rows FROM relation GROUP BY 1")
def a07_image_lists(spark, d):
    return D.image_lists(relation(spark, d))


@query("a07_without_images", f"WITH {RELATION_SQL} SELECT doc_id AS doc_row FROM documents WHERE doc_id NOT IN (SELECT doc_row FROM relation)")
def a07_without_images(spark, d):
    return D.without_images(table(spark, d, "documents").select(C("doc_id").alias("doc_row")), relation(spark, d))


def _edges(spark, d):
    return table(spark, d, "text_entries").where("image_id IS NOT NULL").select("dataset", F.concat_ws(":", "dataset", "text_id").alias("text_uid"), F.concat_ws(":", "dataset", "image_id").alias("image_uid"))


_EDGES = "edges AS (SELECT DISTINCT concat_ws(':', dataset, text_id) AS text_uid, concat_ws(':', dataset, image_id) AS image_uid FROM text_entries WHERE image_id IS NOT NULL)"


@query("a08_both_ways", f"WITH {_EDGES} SELECT text_uid AS uid, image_uid AS other, 'text' AS direction FROM edges UNION ALL SELECT image_uid, text_uid, 'image' FROM edges")
def a08_both_ways(spark, d):
    e = _edges(spark, d)
    parts = [e.where(C("dataset") == n).drop("dataset") for n in ("harborseg", "canvasline", "stalltitle")]
    return D.both_ways(D.merged_relations(parts))


@query("a22_counters", "SELECT dataset, split, count(*) AS n_texts, count(DISTINCT image_id) AS n_images, CAST(sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty FROM text_entries GROUP BY 1, 2")
def a22_counters(spark, d):
    return D.counters(table(spark, d, "text_entries"), ["dataset", "split"])


@query("a23_header", f"{_WITH} SELECT 2 AS schema_version, (SELECT count(*) FROM docs) AS document_count, (SELECT count(*) FROM images) AS image_count, (SELECT count(*) FROM (SELECT DISTINCT doc_key, image_path FROM good)) AS relation_count")
def a23_header(spark, d):
    p = pairs(spark, d)
    return D.header(D.documents_of(p), D.images_of(p), D.relation_of(p))


_LINES = "SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"text\":' || coalesce('\"' || sha256(text) || '\"', 'null') || '}' AS line FROM documents"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"text":'), F.coalesce(F.concat(F.lit('"'), F.sha2("text", 256), F.lit('"')), F.lit("null")), F.lit("}")).alias("line"))


@query("a24_manifest_hash", f"""WITH l0 AS (SELECT doc_id AS o, sha256(line) AS h FROM ({_LINES})),
    l1 AS (SELECT o // 4096 AS o, sha256(string_agg(h, '' ORDER BY o)) AS h FROM l0 GROUP BY o // 4096), l2 AS (SELECT o // 4096 AS o, sha256(string_agg(h, '' ORDER BY o)) AS h FROM l1 GROUP BY o // 4096),
    l3 AS (SELECT o // 4096 AS o, sha256(string_agg(h, '' ORDER BY o)) AS h FROM l2 GROUP BY o // 4096) SELECT sha256(string_agg(h, '' ORDER BY o)) AS manifest_hash FROM l3 GROUP BY o // 4096""")
def a24_manifest_hash(spark, d):
    return D.manifest_hash(_lines(spark, d), "doc_id", "line")


@query("a24_ordered_hash", f"SELECT sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS manifest_hash FROM ({_LINES})")
def a24_ordered_hash(spark, d):
    """The hash as defined: all canonical lines in order."""
    return D.ordered_hash(_lines(spark, d), "doc_id", "line")


@query("k02_byte_offsets", f"SELECT doc_id, CAST(coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"begin\", size FROM (SELECT doc_id, CAST(octet_length(encode(line)) + 1 AS BIGINT) AS size FROM ({_LINES}))")
def k02_byte_offsets(spark, d):
    return D.byte_offsets(_lines(spark, d), "doc_id", C("line"))


_OFFSETS = "offsets AS (SELECT image_row, CAST(sum(n) OVER (ORDER BY image_row) - n AS BIGINT) AS b, CAST(sum(n) OVER (ORDER BY image_row) AS BIGINT) AS e FROM (SELECT image_row, count(*) AS n FROM relation GROUP BY 1))"


@query("k03_compressed_rows", f"WITH {RELATION_SQL}, {_OFFSETS} SELECT image_row, b AS \"begin\", e AS \"end\" FROM offsets")
def k03_compressed_rows(spark, d):
    return D.compressed_rows(relation(spark, d), "image_row", "doc_row")


@query("s16_expanded_rows", f"WITH {RELATION_SQL}, {_OFFSETS} SELECT image_row, unnest(range(b, e)) AS \"at\" FROM offsets")
def s16_expanded_rows(spark, d):
    return D.expanded_rows(D.compressed_rows(relation(spark, d), "image_row", "doc_row"), "image_row")


@query("s14_random_rows", "SELECT doc_id, text FROM documents WHERE doc_id % 100 = 0 OR doc_id = (SELECT max(doc_id) FROM documents)")
def s14_random_rows(spark, d):
    from noteforge.sources.rows import rows_at

    docs = table(spark, d, "documents").select("doc_id", "text")
    wanted = docs.where("doc_id % 100 = 0").select("doc_id")
    return docs.join(wanted, "doc_id", "left_semi").union(rows_at(docs, "doc_id", [-1])).distinct()


@query("s15_owner_rows", "SELECT image_row_id, list_sort(list_distinct(doc_row_ids)) AS docs FROM image_assets WHERE image_row_id % 100 = 0")
def s15_owner_rows(spark, d):
    from noteforge.sources.rows import grouped_rows

    edges = table(spark, d, "image_assets").select(C("image_row_id"), F.explode_outer("doc_row_ids").alias("doc"))
    return grouped_rows(edges, "image_row_id", "doc", "docs").where("image_row_id % 100 = 0")


@query("s15_row_lookup", """WITH m AS (SELECT max(image_row_id) + 1 AS n FROM image_assets) SELECT DISTINCT image_row_id, u.x AS doc FROM image_assets, unnest(doc_row_ids) AS u(x), m
    WHERE u.x IS NOT NULL AND (image_row_id IN (5, n - 1, n - 3) OR (image_row_id >= 10 AND image_row_id < 20) OR image_row_id >= n - 4)""")
def s15_row_lookup(spark, d):
    """Entries of rows by number, from the end and by slice."""
    from noteforge.sources.rows import lookup

    edges = table(spark, d, "image_assets").select(C("image_row_id"), F.explode_outer("doc_row_ids").alias("doc"))
    return lookup(edges, "image_row_id", [5, -1, -3, slice(10, 20), slice(-4, None)]).where("doc IS NOT NULL").distinct()


@query("s14_slice", "SELECT doc_id, text FROM documents WHERE doc_id >= 100 AND doc_id < 150")
def s14_slice(spark, d):
    from noteforge.sources.rows import rows_between

    return rows_between(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 100, 150)


@query("s02_limited_scan", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100")
def s02_limited_scan(spark, d):
    """The first rows in delivery order: the limit is the feature."""
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").limit(100)


@query("s10_pair_relation", """SELECT DISTINCT 'muge:' || image_id AS image_id, 'muge:' || text_id AS text_id, min(text) AS text FROM text_entries WHERE image_id IS NOT NULL AND text_id IS NOT NULL GROUP BY 1, 2""")
def s10_pair_relation(spark, d):
    from noteforge.sources.files import scan_pairs

    return scan_pairs(table(spark, d, "text_entries"), "image_id", "text_id", "text", "muge")


@query("s11_pair_at", "SELECT 'muge:' || image_id AS image_uid, 'muge:' || text_id AS text_uid, text, raw_text AS payload FROM text_entries WHERE entry_id IN (7, (SELECT max(entry_id) FROM text_entries))")
def s11_pair_at(spark, d):
    """The pairs 7 and -1, their payload as delivered: other alphabet, no padding."""
    from noteforge.sources.files import decoded_pair, pair_at

    t = table(spark, d, "text_entries")
    n = t.agg(F.max("entry_id")).first()[0] + 1
    both = pair_at(t, "entry_id", 7, n).unionByName(pair_at(t, "entry_id", -1, n))
    sent = F.rtrim(F.translate(F.base64(F.encode("raw_text", "UTF-8")), "+/", "-_"), F.lit("="))
    return decoded_pair(both.withColumn("image", sent), "muge").withColumn("payload", F.decode("payload", "UTF-8"))


@query("t10_truncated", "SELECT doc_id FROM documents WHERE doc_id < 500")
def t10_truncated(spark, d):
    return sets.truncated(table(spark, d, "documents").select("doc_id"), "doc_id", 500)


@query("s19_vector_scan", "SELECT row_id, len(embedding) AS dimension FROM image_embeddings WHERE embedding IS NOT NULL")
def s19_vector_scan(spark, d):
    return table(spark, d, "image_embeddings").where("embedding IS NOT NULL").select("row_id", F.size("embedding").cast("bigint").alias("dimension"))


@query("s20_source_concat", """WITH c AS (SELECT dataset, count(*) AS n FROM text_entries GROUP BY 1), s AS (SELECT dataset, CAST(sum(n) OVER (ORDER BY dataset) - n AS BIGINT) AS start FROM c)
    SELECT t.dataset, t.entry_id, s.start + row_number() OVER (PARTITION BY t.dataset ORDER BY t.entry_id) - 1 AS global_index FROM text_entries t JOIN s ON s.dataset = t.dataset""")
def s20_source_concat(spark, d):
    from noteforge.sources.rows import concatenated

    return concatenated(table(spark, d, "text_entries").select("dataset", "entry_id"), "dataset", "entry_id")


@query("j10_index_to_source", """WITH c AS (SELECT dataset, count(*) AS n FROM text_entries GROUP BY 1), s AS (SELECT dataset, sum(n) OVER (ORDER BY dataset) - n AS a, sum(n) OVER (ORDER BY dataset) AS b FROM c)
    SELECT g AS global_index, dataset, CAST(g - a AS BIGINT) AS local_index FROM range((SELECT CAST(max(b) AS BIGINT) FROM s)) t(g) JOIN s ON g >= a AND g < b""")
def j10_index_to_source(spark, d):
    from noteforge.sources.rows import source_of_index

    sizes = table(spark, d, "text_entries").groupBy("dataset").agg(F.count("*").alias("n"))
    return source_of_index(sizes, "dataset", "n")


@query("u1_union_distinct", "SELECT image_id FROM text_entries WHERE image_id IS NOT NULL UNION SELECT image_id FROM image_entries")
def u1_union_distinct(spark, d):
    return sets.union_distinct(table(spark, d, "text_entries").where("image_id IS NOT NULL").select("image_id"), table(spark, d, "image_entries").select("image_id"))


@query("u2_union_all", "SELECT dataset, image_id FROM text_entries UNION ALL SELECT dataset, image_id FROM image_entries")
def u2_union_all(spark, d):
    return sets.union_all(table(spark, d, "text_entries").select("dataset", "image_id"), table(spark, d, "image_entries").select("image_id", "dataset"))


@query("u3_intersection", "SELECT image_path FROM documents WHERE image_path IS NOT NULL INTERSECT SELECT image_path FROM image_assets")
def u3_intersection(spark, d):
    return sets.intersection(table(spark, d, "documents").where("image_path IS NOT NULL").select("image_path"), table(spark, d, "image_assets"))


@query("u4_difference", "SELECT image_path FROM documents WHERE image_path IS NOT NULL EXCEPT SELECT image_path FROM image_assets")
def u4_difference(spark, d):
    return sets.difference(table(spark, d, "documents").where("image_path IS NOT NULL").select("image_path"), table(spark, d, "image_assets"))


@query("u5_set_equality", """SELECT (SELECT count(*) FROM (SELECT DISTINCT image_id FROM text_entries WHERE image_id IS NOT NULL EXCEPT SELECT image_id FROM image_entries)) AS only_left,
    (SELECT count(*) FROM (SELECT DISTINCT image_id FROM image_entries EXCEPT SELECT image_id FROM text_entries WHERE image_id IS NOT NULL)) AS only_right""")
def u5_set_equality(spark, d):
    from noteforge.operators.integrity import set_differences

    return set_differences(table(spark, d, "text_entries").where("image_id IS NOT NULL").select("image_id"), table(spark, d, "image_entries").select("image_id"))


@query("w02_dense_ids", "SELECT entry_id, row_number() OVER (ORDER BY entry_id) - 1 AS id FROM text_entries")
def w02_dense_ids(spark, d):
    return dense_ids(table(spark, d, "text_entries").select("entry_id"), "entry_id", "id")


@query("w04_running_offsets", "SELECT source, doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_chars FROM documents")
def w04_running_offsets(spark, d):
    return running(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "doc_id", C("n_chars"), "offset_chars", ["source"]).select("source", "doc_id", "offset_chars")
