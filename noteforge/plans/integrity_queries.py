"""Integrity, cleaning and joins over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteforge.operators import cleaning, documents, integrity
from noteforge.plans.base import Book, sql_nfkc
from noteforge.plans.corpus import PAIRS_SQL, pairs, relation
from noteforge.plans.text_queries import _terminated
from noteforge.session import table

book = Book()
query = book.query
QUERIES = book.QUERIES
C = F.col


@query("s04_caption_pairs", "SELECT doc_id, text, u.t AS image_id FROM documents, unnest(tags) AS u(t) WHERE trim(text, ' ') <> '' AND u.t IS NOT NULL")
def s04(spark, d):
    return cleaning.caption_pairs(table(spark, d, "documents"), "doc_id", "text", "tags")


def _tsv(spark, d):
    """Image lines as delivered: id, tab, Base64 of the path; every 7th without a tab, every 11th with bad Base64."""
    t = table(spark, d, "image_entries").select("image_id", "path", F.xxhash64("dataset", "image_id", "loaded_at", "path").alias("h"), "loaded_at", "dataset")
    line = F.when(C("image_id") % 7 == 0, C("path")).when(C("image_id") % 11 == 0, F.concat("image_id", F.lit("\t!"))).otherwise(F.concat("image_id", F.lit("\t"), F.base64(F.encode("path", "UTF-8"))))
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(loaded_at AS TIMESTAMP_NTZ))")
    return t.select(micros.alias("ordinal"), line.alias("line"))


@query("s05_decoded_images", """WITH l AS (SELECT epoch_us(loaded_at) AS ordinal, image_id, path FROM image_entries), needed AS (SELECT DISTINCT image_id FROM text_entries),
    good AS (SELECT *, min(ordinal) OVER (PARTITION BY image_id) AS f FROM l WHERE image_id % 7 <> 0 AND image_id % 11 <> 0 AND image_id IN (SELECT image_id FROM needed))
    SELECT ordinal, CAST(image_id AS VARCHAR) AS image_id, CASE WHEN ordinal = f THEN path END AS payload, CASE WHEN ordinal = f THEN 'kept' ELSE 'duplicate' END AS status FROM good
    UNION ALL SELECT ordinal, CASE WHEN image_id % 7 <> 0 THEN CAST(image_id AS VARCHAR) END, NULL, 'malformed' FROM l WHERE image_id % 7 = 0 OR image_id % 11 = 0""")
def s05(spark, d):
    needed = table(spark, d, "text_entries").select(C("image_id").cast("string").alias("image_id"))
    return cleaning.decoded_images(_tsv(spark, d), needed).select("ordinal", "image_id", F.decode("payload", "UTF-8").alias("payload"), "status")


@query("s07_numeric_ids", """WITH v AS (SELECT trim(source_text_id, ' ') AS value FROM text_entries WHERE trim(source_text_id, ' ') <> '')
    SELECT DISTINCT value, 'not digits' AS fault FROM v WHERE NOT regexp_full_match(value, '[0-9]+') UNION ALL SELECT value, 'repeated' FROM v GROUP BY value HAVING count(*) > 1""")
def s07(spark, d):
    return integrity.bad_numeric_ids(table(spark, d, "text_entries"), "source_text_id")


_SEG = """lines AS (SELECT entry_id AS ordinal, split, coalesce(source_text_id || ' ' || raw_text, raw_text, '') AS line FROM text_entries WHERE dataset = 'harborseg'),
    ids AS (SELECT DISTINCT split, CAST(image_id AS VARCHAR) AS image FROM image_entries WHERE dataset = 'harborseg'),
    p AS (SELECT ordinal, split, line, strpos(line, ' ') > 0 AND length(h) - length(replace(h, '#', '')) = 2 AS formed, h, substr(line, strpos(line, ' ') + 1) AS raw, split_part(h, '#', 1) AS image, split_part(h, '#', 2) AS lang, split_part(h, '#', 3) AS n,
      row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, ordinal) - 1 AS text_id FROM (SELECT *, CASE WHEN strpos(line, ' ') > 0 THEN substr(line, 1, strpos(line, ' ') - 1) ELSE '' END AS h FROM lines)),
    r AS (SELECT p.*, CASE WHEN NOT formed THEN 'malformed_caption' WHEN ids.image IS NULL THEN 'caption_without_split_mapping' WHEN lang <> CASE WHEN p.split = 'test' THEN 'zhm' ELSE 'zhb' END OR NOT regexp_full_match(n, '[0-9]+') THEN 'malformed_caption_id' END AS r1
      FROM p LEFT JOIN ids ON formed AND ids.split = p.split AND ids.image = p.image),
    q AS (SELECT *, CASE WHEN r1 IS NULL AND row_number() OVER (PARTITION BY split, r1 IS NULL, h ORDER BY ordinal) > 1 THEN 'duplicate_caption_id' ELSE r1 END AS r2, """ + f"""regexp_replace({sql_nfkc('raw')}, '\\p{{C}}', '', 'g') AS c FROM r),
    z AS (SELECT *, CASE WHEN split = 'test' THEN array_to_string(list_filter(list_transform(regexp_split_to_array(c, '[\\s\\p{{Z}}]+'), lambda x: regexp_replace(x, ':[A-Za-z]+$', '')), lambda x: x <> ''), '')
      ELSE array_to_string(list_filter(list_transform(regexp_split_to_array(trim(c, ' '), '[\\s\\p{{Z}}]{{2,}}'), lambda x: regexp_replace(x, '[\\s\\p{{Z}}]+', '', 'g')), lambda x: x <> ''), '，') END AS t FROM q)"""


@query("s08_segment_captions", f"WITH {_SEG} SELECT ordinal, split, h AS source_text_id, text_id, CASE WHEN formed THEN TRY_CAST(image AS BIGINT) END AS image_id, CASE WHEN r2 IS NULL AND t <> '' THEN {_terminated('t')} END AS text, coalesce(r2, CASE WHEN t = '' THEN 'empty_clean_text' END) AS reason FROM z")
def s08(spark, d):
    t = table(spark, d, "text_entries").where("dataset = 'harborseg'")
    lines = t.select(C("entry_id").alias("ordinal"), "split", F.coalesce(F.concat("source_text_id", F.lit(" "), "raw_text"), C("raw_text"), F.lit("")).alias("line"))
    ids = table(spark, d, "image_entries").where("dataset = 'harborseg'").select("split", C("image_id").cast("string").alias("image_id"))
    return cleaning.parsed_segment_captions(lines, ids)


_SCENE = f"""lines AS (SELECT entry_id AS ordinal, 'scene_' || lpad(CAST(image_id AS VARCHAR), 12, '0') || '#' || CASE WHEN entry_id % 50 = 0 THEN 'x' ELSE CAST(text_id % 5 AS VARCHAR) END || CASE WHEN entry_id % 60 = 0 THEN ' ' ELSE chr(9) END || raw_text AS line
      FROM text_entries WHERE dataset = 'canvasline' AND image_id IS NOT NULL AND raw_text IS NOT NULL),
    imgs AS (SELECT source_id, arg_min(split, loaded_at) AS split, min(image_id) AS position FROM image_entries WHERE dataset = 'canvasline' GROUP BY 1),
    p AS (SELECT ordinal, strpos(line, chr(9)) > 0 AND strpos(h, '#') > 0 AS formed, h, substr(line, strpos(line, chr(9)) + 1) AS raw, CASE WHEN strpos(line, chr(9)) > 0 AND strpos(h, '#') > 0 THEN regexp_extract(h, '^(.*)#[^#]*$', 1) END AS source_id, regexp_extract(h, '#([^#]*)$', 1) AS n
      FROM (SELECT *, CASE WHEN strpos(line, chr(9)) > 0 THEN substr(line, 1, strpos(line, chr(9)) - 1) ELSE '' END AS h FROM lines)),
    j AS (SELECT p.*, split, position, formed AND split IS NOT NULL AND regexp_full_match(n, '[0-9]+') AS ok FROM p LEFT JOIN imgs ON imgs.source_id = p.source_id),
    r AS (SELECT *, CASE WHEN NOT formed THEN 'malformed_caption' WHEN ok AND row_number() OVER (PARTITION BY ok, h ORDER BY ordinal) > 1 THEN 'duplicate_caption_id' WHEN NOT ok THEN 'caption_without_split_mapping' END AS reason FROM j),
    k AS (SELECT *, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, position, ordinal) AS text_id,
      trim(regexp_replace(regexp_replace({sql_nfkc('raw')}, '\\p{{C}}', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'), ' ') AS t FROM r WHERE reason IS NULL)"""


@query("s09_scene_captions", f"""WITH {_SCENE} SELECT ordinal, h AS source_text_id, source_id, split, text_id, nullif(t, '') AS text, CASE WHEN t = '' THEN 'empty_clean_text' END AS reason FROM k
    UNION ALL SELECT ordinal, h, source_id, split, NULL, NULL, reason FROM r WHERE reason IS NOT NULL""")
def s09(spark, d):
    t = table(spark, d, "text_entries").where("dataset = 'canvasline' AND image_id IS NOT NULL AND raw_text IS NOT NULL")
    n = F.when(C("entry_id") % 50 == 0, "x").otherwise((C("text_id") % 5).cast("string"))
    line = F.concat(F.lit("scene_"), F.lpad(C("image_id").cast("string"), 12, "0"), F.lit("#"), n, F.when(C("entry_id") % 60 == 0, " ").otherwise("\t"), "raw_text")
    images = table(spark, d, "image_entries").where("dataset = 'canvasline'").groupBy("source_id").agg(F.min_by("split", "loaded_at").alias("split"), F.min("image_id").alias("position"))
    return cleaning.parsed_scene_captions(t.select(C("entry_id").alias("ordinal"), line.alias("line")), images)


@query("w03_keep_first", "SELECT entry_id FROM text_entries QUALIFY split <> 'train' OR row_number() OVER (PARTITION BY split, dataset, image_id, text ORDER BY entry_id) = 1")
def w03(spark, d):
    return cleaning.keep_first(table(spark, d, "text_entries").select("entry_id", "dataset", "split", "image_id", "text"), ["dataset", "image_id", "text"], "entry_id", C("split") == "train").select("entry_id")


_ISSUES = "SELECT entry_id AS ordinal, CASE WHEN image_id IS NULL THEN 'no image' WHEN source_text_id IS NULL THEN 'no source id' WHEN raw_text IS NULL OR raw_text = '' THEN 'no raw text' WHEN text IS NULL OR text = '' THEN 'no text' END AS reason FROM text_entries"


@query("w06_issue_samples", f"SELECT reason, total, rank, ordinal FROM (SELECT *, count(*) OVER (PARTITION BY reason) AS total, CAST(row_number() OVER (PARTITION BY reason ORDER BY ordinal) AS INTEGER) AS rank FROM ({_ISSUES}) WHERE reason IS NOT NULL) WHERE rank <= 5")
def w06(spark, d):
    reason = F.when(C("image_id").isNull(), "no image").when(C("source_text_id").isNull(), "no source id").when(C("raw_text").isNull() | (C("raw_text") == ""), "no raw text").when(C("text").isNull() | (C("text") == ""), "no text")
    return cleaning.issue_samples(table(spark, d, "text_entries").select(C("entry_id").alias("ordinal"), reason.alias("reason")).where("reason IS NOT NULL"))


@query("a13_floor_percentiles", "SELECT source, split, count(*) AS n, min(n_chars) AS min, CAST(floor(median(n_chars)) AS INTEGER) AS p50, list_sort(list(n_chars))[1 + CAST(floor((count(*) - 1) * 0.95::DOUBLE) AS INTEGER)] AS p95, list_sort(list(n_chars))[1 + CAST(floor((count(*) - 1) * 0.99::DOUBLE) AS INTEGER)] AS p99, max(n_chars) AS max FROM documents WHERE n_chars IS NOT NULL GROUP BY 1, 2")
def a13(spark, d):
    return cleaning.floor_index_percentiles(table(spark, d, "documents"), ["source", "split"], "n_chars", {"p95": 0.95, "p99": 0.99})


@query("a14_length_statistics", "SELECT dataset, split, count(*) AS n, min(l) AS min, CAST(floor(median(l)) AS INTEGER) AS p50, list_sort(list(l))[1 + CAST(floor((count(*) - 1) * 0.95::DOUBLE) AS INTEGER)] AS p95, list_sort(list(l))[1 + CAST(floor((count(*) - 1) * 0.99::DOUBLE) AS INTEGER)] AS p99, max(l) AS max FROM (SELECT dataset, split, CAST(length(text) AS INTEGER) AS l FROM text_entries WHERE text IS NOT NULL) GROUP BY 1, 2")
def a14(spark, d):
    t = table(spark, d, "text_entries").select("dataset", "split", F.char_length("text").alias("l"))
    return cleaning.floor_index_percentiles(t, ["dataset", "split"], "l", {"p95": 0.95, "p99": 0.99})


@query("j04_needed_images", "SELECT image_row_id FROM image_assets WHERE image_path IN (SELECT image_path FROM documents)")
def j04(spark, d):
    return integrity.needed_only(table(spark, d, "image_assets"), table(spark, d, "documents"), ["image_path"]).select("image_row_id")


@query("j05_missing_images", "SELECT DISTINCT dataset, image_id FROM text_entries t WHERE image_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM image_entries i WHERE i.dataset = t.dataset AND i.image_id = t.image_id)")
def j05_missing(spark, d):
    return integrity.missing(table(spark, d, "text_entries"), table(spark, d, "image_entries"), ["dataset", "image_id"])


@query("j05_orphan_images", "SELECT DISTINCT image_path FROM image_assets i WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.image_path = i.image_path)")
def j05_orphans(spark, d):
    return integrity.missing(table(spark, d, "image_assets"), table(spark, d, "documents"), ["image_path"])


@query("j06_split_mapping", """SELECT t.entry_id, s.split AS image_split, CASE WHEN t.image_id IS NULL THEN 'no image' WHEN s.split IS NULL THEN 'caption_without_split_mapping' WHEN s.split <> t.split THEN 'other split' END AS reason
    FROM text_entries t LEFT JOIN (SELECT dataset, image_id, arg_min(split, loaded_at) AS split FROM image_entries GROUP BY 1, 2) s ON s.dataset = t.dataset AND s.image_id = t.image_id""")
def j06(spark, d):
    return integrity.split_mapping(table(spark, d, "text_entries"), table(spark, d, "image_entries"), ["dataset", "image_id"], "entry_id")


@query("j13_cross_split_bytes", "SELECT sha256, count(DISTINCT split) AS n_splits FROM image_entries WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def j13_bytes(spark, d):
    return integrity.across_splits(table(spark, d, "image_entries"), "sha256")


@query("j13_cross_split_texts", "SELECT text, count(DISTINCT split) AS n_splits FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def j13_texts(spark, d):
    return integrity.across_splits(table(spark, d, "documents"), "text")


@query("v1_metadata", """WITH a AS (SELECT image_row_id AS r, image_path, doc_row_ids AS l FROM image_assets), o AS (SELECT DISTINCT r, u.d AS d FROM a, unnest(l) AS u(d) WHERE u.d IS NOT NULL), rel AS (SELECT * FROM o WHERE d IN (SELECT doc_id FROM documents)), v AS (
    SELECT 'unique document key' AS rule, doc_key AS key, CAST(count(*) AS VARCHAR) AS detail FROM documents GROUP BY doc_key HAVING count(*) > 1
    UNION ALL SELECT 'unique image path', image_path, CAST(count(*) AS VARCHAR) FROM a GROUP BY image_path HAVING count(*) > 1
    UNION ALL SELECT 'image with owner', CAST(r AS VARCHAR), NULL FROM a WHERE l IS NULL OR len(l) = 0
    UNION ALL SELECT 'distinct owners', CAST(r AS VARCHAR), NULL FROM a WHERE len(l) > (SELECT count(*) FROM (SELECT DISTINCT x FROM unnest(l) AS q(x)))
    UNION ALL SELECT 'known owner', CAST(r AS VARCHAR), CAST(d AS VARCHAR) FROM o WHERE d NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'owners as related', CAST(r AS VARCHAR), CAST(d AS VARCHAR) FROM o WHERE d NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'document with image', CAST(doc_id AS VARCHAR), NULL FROM documents WHERE doc_id NOT IN (SELECT d FROM rel)
    UNION ALL SELECT 'schema version', 'header', '1' UNION ALL SELECT 'image count', 'header', count(DISTINCT image_path) || ',' || count(*) FROM a HAVING count(DISTINCT image_path) <> count(*)
    UNION ALL SELECT 'dense image ids', 'images', min(r) || ',' || max(r) || ',' || count(*) || ',' || count(DISTINCT r) FROM a HAVING min(r) <> 0 OR max(r) <> count(*) - 1 OR count(*) <> count(DISTINCT r)
    UNION ALL SELECT 'dense document ids', 'documents', min(doc_id) || ',' || max(doc_id) || ',' || count(*) || ',' || count(DISTINCT doc_id) FROM documents HAVING min(doc_id) <> 0 OR max(doc_id) <> count(*) - 1 OR count(*) <> count(DISTINCT doc_id)) SELECT * FROM v""")
def v1(spark, d):
    docs = table(spark, d, "documents").select(C("doc_id").alias("doc_row"), "doc_key")
    images = table(spark, d, "image_assets").select(C("image_row_id").alias("image_row"), "image_path", C("doc_row_ids").alias("doc_rows"))
    rel = relation(spark, d)
    header = documents.header(docs, images.select("image_path").distinct(), rel, version=1)  # an old version that counts paths
    return integrity.metadata_violations(docs, images, rel, header)


@query("v2_offsets", "SELECT 'every row' AS rule, CAST(image_row_id AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS detail FROM image_assets WHERE image_row_id NOT IN (SELECT image_row_id FROM image_assets, unnest(doc_row_ids) AS u(d) WHERE u.d IN (SELECT doc_id FROM documents))")
def v2(spark, d):
    rel = relation(spark, d)
    offsets = documents.compressed_rows(rel, "image_row", "doc_row").withColumnRenamed("image_row", "row")
    rows = table(spark, d, "image_assets").select(C("image_row_id").alias("row"))
    return integrity.offset_violations(offsets, rows, rel.count())


def _contracts(spark, d, modality):
    t = table(spark, d, f"{modality}_embeddings").where("embedding IS NOT NULL")
    return t.groupBy("dataset").agg(F.lit("m1").alias("model_fingerprint"), F.min("split").alias("data_manifest_hash"), F.max(F.size("embedding")).cast("string").alias("dimension"), F.lit("L2" if modality == "text" else "l2").alias("normalization"))


@query("v3_contracts", """WITH c AS (SELECT 'text' AS m, dataset, split, embedding FROM text_embeddings UNION ALL SELECT 'image', dataset, split, embedding FROM image_embeddings),
    g AS (SELECT m, dataset, 'm1' AS model_fingerprint, min(split) AS data_manifest_hash, CAST(max(len(embedding)) AS VARCHAR) AS dimension, 'l2' AS normalization FROM c WHERE embedding IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT m, dataset, unnest(['model_fingerprint', 'data_manifest_hash', 'dimension', 'normalization']) AS field, unnest([model_fingerprint, data_manifest_hash, dimension, normalization]) AS v FROM g)
    SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.field, b.field) AS field, a.v AS "left", b.v AS "right" FROM (SELECT * FROM f WHERE m = 'text') a FULL JOIN (SELECT * FROM f WHERE m = 'image') b ON a.dataset = b.dataset AND a.field = b.field
    WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v""")
def v3(spark, d):
    return integrity.contract_mismatches(_contracts(spark, d, "text"), _contracts(spark, d, "image"), "dataset")


@query("v4_startup", """SELECT 'text' AS modality, count(*) AS n_rows, max(len(embedding)) AS dimension, (SELECT count(*) FROM documents) AS n_expected, count(*) = (SELECT count(*) FROM documents) AS complete FROM text_embeddings
    UNION ALL SELECT 'image', count(*), max(len(embedding)), (SELECT count(*) FROM image_assets), count(*) = (SELECT count(*) FROM image_assets) FROM image_embeddings""")
def v4(spark, d):
    return integrity.startup_counts({m: table(spark, d, f"{m}_embeddings") for m in ("text", "image")}, {"text": table(spark, d, "documents"), "image": table(spark, d, "image_assets")})


_UNIT = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))"


def _long_sql(m: str) -> str:
    return f"""SELECT 'unit vectors', '{m}', CAST(count(*) AS VARCHAR) FROM {m}_embeddings WHERE embedding IS NULL OR list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) OR abs({_UNIT} - 1) > 2e-4 HAVING count(*) > 0
    UNION ALL SELECT 'vectors of the dimension', '{m}', CAST(count(*) AS VARCHAR) FROM {m}_embeddings WHERE embedding IS NULL OR len(embedding) <> 64 HAVING count(*) > 0
    UNION ALL SELECT 'a vector for every row', '{m}', (SELECT count(*) FROM {m}_embeddings) || ',' || count(*) FROM {'documents' if m == 'text' else 'image_assets'} HAVING count(*) <> (SELECT count(*) FROM {m}_embeddings)"""


@query("v4_startup_faults", f"SELECT 'loaded model' AS rule, 'image' AS key, 'm2' AS detail UNION ALL SELECT 'one data manifest', 'contracts', '2' UNION ALL {_long_sql('text')} UNION ALL {_long_sql('image')}")
def v4_faults(spark, d):
    contracts = spark.createDataFrame([("text", "m1", "h1", 64, "L2"), ("image", "m2", "h2", 64, "l2")], "modality string, model_fingerprint string, data_manifest_hash string, dimension int, normalization string")
    return integrity.startup_faults({m: table(spark, d, f"{m}_embeddings") for m in ("text", "image")}, {"text": table(spark, d, "documents"), "image": table(spark, d, "image_assets")}, contracts, "m1")


@query("v8_resume", """WITH a AS (SELECT source AS field, count(*) AS v FROM documents WHERE split = 'train' GROUP BY 1), b AS (SELECT source AS field, count(*) AS v FROM documents WHERE split <> 'valid' GROUP BY 1)
    SELECT coalesce(a.field, b.field) AS field, CAST(a.v AS VARCHAR) AS saved, CAST(b.v AS VARCHAR) AS "current" FROM a FULL JOIN b ON a.field = b.field WHERE a.v IS DISTINCT FROM b.v""")
def v8(spark, d):
    """A sampler's state as saved and as it would be now: rows per source."""
    from noteforge.operators.sampling import resume_differences

    def state(condition):
        return table(spark, d, "documents").where(condition).groupBy(C("source").alias("field")).agg(F.count("*").alias("value"))

    return resume_differences(state("split = 'train'"), state("split <> 'valid'"))


@query("v5_repeated_ids", "SELECT dataset, image_id, count(*) AS n FROM image_entries GROUP BY 1, 2 HAVING count(*) > 1")
def v5(spark, d):
    return integrity.repeated(table(spark, d, "image_entries"), ["dataset", "image_id"])


@query("v6_expected_counts", "SELECT dataset, split, actual, expected FROM (SELECT dataset, split, count(*) AS actual, count(DISTINCT image_id) AS expected FROM image_entries GROUP BY 1, 2) WHERE actual <> expected")
def v6(spark, d):
    t = table(spark, d, "image_entries")
    return integrity.unexpected_counts(t.groupBy("dataset", "split").agg(F.count("*").alias("actual")), t.groupBy("dataset", "split").agg(F.count_distinct("image_id").alias("expected")), ["dataset", "split"])


@query("a26_copies_consistency", """WITH v AS (SELECT text_uid AS uid, row_id, embedding FROM text_embeddings WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
    f AS (SELECT uid, arg_min(embedding, row_id) AS f, count(*) AS n_rows FROM v GROUP BY 1 HAVING count(*) > 1),
    m AS (SELECT uid, n_rows, list_max(list_transform(list_zip(embedding, f), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2]))) AS d FROM v JOIN f USING (uid))
    SELECT uid, max(n_rows) AS n_rows, max(d) AS max_difference, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_different, max(d) <= 1e-6 AS consistent FROM m GROUP BY 1""")
def a26(spark, d):
    return integrity.copies_consistency(table(spark, d, "text_embeddings").withColumnRenamed("text_uid", "uid"), "uid", "row_id", "embedding")


@query("a27_norm_range", """SELECT round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, count(*) AS n_rows FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM image_embeddings
    WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))))""")
def a27(spark, d):
    return integrity.norm_range(table(spark, d, "image_embeddings"), "embedding").select(F.round("min_norm", 6).alias("min_norm"), F.round("max_norm", 6).alias("max_norm"), "n_rows")


_COPIES = """SELECT count(*) AS g, coalesce(sum(n_different), 0) AS diff, coalesce(max(d), 0) AS d FROM (SELECT uid, max(d) AS d, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS n_different FROM (
    SELECT v.uid, list_max(list_transform(list_zip(embedding, f), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2]))) AS d FROM {m}_v v JOIN (SELECT uid, arg_min(embedding, row_id) AS f FROM {m}_v GROUP BY 1 HAVING count(*) > 1) o ON o.uid = v.uid) GROUP BY 1)"""
_R7 = ", ".join(f"""{m}_v AS (SELECT {m}_uid AS uid, row_id, embedding FROM {m}_embeddings WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
    {m}_c AS ({_COPIES.format(m=m)}), {m}_n AS (SELECT min({_UNIT}) AS lo, max({_UNIT}) AS hi FROM {m}_v)""" for m in ("text", "image"))


@query("r7_migration_report", f"""WITH {PAIRS_SQL}, {_R7} SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(DISTINCT doc_key) FROM good) AS documents, (SELECT count(DISTINCT image_path) FROM good) AS images,
    (SELECT count(*) FROM (SELECT DISTINCT doc_key, image_path FROM good)) AS relations, t.g AS text_groups, CAST(t.diff AS BIGINT) AS text_different, t.d AS text_max_difference, i.g AS image_groups, CAST(i.diff AS BIGINT) AS image_different, i.d AS image_max_difference,
    round(tn.lo, 6) AS text_min_norm, round(tn.hi, 6) AS text_max_norm, round(im.lo, 6) AS image_min_norm, round(im.hi, 6) AS image_max_norm FROM text_c t, image_c i, text_n tn, image_n im""")
def r7(spark, d):
    p = pairs(spark, d)
    t, i = table(spark, d, "text_embeddings"), table(spark, d, "image_embeddings")
    return integrity.migration_report(
        p, documents.documents_of(p), documents.images_of(p), documents.relation_of(p), integrity.copies_consistency(t, "text_uid", "row_id", "embedding"), integrity.copies_consistency(i, "image_uid", "row_id", "embedding"), integrity.norm_range(t, "embedding"), integrity.norm_range(i, "embedding")
    ).withColumns({c: F.round(c, 6) for c in ("text_min_norm", "text_max_norm", "image_min_norm", "image_max_norm")})


@query("r11_dataset_violations", r"""WITH i AS (SELECT dataset, split, image_id, sha256 FROM image_entries), t AS (SELECT dataset, split, entry_id AS entry, text_id, image_id, text FROM text_entries)
    SELECT 'image id once' AS rule, dataset || ':' || split || ':' || image_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM i GROUP BY dataset, split, image_id HAVING count(*) > 1
    UNION ALL SELECT 'image in one split', dataset || ':' || image_id, CAST(count(DISTINCT split) AS VARCHAR) FROM i GROUP BY dataset, image_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'text id once', dataset || ':' || text_id, CAST(count(*) AS VARCHAR) FROM t GROUP BY dataset, text_id HAVING count(*) > 1
    UNION ALL SELECT 'image of the split', CAST(entry AS VARCHAR), NULL FROM t WHERE image_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.dataset = t.dataset AND i.split = t.split AND i.image_id = t.image_id)
    UNION ALL SELECT 'text filled', CAST(entry AS VARCHAR), NULL FROM t WHERE coalesce(text, '') = ''
    UNION ALL SELECT 'no control characters', CAST(entry AS VARCHAR), NULL FROM t WHERE regexp_matches(text, '\p{C}')
    UNION ALL SELECT 'image described', k, NULL FROM (SELECT DISTINCT dataset || ':' || split || ':' || image_id AS k FROM i WHERE NOT EXISTS (SELECT 1 FROM t WHERE i.dataset = t.dataset AND i.split = t.split AND i.image_id = t.image_id))
    UNION ALL SELECT 'equal bytes in one split', dataset || ':' || sha256, CAST(count(DISTINCT split) AS VARCHAR) FROM i WHERE sha256 IS NOT NULL GROUP BY dataset, sha256 HAVING count(DISTINCT split) > 1""")
def r11(spark, d):
    images = table(spark, d, "image_entries").select("dataset", "split", "image_id", "sha256")
    texts = table(spark, d, "text_entries").select("dataset", "split", C("entry_id").alias("entry"), "text_id", "image_id", "text")
    return integrity.dataset_violations(images, texts)


@query("r12_bundle_violations", """WITH t AS (SELECT dataset, CAST(text_id AS VARCHAR) AS uid FROM text_entries), i AS (SELECT dataset, CAST(image_id AS VARCHAR) AS uid FROM image_entries),
    a AS (SELECT DISTINCT dataset, CAST(text_id AS VARCHAR) AS t, CAST(image_id AS VARCHAR) AS i FROM text_entries WHERE image_id IS NOT NULL)
    SELECT DISTINCT * FROM (SELECT 'unique text' AS rule, concat_ws('::', dataset, uid) AS key, CAST(NULL AS VARCHAR) AS detail FROM t GROUP BY dataset, uid HAVING count(*) > 1
    UNION ALL SELECT 'unique image', concat_ws('::', dataset, uid), NULL FROM i GROUP BY dataset, uid HAVING count(*) > 1
    UNION ALL SELECT 'known image', concat_ws('::', dataset, i), NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM i x WHERE x.dataset = a.dataset AND x.uid = a.i)
    UNION ALL SELECT 'known text', concat_ws('::', dataset, a.t), NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.dataset = a.dataset AND x.uid = a.t)
    UNION ALL SELECT 'text with answer', concat_ws('::', dataset, uid), NULL FROM t WHERE uid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.dataset = t.dataset AND a.t = t.uid)
      AND (dataset <> 'stalltitle' OR dataset IN (SELECT dataset FROM a)))""")
def r12(spark, d):
    t = table(spark, d, "text_entries")
    texts = t.select("dataset", C("text_id").cast("string").alias("uid"))
    images = table(spark, d, "image_entries").select("dataset", C("image_id").cast("string").alias("uid"))
    answers = t.where("image_id IS NOT NULL").select("dataset", C("text_id").cast("string").alias("text_uid"), C("image_id").cast("string").alias("image_uid"))
    return integrity.bundle_violations(texts, images, answers, C("dataset") == "stalltitle")


@query("a25_fingerprint", "SELECT sha256(string_agg(n_name || chr(0) || n_regionkey || chr(0) || sha256(n_name) || chr(10), '' ORDER BY n_name)) AS fingerprint, count(*) AS n_files FROM nation")
def a25(spark, d):
    """The files of one directory, played by the nation table."""
    files = table(spark, d, "nation").select(C("n_name").alias("path"), C("n_regionkey").alias("size"), F.sha2("n_name", 256).alias("digest"))
    return integrity.directory_fingerprint(files)


@query("r13_preparation_faults", """WITH needed AS (SELECT DISTINCT image_id FROM text_entries WHERE image_id IS NOT NULL), l AS (SELECT image_id FROM image_entries),
    kept AS (SELECT DISTINCT image_id FROM l WHERE image_id % 7 <> 0 AND image_id % 11 <> 0)
    SELECT 'missing image' AS rule, CAST(image_id AS VARCHAR) AS key FROM needed WHERE image_id NOT IN (SELECT image_id FROM kept)
    UNION ALL SELECT DISTINCT 'undecodable', CAST(image_id AS VARCHAR) FROM l WHERE image_id % 7 <> 0 AND image_id % 11 = 0 AND image_id IN (SELECT image_id FROM needed)
    UNION ALL SELECT 'repeated item', source_text_id FROM text_entries WHERE image_id IS NOT NULL AND source_text_id IS NOT NULL GROUP BY 2 HAVING count(*) > 1""")
def r13(spark, d):
    captions = table(spark, d, "text_entries").where("image_id IS NOT NULL").select(C("source_text_id").alias("item_id"), C("image_id").cast("string").alias("image_id"))
    return cleaning.preparation_faults(captions, cleaning.decoded_images(_tsv(spark, d), captions))
