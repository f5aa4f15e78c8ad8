"""Validation as data: every rule gives rows of what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.functions import vectors
from noteforge.operators.documents import one_row
from noteforge.operators.ordering import WIDTH

VIOLATION = "rule string, key string, detail string"


def violation(df: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def assert_valid(violations: DataFrame) -> None:
    """Raises with the first violations, if there are any (one small job)."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule']}: {r['key']} {r['detail'] or ''}".strip() for r in found))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """V5: keys that occur more than once, with counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def bad_numeric_ids(df: DataFrame, value: str) -> DataFrame:
    """(value, fault): filled values that are no digits, or that repeat."""
    v = df.select(F.trim(F.col(value)).alias("value")).where("value <> ''")
    odd = v.where(~F.col("value").rlike("^[0-9]+$")).distinct().select("value", F.lit("not digits").alias("fault"))
    return odd.unionByName(repeated(v, ["value"]).select("value", F.lit("repeated").alias("fault")))


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with how many distinct rows only one side has; both 0 means equal sets."""
    a, b = left.distinct().withColumn("_l", F.lit(1)), right.distinct().withColumn("_r", F.lit(1))
    cols = left.columns
    both = a.join(b, [a[c].eqNullSafe(b[c]) for c in cols] if len(cols) > 1 else cols, "full")
    return both.agg(F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))


#: The only version of the metadata that is read; earlier ones must be migrated.
SCHEMA_VERSION = 2


def header_violations(header: DataFrame, docs: DataFrame, images: DataFrame, relation: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """V1: a header row (schema_version, document_count, image_count, relation_count[, manifest_hash]) against the tables.

    manifest is a row (manifest_hash) as computed; without it the hash is not compared. No header row is a fault.
    """
    actual = [docs.agg(F.count("*").alias("n_documents")), images.agg(F.count("*").alias("n_images")), relation.select("doc_row", "image_row").distinct().agg(F.count("*").alias("n_relations"))]
    if manifest is not None:
        actual.append(manifest.agg(F.max("manifest_hash").alias("n_hash")))
    names = {"document_count": "n_documents", "image_count": "n_images", "relation_count": "n_relations"} | ({"manifest_hash": "n_hash"} if manifest is not None else {})
    stated = header.agg(F.count("*").alias("n_headers"), F.max("schema_version").alias("schema_version"), *[F.max(c).alias(c) for c in names])
    row = one_row([stated, *actual])
    rules = [("one header", F.col("n_headers") != 1, F.col("n_headers")), ("schema version", ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), F.col("schema_version"))]
    rules += [(c.replace("_", " "), ~F.col(c).eqNullSafe(F.col(n)), F.concat_ws(",", c, n)) for c, n in names.items()]
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), bad.alias("bad"), d.cast("string").alias("detail")) for r, bad, d in rules])
    return row.select(F.explode(listed).alias("r")).where("r.bad").select("r.rule", F.lit("header").alias("key"), "r.detail")


def metadata_violations(docs: DataFrame, images: DataFrame, relation: DataFrame, header: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """V1: documents (doc_row, doc_key), images (image_row, image_path, doc_rows), relation (doc_row, image_row).

    Rules: dense document and image ids, unique keys, unique paths, owner lists not empty,
    distinct and of known documents, relation and owner lists the same, every document with an
    image; with a header also its version, counts and hash (header_violations).
    """
    def dense(df: DataFrame, row: str, rule: str, key: str) -> DataFrame:
        span = df.agg(F.min(row).alias("lo"), F.max(row).alias("hi"), F.count("*").alias("n"), F.count_distinct(row).alias("d"))
        return violation(span.where("n > 0 AND (lo <> 0 OR hi <> n - 1 OR d <> n)"), rule, F.lit(key), F.concat_ws(",", "lo", "hi", "n", "d"))

    owners = images.select("image_row", F.explode(F.array_distinct("doc_rows")).alias("doc_row")).where("doc_row IS NOT NULL")
    known = docs.select("doc_row")
    listed, related = owners.withColumn("_o", F.lit(1)), relation.select("doc_row", "image_row").distinct().withColumn("_r", F.lit(1))
    apart = listed.join(related, ["doc_row", "image_row"], "full").where("_o IS NULL OR _r IS NULL")
    return together([
        *([] if header is None else [header_violations(header, docs, images, relation, manifest)]),
        dense(docs, "doc_row", "dense document ids", "documents"),
        dense(images, "image_row", "dense image ids", "images"),
        violation(repeated(docs, ["doc_key"]), "unique document key", F.col("doc_key"), F.col("n")),
        violation(repeated(images, ["image_path"]), "unique image path", F.col("image_path"), F.col("n")),
        violation(images.where("doc_rows IS NULL OR size(doc_rows) = 0"), "image with owner", F.col("image_row")),
        violation(images.where("size(doc_rows) > size(array_distinct(doc_rows))"), "distinct owners", F.col("image_row")),
        violation(owners.join(known, "doc_row", "left_anti"), "known owner", F.col("image_row"), F.col("doc_row")),
        violation(apart, "owners as related", F.col("image_row"), F.col("doc_row")),
        violation(docs.join(relation, "doc_row", "left_anti"), "document with image", F.col("doc_row")),
    ])


def offset_violations(offsets: DataFrame, rows: DataFrame, entries: int) -> DataFrame:
    """V2: (row, begin, end) offsets: none empty, none out of bounds, every row there, and each beginning where
    the one before ends, from 0 to `entries` without gap or overlap.

    Rows are compared inside buckets of row numbers, then the ends of neighbouring buckets, of
    which there is one row each; what is wrong before the first row has the key `offsets`.
    """
    bucket = F.floor(F.col("row") / WIDTH)
    one = F.struct("row", "begin", "end")
    inside = offsets.select("row", "end", F.lead(F.struct("begin")).over(Window.partitionBy(bucket).orderBy("row", "begin", "end")).alias("next"))
    edges = offsets.groupBy(bucket.alias("bucket")).agg(F.min(one).alias("first"), F.max(one).alias("last"))
    edges = edges.select(F.lit(1).alias("part"), "bucket", F.col("first.begin").alias("begin"), F.col("last.row").alias("row"), F.col("last.end").alias("end"))
    around = offsets.sparkSession.createDataFrame([(0, None, None, None, 0), (2, None, entries, None, None)], "part int, bucket bigint, begin bigint, row bigint, end bigint")
    across = Window.partitionBy(F.lit(0)).orderBy("part", "bucket")
    seams = edges.unionByName(around).select("row", "end", F.lead(F.struct("begin")).over(across).alias("next"))
    gaps = inside.unionByName(seams).where("next IS NOT NULL AND NOT (next.begin <=> end)")
    return together([
        violation(offsets.where("end <= begin"), "no empty row", F.col("row")),
        violation(offsets.where((F.col("begin") < 0) | (F.col("end") > entries)), "within bounds", F.col("row")),
        violation(gaps, "rows follow each other", F.coalesce(F.col("row").cast("string"), F.lit("offsets")), F.col("next.begin")),
        violation(rows.join(offsets, "row", "left_anti"), "every row", F.col("row")),
    ])


def contract_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """V3: (key, field, left, right) where contracts differ or a field is missing, on both sides too.

    Fields: model_fingerprint, data_manifest_hash, dimension (as integer), normalization (any case).
    """
    def longer(df: DataFrame, name: str) -> DataFrame:
        fields = {"model_fingerprint": F.col("model_fingerprint"), "data_manifest_hash": F.col("data_manifest_hash"), "dimension": F.expr("try_cast(dimension AS INT)").cast("string"), "normalization": F.lower("normalization")}
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()])).alias("f")).select(key, "f.field", F.col("f.value").alias(name))

    both = longer(left, "left").join(longer(right, "right"), [key, "field"], "full")
    return both.where("left IS NULL OR right IS NULL OR left <> right").select(key, "field", "left", "right")


def startup_counts(vectors_of: dict[str, DataFrame], owners: dict[str, DataFrame], vec: str = "embedding") -> DataFrame:
    """V4: (modality, n_rows, dimension, n_expected, complete): the vectors of each modality against the rows they belong to."""
    def part(m: str) -> DataFrame:
        n = owners[m].agg(F.count("*").alias("n_expected"))
        v = vectors_of[m].agg(F.count("*").alias("n_rows"), F.max(F.size(vec)).cast("bigint").alias("dimension"))
        return one_row([v, n]).select(F.lit(m).alias("modality"), "n_rows", "dimension", "n_expected", (F.col("n_rows") == F.col("n_expected")).alias("complete"))

    return together([part(m) for m in vectors_of])


def startup_faults(vectors_of: dict[str, DataFrame], owners: dict[str, DataFrame], contracts: DataFrame, model: str, vec: str = "embedding") -> DataFrame:
    """V4: what must not be when a search starts: rules as violations, keyed by modality.

    contracts: (modality, model_fingerprint, data_manifest_hash, dimension, normalization). Rules:
    a contract per modality, its model is the one that is loaded, dimensions and data are the
    same everywhere, as many vectors as rows, all of the contract's dimension and in unit length.
    """
    counts = startup_counts(vectors_of, owners, vec).join(contracts.withColumnRenamed("dimension", "stated"), "modality", "left")
    other = contracts.agg(F.count_distinct("dimension").alias("d"), F.count_distinct("data_manifest_hash").alias("h"))
    each = [
        violation(counts.where("model_fingerprint IS NULL"), "contract", F.col("modality")),
        violation(counts.where(F.col("model_fingerprint") != model), "loaded model", F.col("modality"), F.col("model_fingerprint")),
        violation(counts.where("NOT complete"), "a vector for every row", F.col("modality"), F.concat_ws(",", "n_rows", "n_expected")),
        violation(counts.where("lower(normalization) <> 'l2'"), "normalization", F.col("modality"), F.col("normalization")),
        violation(other.where("d > 1"), "one dimension", F.lit("contracts"), F.col("d")),
        violation(other.where("h > 1"), "one data manifest", F.lit("contracts"), F.col("h")),
    ]
    for m, v in vectors_of.items():
        sizes = v.groupBy(F.coalesce(F.size(vec), F.lit(-1)).alias("_s")).agg(F.count("*").alias("_n")).withColumn("modality", F.lit(m)).join(contracts, "modality")
        wrong = sizes.where(F.col("_s") != F.col("dimension").cast("int")).agg(F.sum("_n").alias("wrong"))
        long = v.agg(F.count_if(~vectors.is_unit(F.col(vec))).alias("long"))
        each += [violation(wrong.where("wrong > 0"), "vectors of the dimension", F.lit(m), F.col("wrong")), violation(long.where("long > 0"), "unit vectors", F.lit(m), F.col("long"))]
    return together(each)


def split_mapping(rows: DataFrame, images: DataFrame, keys: list[str], row: str, split: str = "split", time: str = "loaded_at") -> DataFrame:
    """(row, image_split, reason) of captions against the split of their image (its first delivery).

    reason: no image, caption_without_split_mapping, other split, or null. A hot image is spread by AQE's
    skew join, as the images side has one row a key.
    """
    s = images.groupBy(*keys).agg(F.min_by(split, time).alias("image_split"))
    last = F.col(keys[-1])
    reason = F.when(last.isNull(), "no image").when(F.col("image_split").isNull(), "caption_without_split_mapping").when(F.col("image_split") != F.col(split), "other split")
    return rows.join(s, keys, "left").select(row, "image_split", reason.alias("reason"))


def unexpected_counts(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """V6: (keys, actual, expected) that differ; a missing side counts 0."""
    both = actual.join(expected, keys, "full").select(*keys, F.coalesce("actual", F.lit(0)).alias("actual"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where("actual <> expected")


def missing(refs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct referenced keys without target; swap the sides for orphans."""
    return refs.select(*keys).dropna().distinct().join(targets.select(*keys), keys, "left_anti")


def needed_only(rows: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is needed."""
    return rows.join(needed.select(*keys), keys, "left_semi")


def across_splits(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, n_splits) of keys that occur in more than one split; null keys are none."""
    g = df.where(F.col(key).isNotNull()).groupBy(key, split).agg(F.lit(1).alias("one"))
    return g.groupBy(key).agg(F.count("*").alias("n_splits")).where("n_splits > 1")


# Files of a model directory that decide what it does, by name and ending, and those that never count.
EXCLUDED_FILES = ["model_fingerprint.json", "export_manifest.json", "embedding_meta.json", "index_meta.json"]
CONTENT_NAMES = [
    "config.json", "generation_config.json", "preprocessor_config.json", "processor_config.json", "retrieval_config.json",
    "tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "vocab.txt", "vocab.json", "merges.txt",
    "added_tokens.json", "sentencepiece.bpe.model", "spiece.model",
]
CONTENT_ENDINGS = [".safetensors", ".bin", ".pt", ".pth"]


def content_files(files: DataFrame) -> DataFrame:
    """Of files (path, ...) those that decide what a model does: named or ended so, or an index of split weights."""
    name = F.element_at(F.split("path", "/"), -1)
    kept = name.isin(CONTENT_NAMES) | name.rlike(r"^(model|pytorch_model)(-.*|\..*\.index)\.json$")
    for ending in CONTENT_ENDINGS:
        kept = kept | name.endswith(ending)
    return files.where(kept & ~name.isin(EXCLUDED_FILES))


def directory_fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 over `path NUL size NUL digest LF` of files (path, size, digest), by path; one directory's files (content_files first)."""
    line = F.concat(F.col("path"), F.lit("\u0000"), F.col("size").cast("string"), F.lit("\u0000"), F.col("digest"), F.lit("\n"))
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("path").alias("p"), line.alias("l")))), lambda x: x["l"]), ""), 256).alias("fingerprint"), F.count("*").alias("n_files"))


def copies_consistency(df: DataFrame, key: str, order: str, vec: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, n_rows, max_difference, n_different, consistent) of keys with several vectors, against the first.

    The first vector of each key is joined back, so no group is held in one place.
    """
    usable = df.where(vectors.finite(F.col(vec)))
    first = usable.groupBy(key).agg(F.min_by(vec, order).alias("_first"), F.count("*").alias("n_rows")).where("n_rows > 1")
    diff = F.array_max(F.zip_with(F.col(vec), F.col("_first"), lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    g = usable.join(first, key).withColumn("_d", F.coalesce(diff, F.lit(float("inf"))))
    return g.groupBy(key).agg(F.max("n_rows").alias("n_rows"), F.max("_d").alias("max_difference"), F.count_if(F.col("_d") > 0).alias("n_different")).withColumn("consistent", F.col("max_difference") <= tolerance)


def norm_range(df: DataFrame, vec: str) -> DataFrame:
    """Smallest and largest norm of the finite vectors."""
    n = df.where(vectors.finite(F.col(vec))).select(vectors.norm(F.col(vec)).alias("n"))
    return n.agg(F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.count("*").alias("n_rows"))


def dataset_violations(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Images (split, image_id, sha256), texts (split, entry, text_id, image_id, text) of one dataset each (column dataset).

    Rules: image ids once per split and in one split, text ids once, texts refer to an image of
    their split, texts filled and without control characters, every image described, equal
    bytes in one split only.
    """
    i, t = images, texts
    per = i.groupBy("dataset", "split", "image_id").agg(F.count("*").alias("n"))
    described = t.select("dataset", "split", "image_id").distinct()
    return together([
        violation(per.where("n > 1"), "image id once", F.concat_ws(":", "dataset", "split", "image_id"), F.col("n")),
        violation(across_splits(i.withColumn("k", F.concat_ws(":", "dataset", "image_id")), "k"), "image in one split", F.col("k"), F.col("n_splits")),
        violation(repeated(t, ["dataset", "text_id"]), "text id once", F.concat_ws(":", "dataset", "text_id"), F.col("n")),
        violation(t.where("image_id IS NOT NULL").join(i, ["dataset", "split", "image_id"], "left_anti"), "image of the split", F.col("entry")),
        violation(t.where(F.coalesce(F.col("text"), F.lit("")) == ""), "text filled", F.col("entry")),
        violation(t.where(F.col("text").rlike(r"\p{C}")), "no control characters", F.col("entry")),
        violation(i.select("dataset", "split", "image_id").distinct().join(described, ["dataset", "split", "image_id"], "left_anti"), "image described", F.concat_ws(":", "dataset", "split", "image_id")),
        violation(across_splits(i.withColumn("k", F.concat_ws(":", "dataset", "sha256")).where("sha256 IS NOT NULL"), "k"), "equal bytes in one split", F.col("k"), F.col("n_splits")),
    ])


def bundle_violations(texts: DataFrame, images: DataFrame, answers: DataFrame, unlabelled: Column | None = None) -> DataFrame:
    """Texts (dataset, uid), images (dataset, uid), answers (dataset, text_uid, image_uid).

    Unique uids; answers refer to known texts and images; a text without answer is accepted only
    where its dataset has no answers at all and `unlabelled` allows that.
    """
    any_answer = answers.select("dataset").distinct().withColumn("_any", F.lit(True))
    bare = texts.join(answers.select("dataset", F.col("text_uid").alias("uid")).distinct(), ["dataset", "uid"], "left_anti").join(F.broadcast(any_answer), "dataset", "left")
    allowed = F.lit(False) if unlabelled is None else unlabelled
    return together([
        violation(repeated(texts, ["dataset", "uid"]), "unique text", F.concat_ws("::", "dataset", "uid")),
        violation(repeated(images, ["dataset", "uid"]), "unique image", F.concat_ws("::", "dataset", "uid")),
        violation(answers.join(texts.select("dataset", F.col("uid").alias("text_uid")), ["dataset", "text_uid"], "left_anti"), "known text", F.concat_ws("::", "dataset", "text_uid")),
        violation(answers.join(images.select("dataset", F.col("uid").alias("image_uid")), ["dataset", "image_uid"], "left_anti"), "known image", F.concat_ws("::", "dataset", "image_uid")),
        violation(bare.where(F.col("_any").isNotNull() | ~allowed), "text with answer", F.concat_ws("::", "dataset", "uid")),
    ]).distinct()


def migration_report(pairs: DataFrame, docs: DataFrame, images: DataFrame, relation: DataFrame, text_check: DataFrame, image_check: DataFrame, text_norms: DataFrame, image_norms: DataFrame) -> DataFrame:
    """One row of counts and checks after pairs became documents."""
    def one(df: DataFrame, prefix: str) -> DataFrame:
        return df.agg(F.count("*").alias(f"{prefix}_groups"), F.coalesce(F.sum("n_different"), F.lit(0)).alias(f"{prefix}_different"), F.coalesce(F.max("max_difference"), F.lit(0.0)).alias(f"{prefix}_max_difference"))

    parts = [
        pairs.agg(F.count("*").alias("pairs")), docs.agg(F.count("*").alias("documents")), images.agg(F.count("*").alias("images")), relation.agg(F.count("*").alias("relations")),
        one(text_check, "text"), one(image_check, "image"),
        text_norms.select(F.col("min_norm").alias("text_min_norm"), F.col("max_norm").alias("text_max_norm")), image_norms.select(F.col("min_norm").alias("image_min_norm"), F.col("max_norm").alias("image_max_norm")),
    ]
    return one_row(parts)
