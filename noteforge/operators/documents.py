"""The document model: pair rows to documents, images and their relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteforge.operators.ordering import dense_ids, running


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with a key, a text and an image path that are not blank; the rest is pair_faults."""
    return pairs.where("doc_key IS NOT NULL AND trim(text) <> '' AND trim(image_path) <> ''")


def pair_faults(pairs: DataFrame) -> DataFrame:
    """(ordinal, fault) of pairs that cannot become part of a document."""
    fault = F.when(F.col("doc_key").isNull(), "no key").when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text").when(F.coalesce(F.trim("image_path"), F.lit("")) == "", "no image")
    return pairs.select("ordinal", fault.alias("fault")).where("fault IS NOT NULL")


def text_conflicts(pairs: DataFrame) -> DataFrame:
    """(doc_key) of documents whose pairs have different texts: an error for A01."""
    return usable_pairs(pairs).groupBy("doc_key").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("doc_key")


def documents_of(pairs: DataFrame) -> DataFrame:
    """(doc_row, doc_key, text, source, split, first_ordinal), ids by first appearance, text of the first pair."""
    g = usable_pairs(pairs).groupBy("doc_key").agg(
        F.min("ordinal").alias("first_ordinal"),
        F.min_by("text", "ordinal").alias("text"),
        F.min_by("source", "ordinal").alias("source"),
        F.min_by("split", "ordinal").alias("split"),
    )
    return dense_ids(g, "first_ordinal", "doc_row").select("doc_row", "doc_key", "text", "source", "split", "first_ordinal")


def images_of(pairs: DataFrame) -> DataFrame:
    """(image_row, image_path, image_id, first_ordinal): images are one per path, ids by first appearance."""
    g = usable_pairs(pairs).groupBy("image_path").agg(F.min("ordinal").alias("first_ordinal"), F.min_by("image_id", "ordinal").alias("image_id"))
    return dense_ids(g, "first_ordinal", "image_row").select("image_row", "image_path", "image_id", "first_ordinal")


def relation_of(pairs: DataFrame) -> DataFrame:
    """Distinct (doc_row, image_row, first_ordinal) edges."""
    edges = usable_pairs(pairs).groupBy("doc_key", "image_path").agg(F.min("ordinal").alias("first_ordinal"))
    rows = edges.join(documents_of(pairs).select("doc_key", "doc_row"), "doc_key").join(images_of(pairs).select("image_path", "image_row"), "image_path")
    return rows.select("doc_row", "image_row", "first_ordinal")


def pair_rows(pairs: DataFrame) -> DataFrame:
    """(ordinal, doc_row, image_row) of every usable pair."""
    p = usable_pairs(pairs).select("ordinal", "doc_key", "image_path")
    return p.join(documents_of(pairs).select("doc_key", "doc_row"), "doc_key").join(images_of(pairs).select("image_path", "image_row"), "image_path").select("ordinal", "doc_row", "image_row")


def item_lists(pairs: DataFrame) -> DataFrame:
    """(doc_key, item_ids): distinct item ids of a document in order of appearance; null ids are left out."""
    one = usable_pairs(pairs).where("item_id IS NOT NULL").groupBy("doc_key", "item_id").agg(F.min("ordinal").alias("o"))
    return one.groupBy("doc_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "item_id"))), lambda x: x["item_id"]).alias("item_ids"))


def kept_images(images: Column) -> Column:
    """an array of (image_id, image_path) without blank paths, the first of each path kept, in order."""
    full = F.filter(images, lambda x: F.trim(x["image_path"]) != "")
    paths = F.transform(full, lambda x: x["image_path"])
    return F.filter(F.transform(full, lambda x, i: F.struct(x["image_id"].alias("image_id"), x["image_path"].alias("image_path"), (F.array_position(paths, x["image_path"]) == i + 1).alias("first"))), lambda x: x["first"])


def normalized_documents(docs: DataFrame) -> DataFrame:
    """(doc_row, doc_key, position, image_id, image_path) from documents (ordinal, doc_key, images).

    Blank and repeated paths of a document are dropped, the position is that within its list;
    documents keep their order and get dense ids; those left without image give no rows.
    """
    ids = dense_ids(docs.select("ordinal", "doc_key", "images"), "ordinal", "doc_row")
    return ids.select("doc_row", "doc_key", F.posexplode(kept_images(F.col("images"))).alias("position", "i")).select("doc_row", "doc_key", "position", "i.image_id", "i.image_path")


def duplicate_keys(docs: DataFrame, key: str) -> DataFrame:
    """V5: keys that occur more than once, with their counts."""
    return docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def image_lists(relation: DataFrame) -> DataFrame:
    """(doc_row, image_rows) ascending."""
    return relation.select("doc_row", "image_row").distinct().groupBy("doc_row").agg(F.array_sort(F.collect_list("image_row")).alias("image_rows"))


def without_images(docs: DataFrame, relation: DataFrame) -> DataFrame:
    """Documents that have no image (an error there)."""
    return docs.join(relation, "doc_row", "left_anti").select("doc_row")


def both_ways(edges: DataFrame) -> DataFrame:
    """(uid, other, direction): the relation read from either side, without repetitions."""
    e = edges.distinct()
    return e.select(F.col("text_uid").alias("uid"), F.col("image_uid").alias("other"), F.lit("text").alias("direction")).unionByName(e.select(F.col("image_uid").alias("uid"), F.col("text_uid").alias("other"), F.lit("image").alias("direction")))


def merged_relations(parts: list[DataFrame]) -> DataFrame:
    """Union of the relations of several sources."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def compressed_rows(relation: DataFrame, side: str, other: str) -> DataFrame:
    """(side, begin, end) offsets of each row's entries in the relation ordered by (side, other)."""
    counts = relation.select(side, other).distinct().groupBy(side).agg(F.count("*").alias("n"))
    return running(counts, side, F.col("n"), "begin").select(side, "begin", (F.col("begin") + F.col("n")).alias("end"))


def expanded_rows(offsets: DataFrame, side: str) -> DataFrame:
    """(side, at) positions that the offsets cover."""
    return offsets.where("end > begin").select(side, F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("at"))


def byte_offsets(df: DataFrame, order: str, line: Column) -> DataFrame:
    """(order, begin, size): where each JSON line starts in a file of all lines."""
    size = F.octet_length(line) + 1
    return running(df.select(order, size.cast("bigint").alias("size")), order, F.col("size"), "begin").select(order, "begin", "size")


def counters(entries: DataFrame, by: list[str], image: str = "image_id", text: str = "text") -> DataFrame:
    """(by, n_texts, n_images, n_empty): texts, distinct images and empty texts of each group."""
    return entries.groupBy(*by).agg(F.count("*").alias("n_texts"), F.count_distinct(image).alias("n_images"), F.count_if(F.col(text).isNull() | (F.col(text) == "")).alias("n_empty"))


def header(docs: DataFrame, images: DataFrame, relation: DataFrame, version: int = 2) -> DataFrame:
    """One row of counts."""
    return one_row([docs.agg(F.count("*").alias("document_count")), images.agg(F.count("*").alias("image_count")), relation.agg(F.count("*").alias("relation_count"))]).select(F.lit(version).alias("schema_version"), "document_count", "image_count", "relation_count")


def one_row(parts: list[DataFrame]) -> DataFrame:
    """One row of all columns of tables of one row each, without a join: padded, united, maximum."""
    names = [c for p in parts for c in p.columns]
    types = {c: p.schema[c].dataType for p in parts for c in p.columns}
    padded = [p.select(*[F.col(c) if c in p.columns else F.lit(None).cast(types[c]).alias(c) for c in names]) for p in parts]
    out = padded[0]
    for p in padded[1:]:
        out = out.unionByName(p)
    return out.agg(*[F.max(c).alias(c) for c in names])


def manifest_hash(lines: DataFrame, order: str, line: str) -> DataFrame:
    """A24 at scale: SHA-256 per row, and of the ordered row hashes per bucket, and of the ordered bucket hashes.

    A bucket holds 4,096 order values, so nothing unbounded meets in one task but the list of
    bucket hashes (64 bytes per 4,096 rows), which is hashed the same way again.
    """
    level = lines.select(F.col(order).alias("o"), F.sha2(line, 256).alias("h"))
    for _ in range(4):  # 4096^4 rows
        level = level.groupBy(F.floor(F.col("o") / 4096).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256).alias("h")).select(F.col("p").alias("o"), "h")
    return level.select(F.col("h").alias("manifest_hash"))


def ordered_hash(lines: DataFrame, order: str, line: str) -> DataFrame:
    """A24 as defined for small corpora: SHA-256 of all lines in order, each with a line break."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: F.concat(x["l"], F.lit("\n"))), "")
    return lines.agg(F.sha2(joined, 256).alias("manifest_hash"))
