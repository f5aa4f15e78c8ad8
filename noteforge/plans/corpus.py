"""How the test tables play the roles of the note corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.operators.encoding import ClusteredIndex, open_index, write_index
from noteforge.operators.retrieval import unit_rows
from noteforge.session import cut, cut_all, scratch, table
from noteforge.sinks import store


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pair rows: every delivered note with its cover image; doc_id gives the order."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), "doc_key", "text", "source", "split", "item_id", "image_id", "image_path")


PAIRS_SQL = "pairs AS (SELECT doc_id AS ordinal, doc_key, text, source, split, item_id, image_id, image_path FROM documents), good AS (SELECT * FROM pairs WHERE doc_key IS NOT NULL AND trim(text, ' ') <> '' AND trim(image_path, ' ') <> '')"


def relation(spark: SparkSession, d: str) -> DataFrame:
    """(doc_row, image_row): owners of images that exist as notes."""
    owned = table(spark, d, "image_assets").select(F.col("image_row_id").alias("image_row"), F.explode("doc_row_ids").alias("doc_row")).where("doc_row IS NOT NULL").distinct()
    return owned.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc_row")), "doc_row", "left_semi").select("doc_row", "image_row")


RELATION_SQL = "relation AS (SELECT DISTINCT u.doc AS doc_row, image_row_id AS image_row FROM image_assets, unnest(doc_row_ids) AS u(doc) WHERE u.doc IN (SELECT doc_id FROM documents))"


def unit_vectors(spark: SparkSession, d: str, modality: str, row: str) -> DataFrame:
    """(row, v): usable vectors in unit length, double."""
    return unit_rows(table(spark, d, f"{modality}_embeddings"), "row_id", "embedding", row)


#: What was built in the shared folder, by application and data directory; it is built again once its files are gone.
_BUILT: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, d: str, name: str, build) -> str:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT or not store.exists(spark, _BUILT[key]):
        path = scratch(spark, name)
        build(path)
        _BUILT[key] = path
    return _BUILT[key]


def bundle(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, images, edges) of documents that have a usable text vector and a usable image, in unit length; written once and read from then on."""
    def build(path: str) -> None:
        texts, images = cut_all(*[unit_vectors(spark, d, m, row) for m, row in (("text", "doc_row"), ("image", "image_row"))])
        edges = cut(relation(spark, d).join(texts.select("doc_row"), "doc_row", "left_semi").join(images.select("image_row"), "image_row", "left_semi").select("doc_row", "image_row"), "edges")
        texts.join(edges, "doc_row", "left_semi").write.parquet(f"{path}/texts")
        images.join(edges, "image_row", "left_semi").write.parquet(f"{path}/images")
        edges.write.parquet(f"{path}/edges")

    path = _once(spark, d, "bundle", build)
    kinds = {"texts": "doc_row bigint, v array<double>", "images": "image_row bigint, v array<double>", "edges": "doc_row bigint, image_row bigint"}
    texts, images, edges = (spark.read.schema(k).parquet(f"{path}/{n}") for n, k in kinds.items())
    return texts, images, edges


def index(spark: SparkSession, d: str, modality: str) -> ClusteredIndex:
    """The clustered index of the bundle's text or image vectors; written once and read from then on."""
    texts, images, _ = bundle(spark, d)
    vectors, row = (texts, "doc_row") if modality == "text" else (images, "image_row")
    contract = {"model_fingerprint": "m1", "data_manifest_hash": "h1", "dimension": 64, "normalization": "L2"}
    return open_index(spark, _once(spark, d, f"index-{modality}", lambda path: write_index(vectors, row, path, contract)), contract)


def _vectors_sql(modality: str, row: str) -> str:
    return f"""(SELECT row_id AS {row}, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS v FROM
      (SELECT row_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM {modality}_embeddings
       WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))) WHERE n > 0)"""


TEXT_SQL = f"text_vec AS MATERIALIZED {_vectors_sql('text', 'doc_row')}"
IMAGE_SQL = f"image_vec AS MATERIALIZED {_vectors_sql('image', 'image_row')}"
