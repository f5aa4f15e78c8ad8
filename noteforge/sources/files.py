"""File sources: JSON lines, strict text, annotations, binary payloads, bundles, configuration."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noteforge.functions.text import from_base64

ANNOTATION = "text_id string, text string, image_ids array<string>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): text lines with their numbers from 1, counted block by block, so no file meets in one task."""
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    per = t.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = per.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = t.withColumn("r", F.row_number().over(Window.partitionBy("file", "block").orderBy("m")))
    return inside.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("r")).alias("line"), "value")


def jsonl_faults(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of lines that are neither blank nor a JSON object."""
    kind = F.expr("schema_of_variant(try_parse_json(value))")
    return numbered_lines(spark, path).where((F.trim("value") != "") & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True, limit: int | None = None) -> DataFrame:
    """JSON objects, one per line; blank lines are skipped.

    strict: a line that is no JSON object is an error that names file and line, a value that
    does not fit the schema fails the job when it is read; otherwise either gives a row of
    nulls with the line in _corrupt. limit takes the first objects in order of file and line.
    """
    if strict:
        fault = jsonl_faults(spark, path).orderBy("file", "line").first()
        if fault:
            raise ValueError(f"{fault['file']}:{fault['line']} is no JSON object")
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        full = spark.createDataFrame([], schema).schema.add("_corrupt", "string")
        df = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if limit is None:
        return df
    rows = numbered_lines(spark, path).where(F.trim("value") != "").orderBy("file", "line").limit(max(0, limit))
    options = {"mode": "FAILFAST"} if strict else {"columnNameOfCorruptRecord": "_corrupt"}
    return rows.select(F.from_json("value", df.schema, options).alias("j")).select("j.*")


def stream_jsonl(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """The same lines as an unbounded source."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def strict_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, faults): text lines of the files, and those that are no valid UTF-8, by file."""
    t = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    return t.where(F.is_valid_utf8("line")), t.where(~F.is_valid_utf8("line")).select("file", F.hex(F.col("line").cast("binary")).alias("bytes"))


def annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): annotations with distinct image ids; faults are missing fields and repeated text ids."""
    raw = read_jsonl(spark, path, ANNOTATION, strict=False)
    rows = raw.where("text_id IS NOT NULL AND text IS NOT NULL AND image_ids IS NOT NULL").withColumn("image_ids", F.array_distinct("image_ids")).drop("_corrupt")
    lost = raw.where("text_id IS NULL OR text IS NULL OR image_ids IS NULL").select("text_id", F.lit("missing field").alias("fault"))
    again = rows.groupBy("text_id").agg(F.count("*").alias("n")).where("n > 1").select("text_id", F.lit("repeated text id").alias("fault"))
    return rows.drop("_corrupt"), lost.unionByName(again)


def image_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, size, content) of image payload files, the counter key `num_images` left out."""
    t = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return t.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("size"), "content").where("name <> 'num_images'")


#: Key of the row that counts the others in a pair store.
COUNTER = "num_samples"


def pair_store(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, image_id, text_id, text, image) of a store of pairs: Parquet or JSON rows (key, image_id, text_id, text, image).

    The row with key `num_samples` states the number of pairs in its text; a number that does
    not hold, or keys that are not 0, 1, 2, ..., are an error. Pickled records are never read.
    """
    raw = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    pairs = raw.where(F.col("key") != COUNTER).withColumn("ordinal", F.expr("try_cast(key AS BIGINT)"))
    stated = raw.where(F.col("key") == COUNTER).agg(F.max(F.expr("try_cast(text AS BIGINT)"))).first()[0]
    n, bad, hi, distinct = pairs.agg(F.count("*"), F.count_if(F.col("ordinal").isNull() | (F.col("ordinal") < 0)), F.max("ordinal"), F.count_distinct("ordinal")).first()
    if bad or distinct != n or (n and hi != n - 1) or (stated is not None and stated != n):
        raise ValueError(f"the store states {stated} pairs and holds {n} with keys up to {hi}")
    return pairs.select("ordinal", "image_id", "text_id", "text", "image")


def scan_pairs(pairs: DataFrame, image_id: str, text_id: str, text: str, source: str | None = None) -> DataFrame:
    """Relation of stored pairs: distinct (image_id, text_id), with the source before each id if one is given, and the first text of each."""
    def uid(c: str) -> Column:
        plain = F.col(c).cast("string")
        return plain if source is None else F.concat(F.lit(f"{source}:"), plain)

    return pairs.where(F.col(image_id).isNotNull() & F.col(text_id).isNotNull()).groupBy(uid(image_id).alias("image_id"), uid(text_id).alias("text_id")).agg(F.min(text).alias("text"))


def pair_at(pairs: DataFrame, order: str, index: int, count: int) -> DataFrame:
    """The pair at an index, negative from the end; an index out of range is an error."""
    at = index + count if index < 0 else index
    if not 0 <= at < count:
        raise IndexError(index)
    return pairs.where(F.col(order) == at)


def decoded_pair(pairs: DataFrame, source: str) -> DataFrame:
    """(image_uid, text_uid, text, payload): ids with the source before them, the image from Base64 of either alphabet, padded or not."""
    return pairs.select(F.concat(F.lit(f"{source}:"), F.col("image_id").cast("string")).alias("image_uid"), F.concat(F.lit(f"{source}:"), F.col("text_id").cast("string")).alias("text_uid"), "text", from_base64(F.col("image")).alias("payload"))


def load_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Documents, images and relation of a bundle written by sinks.files.write_bundle."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("documents", "images", "relation")}


def load_json(path: str, default: Any = None) -> Any:
    """A JSON file, or the default if there is none."""
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_config(path: str) -> dict:
    """A JSON or YAML mapping; anything else is an error. YAML needs its library."""
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            found = yaml.safe_load(f)
        else:
            found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def section(config: dict, name: str) -> dict:
    """A section, empty if missing; one that is no mapping is an error."""
    found = config.get(name) or {}
    if not isinstance(found, dict):
        raise ValueError(f"section {name} is no mapping")
    return found


def resolve(path: str, root: str) -> str:
    """Absolute paths stay, relative ones are joined to root."""
    return path if os.path.isabs(path) else os.path.join(root, path)
