"""Text that looks the same is brought to one form, and the records that then coincide are found."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.forms import LatticeReader, bigram_counts, content, has_word, pure_tokens
from noteforge.session import cut, salted_join, ship


def bigram_model(texts: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Letter bigrams of all texts, counted where they are and summed.

    The model has at most (letters of three scripts)^2 rows, whatever the corpus size.
    """
    ship(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        pairs: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    tokens.update(pure_tokens(text))
            if len(tokens) > 500_000:
                pairs.update(bigram_counts(tokens))
                tokens.clear()
        pairs.update(bigram_counts(tokens))
        if pairs:
            yield pa.RecordBatch.from_pydict({"pair": list(pairs), "n": list(pairs.values())}, schema=pa.schema([("pair", pa.string()), ("n", pa.int64())]))

    counted = texts.select(F.col(text_col).alias("t")).mapInArrow(count, "pair string, n bigint")
    return {r[0]: int(r[1]) for r in counted.groupBy("pair").agg(F.sum("n")).collect()}


def consistent_text(df: DataFrame, text_col: str, out_col: str = "consistent_text", model: dict[str, int] | None = None) -> DataFrame:
    """df with the one consistent form of text_col. Null stays null; empty and very long texts are read whole."""
    ship(df.sparkSession)
    known = bigram_model(df, text_col) if model is None else model

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = LatticeReader(known)
        for s in batches:
            yield s.map(lambda t: None if t is None else reader.text(t))

    return df.withColumn(out_col, read(F.col(text_col)))


def _digests(df: DataFrame, model: dict[str, int]) -> DataFrame:
    """(table_name, id, text) -> (table_name, id, form, raw): 16-byte digests of consistent and raw text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LatticeReader(model)
        for batch in batches:
            names, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = ([], [], [], [])
            for name, i, text in zip(names, ids, texts):
                if text is None or not has_word(text) or not content(text):
                    continue
                form = reader.text(text)
                raw = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                same = form == text
                key = raw if same else hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for out, value in zip(rows, (name, i, key, raw)):
                    out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["table_name", "id", "form", "raw"])

    return df.mapInArrow(digest, "table_name string, id bigint, form binary, raw binary")


def lookalike_twins(df: DataFrame) -> DataFrame:
    """Records of (table_name, id, text) that look like the first of their group but are spelt otherwise.

    Result: (table_name, first_id, twin_id). Texts that are null or have no letter or digit
    take no part; exact repetitions of the first's text give no row; an empty table gives no
    rows. Extra columns are ignored. Digests are 128 bit. Hot groups are split by
    their counts.
    """
    ship(df.sparkSession)
    df = df.select("table_name", "id", "text")
    rows = cut(_digests(df, bigram_model(df)), "forms")
    groups = (
        rows.groupBy("table_name", "form")
        .agg(F.min(F.struct("id", "raw")).alias("f"), F.min("raw").alias("lo"), F.max("raw").alias("hi"))
        .where("lo <> hi")
        .select("table_name", "form", F.col("f.id").alias("first_id"), F.col("f.raw").alias("first_raw"))
    )
    twins = salted_join(rows, groups, ["table_name", "form"], "id").where("raw <> first_raw")
    return twins.select("table_name", "first_id", F.col("id").alias("twin_id"))
