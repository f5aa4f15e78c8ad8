"""P5: records that differ only in formatting are collapsed into one each, with their number of copies."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteforge.llm.forms import content, fields
from noteforge.session import cut, ship

#: Records of one content from which they are split.
HOT = 100_000

_FIELDS, _PAIR = "\x1e", "\x1f"


def _pair_hash(name: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b((name + value).encode("utf-8", "surrogatepass"), digest_size=16).digest(), "little")


def fingerprint(text: str | None, bits: int = 128) -> tuple[bytes, str] | None:
    """(multiset hash, normalized fields) of a text; None if it has no letter or digit.

    Every (name, value) pair is hashed and the hashes are added modulo 2^bits, so order does
    not matter and nothing is sorted; a text that is no field list is one pair without name.
    """
    pairs = fields(text)
    if pairs is None:
        whole = content(text)
        if not whole:
            return None
        pairs = [("", whole)]
    total = sum(_pair_hash(n, v) for n, v in pairs) & ((1 << bits) - 1)
    return total.to_bytes(16, "little"), _FIELDS.join(n + _PAIR + v for n, v in pairs)


def same_fields(a: str | None, b: str | None) -> bool:
    """Equal as multisets of fields (counted, not sorted)."""
    if a is None or b is None:
        return a is b

    def count(x: str) -> Counter:
        return Counter(f.replace(_PAIR, "") for f in x.split(_FIELDS))

    return a == b or count(a) == count(b)


def _fingerprints(df: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            rows = ([], [], [], [])
            for name, i, text in zip(names, ids, texts):
                if (found := fingerprint(text, bits)) is not None:
                    for out, value in zip(rows, (name, i, *found)):
                        out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.string())], names=["table_name", "id", "print", "norm"])

    return df.mapInArrow(run, "table_name string, id bigint, print binary, norm string")


def membership(df: DataFrame, bits: int = 128, hot: int = HOT) -> DataFrame:
    """(table_name, first_id, id): every record with the first record of its content, itself if there is none before.

    Null texts and texts without letter or digit take no part. Fingerprints only propose:
    each member's fields are compared with those of the first, and members that differ (a
    collision) are grouped again among themselves until none is left. Texts move once, to
    their fingerprint; a fingerprint with more than `hot` records is split by record, and the
    first record's text goes to the parts (at most records / hot of them).
    """
    ship(df.sparkSession)
    same = F.udf(same_fields, "boolean", useArrow=True)
    left = cut(_fingerprints(df.select("table_name", "id", "text"), bits), "prints")
    keys = ["table_name", "print"]
    done: DataFrame | None = None
    while True:
        many = left.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("hot_id")).where(F.col("n") > hot)
        many = F.broadcast(many)
        first = left.join(many, keys).where("id = hot_id").groupBy(*keys).agg(F.first("n").alias("n"), F.first("id").alias("hot_id"), F.first("norm").alias("hot_norm"))
        rows = left.join(F.broadcast(first), keys, "left")
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("n") / hot), F.lit(1))).cast("int"))
        order = Window.partitionBy(*keys, "part").orderBy("id")
        rows = rows.withColumn("first_id", F.coalesce("hot_id", F.first("id").over(order))).withColumn("first_norm", F.coalesce("hot_norm", F.first("norm").over(order)))
        moved = F.col("norm") != F.col("first_norm")  # in the same order there is nothing to compare further
        checked = rows.withColumn("ok", ~moved | same(F.when(moved, F.col("norm")), F.when(moved, F.col("first_norm"))))
        checked = cut(checked.select("table_name", "first_id", "id", "print", F.when(~F.col("ok"), F.col("norm")).alias("norm"), "ok"), "verified")
        good = checked.where("ok").select("table_name", "first_id", "id")
        done = good if done is None else done.unionByName(good)
        rest = checked.where("NOT ok")
        if rest.isEmpty():
            return done
        left = rest.select("table_name", "id", "print", "norm")


def copy_members(df: DataFrame, bits: int = 128, hot: int = HOT) -> DataFrame:
    """Every copy of (table_name, id, text) with the first record of its content: (table_name, first_id, copy_id).

    The first has no row of its own. Null texts and texts without letter or digit take no
    part; exact copies count; empty input gives no rows; extra columns are ignored; rows with
    one id count as one record.
    """
    return membership(df, bits, hot).where("id <> first_id").select("table_name", "first_id", F.col("id").alias("copy_id"))


def collapse_copies(df: DataFrame, bits: int = 128, hot: int = HOT) -> DataFrame:
    """One row per distinct content: (table_name, first_id, n_copies), n_copies counting the first too."""
    return membership(df, bits, hot).groupBy("table_name", "first_id").agg(F.count("*").alias("n_copies"))
