"""Order-dependent columns without sending a table to one task.

A running sum is made in two steps: sums per bucket of the order column (a small table whose
prefix sums are cheap), then running sums inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values that one bucket spans.
WIDTH = 1 << 18


def running(df: DataFrame, order: str, value: Column, name: str, keys: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """df with the exclusive running sum of value, in order of a unique integer column, per keys.

    Null values count 0; null keys are a group of their own. Sums of the buckets are summed
    again over buckets of buckets, so sparse order values (times, hashes) do not bring a row
    for each of theirs into one task; only the upper sums, a row per width^2 order values, meet.
    """
    keys = keys or []
    t = df.withColumn("_b", F.floor(F.col(order) / width)).withColumn("_v", F.coalesce(value, F.lit(0)))
    ks = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    for i, k in enumerate(ks):
        t = t.withColumn(names[i], k)
    before = t.groupBy(*names, "_b").agg(F.sum("_v").alias("_t"))
    before = before.withColumn("_bb", F.floor(F.col("_b") / width))
    rest = (Window.unboundedPreceding, -1)
    upper = before.groupBy(*names, "_bb").agg(F.sum("_t").alias("_t"))
    upper = upper.select(*names, "_bb", F.coalesce(F.sum("_t").over(Window.partitionBy(*(names or [F.lit(0)])).orderBy("_bb").rowsBetween(*rest)), F.lit(0)).alias("_above"))
    lower = F.coalesce(F.sum("_t").over(Window.partitionBy(*names, "_bb").orderBy("_b").rowsBetween(*rest)), F.lit(0))
    before = before.withColumn("_lower", lower).join(upper, [*names, "_bb"]).select(*names, "_b", (F.col("_above") + F.col("_lower")).alias("_before"))
    inside = Window.partitionBy(*names, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return t.join(before, [*names, "_b"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_b", "_v", "_before", "_in", *names)


def dense_ids(df: DataFrame, order: str, name: str, keys: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """df with ids 0, 1, 2, ... in order of a unique integer column."""
    return running(df, order, F.lit(1), name, keys, width).withColumn(name, F.col(name).cast("bigint"))


def batched(df: DataFrame, order: str, size: int, name: str = "batch", keys: list[str] | None = None) -> DataFrame:
    """df with the 0-based number of its batch of `size` rows in order."""
    return dense_ids(df, order, name, keys).withColumn(name, F.floor(F.col(name) / size).cast("bigint"))
