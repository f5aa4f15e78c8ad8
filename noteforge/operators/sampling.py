"""Samplers, allocation, running bests."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def order_key(seed: int, *cols: str) -> Column:
    """A reproducible pseudo-random key per row: 64 bits of a hash of the seed and the columns."""
    return F.xxhash64(F.lit(seed), *cols)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int, offset: int = 0) -> DataFrame:
    """N rows from `offset` on in the seeded permutation; other rows than other generators give.

    Takes part per partition and merges (TakeOrderedAndProject); the same seed and offset give
    disjoint consecutive samples.
    """
    return df.withColumn("_o", order_key(seed, key)).orderBy("_o", key).offset(offset).limit(n).drop("_o")


def allocate(sizes: DataFrame, source: str, n: str, total: int, exponent: float = 0.5) -> DataFrame:
    """(source, n, p, allocated): p proportional to n^exponent, largest remainders get the rest, ties by order of source.

    One row per source, so the windows over all sources are small.
    """
    whole = Window.partitionBy(F.lit(0))
    t = sizes.where(F.col(n) > 0).select(source, F.col(n).alias("n"), F.pow(F.col(n).cast("double"), F.lit(exponent)).alias("_w"))
    t = t.withColumn("p", F.col("_w") / F.sum("_w").over(whole)).withColumn("_x", F.col("p") * total)
    t = t.withColumn("_base", F.floor("_x")).withColumn("_frac", F.round(F.col("_x") - F.col("_base"), 9))
    t = t.withColumn("_rest", F.lit(total) - F.sum("_base").over(whole)).withColumn("_rank", F.row_number().over(whole.orderBy(F.desc("_frac"), source)))
    return t.select(source, "n", "p", (F.col("_base") + F.when(F.col("_rank") <= F.col("_rest"), 1).otherwise(0)).cast("bigint").alias("allocated"))


def balanced_epoch(df: DataFrame, source: str, key: str, total: int, seed: int, epoch: int = 0, exponent: float = 0.5) -> DataFrame:
    """One epoch of the temperature-balanced sampler: (source, key, pass, position_key).

    Every source gives its allocation: whole passes without replacement, each reshuffled, and
    the first rows of a last pass. Sort by position_key for the global order; a cursor is a
    position in it. The last pass is cut with a two-step count over hash ranges, so no source
    has to meet in one task.
    """
    sizes = df.groupBy(source).agg(F.count("*").alias("n"))
    plan = allocate(sizes, source, "n", total, exponent).select(source, F.col("n").alias("_n"), "allocated", F.floor(F.col("allocated") / F.col("n")).alias("_full"), (F.col("allocated") % F.col("n")).alias("_part"))
    rows = df.select(source, key).join(F.broadcast(plan), source)  # one row per source
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full")))).where((F.col("pass") < F.col("_full")) | (F.col("_part") > 0))
    rows = rows.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "pass", key), F.lit(1 << 40)))
    full = rows.where(F.col("pass") < F.col("_full"))
    last = rows.where(F.col("pass") == F.col("_full")).withColumn("_b", F.floor(F.col("_h") * F.greatest(F.lit(1), F.floor(F.col("_n") / 100_000)) / F.lit(float(1 << 40))))
    per = last.groupBy(source, "_b").agg(F.count("*").alias("_c"))
    before = per.select(source, "_b", F.coalesce(F.sum("_c").over(Window.partitionBy(source).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(source, "_b").orderBy("_h", key))
    last = last.withColumn("_in", inside).join(before, [source, "_b"]).where(F.col("_before") + F.col("_in") <= F.col("_part"))
    out = full.select(source, key, "pass").unionByName(last.select(source, key, "pass"))
    return out.withColumn("position_key", F.xxhash64(F.lit(seed + 1), F.lit(epoch), "pass", source, key))


def best_so_far(df: DataFrame, run: str, step: str, metric: str, patience: int, least: float = 0.0) -> DataFrame:
    """Per run and step the best metric before, whether it improved (by more than `least`), how many steps in a row did not, and whether to stop.

    A null metric neither improves nor counts as the best. One run's steps are one window.
    """
    w = Window.partitionBy(run).orderBy(step)
    t = df.select(run, step, metric).withColumn("best_before", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("improved", F.coalesce((F.col(metric) > F.col("best_before") + least) | (F.col("best_before").isNull() & F.col(metric).isNotNull()), F.lit(False)))
    t = t.withColumn("_g", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("bad_steps", F.sum((~F.col("improved")).cast("int")).over(Window.partitionBy(run, "_g").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("stop", F.col("bad_steps") >= patience).drop("_g")


def resume_mismatches(saved: dict, current: dict, fields: tuple[str, ...]) -> list[str]:
    """V8: fields of a sampler or trainer state that differ, or are missing on a side."""
    return [f for f in fields if f not in saved or f not in current or saved[f] != current[f]]


def resume_differences(saved: DataFrame, current: DataFrame, key: str = "field", value: str = "value") -> DataFrame:
    """V8 over tables of (field, value): (field, saved, current) that differ or are missing on a side; both null are equal."""
    a = saved.select(key, F.col(value).cast("string").alias("saved"), F.lit(1).alias("_a"))
    b = current.select(key, F.col(value).cast("string").alias("current"), F.lit(1).alias("_b"))
    both = a.join(b, key, "full")
    return both.where("_a IS NULL OR _b IS NULL OR NOT (saved <=> current)").select(key, "saved", "current")


def latest(df: DataFrame, time: str, name: str) -> DataFrame:
    """The row with the latest time, ties to the greater name; none of an empty table."""
    return df.orderBy(F.desc(time), F.desc(name)).limit(1)
