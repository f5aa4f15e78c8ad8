"""Rows by position: random access, concatenated sources, index lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteforge.operators.ordering import dense_ids


def rows_at(df: DataFrame, row: str, wanted: list[int]) -> DataFrame:
    """Rows of the given numbers; negative ones count from the end (-1 is the last). Missing numbers give nothing."""
    resolved = [i for i in wanted if i >= 0]
    if any(i < 0 for i in wanted):
        last = df.agg(F.max(row)).first()[0]
        resolved += [last + 1 + i for i in wanted if i < 0 and last is not None and last + 1 + i >= 0]
    return df.where(F.col(row).isin(resolved))


def rows_between(df: DataFrame, row: str, start: int, stop: int) -> DataFrame:
    """Rows start <= number < stop; the range reaches the Parquet scan."""
    return df.where((F.col(row) >= start) & (F.col(row) < stop))


def lookup(edges: DataFrame, row: str, wanted: list[int | slice]) -> DataFrame:
    """The entries of rows given by number, negative ones from the end (-1 is the last row), or by slice.

    A number out of range is an error, a slice stops at the ends; steps other than 1 are refused.
    """
    last = edges.agg(F.max(row)).first()[0]
    n = 0 if last is None else last + 1
    condition = F.lit(False)
    numbers = []
    for w in wanted:
        if isinstance(w, slice):
            start, stop, step = w.indices(n)
            if step != 1:
                raise ValueError("steps other than 1 are not supported")
            condition = condition | ((F.col(row) >= start) & (F.col(row) < stop))
        elif not -n <= w < n:
            raise IndexError(w)
        else:
            numbers.append(w % n)
    return edges.where(condition | F.col(row).isin(numbers) if numbers else condition)


def grouped_rows(edges: DataFrame, row: str, other: str, name: str) -> DataFrame:
    """(row, name): the distinct entries of each row in ascending order; a row whose entries are null has an empty list."""
    return edges.groupBy(row).agg(F.array_sort(F.collect_set(other)).alias(name))


def source_starts(sizes: DataFrame, source: str, n: str) -> DataFrame:
    """(source, n, start): first global index of each source, in order of name (one row per source)."""
    w = Window.partitionBy(F.lit(0)).orderBy(source).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(source, n, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("bigint").alias("start"))


def concatenated(df: DataFrame, source: str, order: str) -> DataFrame:
    """(source, order, global_index): all sources one after the other, each in its order."""
    starts = source_starts(df.groupBy(source).agg(F.count("*").alias("n")), source, "n").select(source, "start")
    return dense_ids(df.select(source, order), order, "local", [source]).join(starts, source).select(source, order, (F.col("start") + F.col("local")).alias("global_index"))


def source_of_index(sizes: DataFrame, source: str, n: str) -> DataFrame:
    """(global_index, source, local_index) of every index, by expanding each source's range where it is."""
    starts = source_starts(sizes, source, n)
    step = 1 << 16
    chunks = starts.where(F.col(n) > 0).select(source, "start", F.col(n).alias("n"), F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / step))).alias("chunk"))
    inside = chunks.select(source, "start", F.explode(F.sequence(F.col("chunk") * step, F.least(F.col("n"), (F.col("chunk") + 1) * step) - 1)).alias("local_index"))
    return inside.select((F.col("start") + F.col("local_index")).alias("global_index"), source, F.col("local_index").cast("bigint").alias("local_index"))
