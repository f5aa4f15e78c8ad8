"""Set operations over rows (U1-U4) and truncation (T10). Null rows are rows, as in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side, each once; columns go together by name."""
    return left.unionByName(right).distinct()


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both sides."""
    return left.unionByName(right)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that both sides have."""
    return left.intersect(right.select(*left.columns))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """U4: distinct rows that only the left side has."""
    return left.subtract(right.select(*left.columns))


def truncated(df: DataFrame, row: str, n: int) -> DataFrame:
    """The rows numbered below n, none if n <= 0; the range reaches a Parquet scan."""
    return df.where(F.col(row) < max(0, n))
