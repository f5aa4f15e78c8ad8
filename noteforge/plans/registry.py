"""The registry of core queries: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noteforge.plans import document_queries, evaluation_queries, extra_queries, integrity_queries, reference_queries, retrieval_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [document_queries, evaluation_queries, extra_queries, integrity_queries, reference_queries, retrieval_queries, text_queries]


def _all() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for module in MODULES:
        for name, pair in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = pair
    return out


def queries() -> dict[str, Query]:
    return {k: v[0] for k, v in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _all().items() if v[1]}


#: Data of the flagship query, unless another directory is given.
SMALLEST = "/root/testdata/sf0.001"


def entry(spark: SparkSession, sf_dir: str = SMALLEST) -> DataFrame:
    """Flagship: joint search of the smallest data directory."""
    return retrieval_queries.QUERIES["r3_search_joint"][0](spark, sf_dir)
