"""Sinks: JSON lines, CSV, atomic files, bundles with checksums, verified builds, reports."""

from __future__ import annotations

import csv
import hashlib
import json
import math
import os
import shutil
import tempfile
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.sinks import store


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in parallel; non-ASCII stays, nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_ready(x: Any) -> Any:
    """JSON-safe: NaN and infinities become null, rows and tuples lists or objects, anything odd a string."""
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if hasattr(x, "asDict"):
        return json_ready(x.asDict(recursive=True))
    if isinstance(x, dict):
        return {str(k): json_ready(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [json_ready(v) for v in (sorted(x, key=str) if isinstance(x, set) else x)]
    if hasattr(x, "item"):
        return json_ready(x.item())
    return str(x)


def json_text(data: Any) -> str:
    return json.dumps(json_ready(data), ensure_ascii=False, indent=2, sort_keys=True)


def write_atomic(path: str, data: Any, sync: bool = True) -> None:
    """JSON to a temporary file beside the target, then put in its place in one step."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".", suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(json_text(data))
            if sync:
                f.flush()
                os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def write_csv(rows: Iterable[dict], path: str, columns: list[str]) -> None:
    """One CSV file with byte order mark and fixed columns; other keys are left out. For reports, not tables."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.DictWriter(f, fieldnames=columns, extrasaction="ignore")
        w.writeheader()
        w.writerows(rows)


def write_csv_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """K05 for tables: a directory of CSV parts with headers."""
    df.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def result_json(results: DataFrame) -> DataFrame:
    """One JSON text per result row."""
    return results.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def table_checksum(df: DataFrame) -> str:
    """A checksum of a table whatever its order: rows, and the sum of their hashes."""
    h = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in df.columns]).cast("decimal(38,0)")
    n, s = df.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0))).first()
    return hashlib.sha256(f"{n}:{s}".encode()).hexdigest()


def write_bundle(spark: SparkSession, path: str, documents: DataFrame, images: DataFrame, relation: DataFrame, contract: dict | None = None) -> dict:
    """Documents, images and relation as Parquet, and a manifest with counts and checksums, written last."""
    manifest: dict[str, Any] = {"schema_version": 2, "compatibility": contract or {}, "tables": {}}
    for name, df in (("documents", documents), ("images", images), ("relation", relation)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        manifest["tables"][name] = {"rows": back.count(), "checksum": table_checksum(back)}
    store.write_text(spark, f"{path}/manifest.json", json_text(manifest))
    return manifest


def verify_bundle(spark: SparkSession, path: str) -> list[str]:
    """V2: what of a bundle's tables does not agree with its manifest."""
    if not store.exists(spark, f"{path}/manifest.json"):
        return ["no manifest"]
    manifest = json.loads(store.read_text(spark, f"{path}/manifest.json"))
    out = [] if manifest.get("schema_version") == 2 else ["schema version: migrate the bundle"]
    for name, want in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if df.count() != want["rows"] or table_checksum(df) != want["checksum"]:
            out.append(name)
    return out


def build_dataset(spark: SparkSession, path: str, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], list[str]] | None = None) -> None:
    """Tables to a staging directory, read back and compared, then put in the place of the old directory.

    If anything differs or the check finds faults, the old directory stays.
    """
    staging = f"{path}.staging"
    store.delete(spark, staging)
    try:
        back = {}
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
            back[name] = spark.read.parquet(f"{staging}/{name}")
            if table_checksum(back[name]) != table_checksum(df):
                raise ValueError(f"{name} reads back otherwise than written")
        if check and (faults := check(back)):
            raise ValueError("; ".join(faults))
    except BaseException:
        store.delete(spark, staging)
        raise
    commit_files(spark, [(staging, path)])


def commit_files(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Put several files or directories in place together, on any file system; if one move fails all are undone."""
    done: list[tuple[str, str, str | None]] = []
    try:
        for new, target in moves:
            backup = None
            if store.exists(spark, target):
                backup = f"{target}.backup"
                store.delete(spark, backup)
                store.rename(spark, target, backup)
            done.append((new, target, backup))
            store.rename(spark, new, target)
    except BaseException:
        for new, target, backup in reversed(done):
            if store.exists(spark, target) and not store.exists(spark, new):
                store.rename(spark, target, new)
            if backup:
                store.rename(spark, backup, target)
        raise
    for _, _, backup in done:
        if backup:
            store.delete(spark, backup)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]])


def metric_report(macro: dict, per_query: list[dict], bad: list[dict], first_bad: int = 10) -> str:
    """A report in Markdown: the means, each query, and the first bad queries only."""
    parts = ["# Retrieval metrics", "", *[f"- {k}: {v:.4f}" if isinstance(v, float) else f"- {k}: {v}" for k, v in macro.items()]]
    for title, rows in (("Queries", per_query), ("Bad queries", bad[:first_bad])):
        parts += ["", f"## {title}", "", markdown_table(rows, list(rows[0])) if rows else "none"]
    return "\n".join(parts) + "\n"


def query_set(spark: SparkSession, queries: list[tuple[str, str]]) -> DataFrame:
    """(query_id, query, rule) of a set of evaluation queries with an empty rule to fill in."""
    return spark.createDataFrame([(i, q, "") for i, q in queries], "query_id string, query string, rule string")


def evaluation_template(candidates: DataFrame) -> DataFrame:
    """Candidates with an empty label and reason for each row to fill in, in order of query and rank."""
    return candidates.withColumn("label", F.lit("")).withColumn("label_reason", F.lit("")).orderBy("query_id", "rank")


def summary(counts: dict[str, Any], issues: DataFrame) -> str:
    """A summary in Markdown: the counts, and how many rows each reason took out (one row per reason)."""
    rows = [r.asDict() for r in issues.groupBy("reason").agg(F.count("*").alias("rows")).orderBy("reason").collect()]
    parts = ["# Preparation", "", *[f"- {k}: {v}" for k, v in counts.items()], "", "## Left out", "", markdown_table(rows, ["reason", "rows"]) if rows else "none"]
    return "\n".join(parts) + "\n"


def reset_dir(path: str) -> None:
    """An empty directory; refuses the root and the home directory."""
    full = os.path.realpath(path)
    if full in ("/", os.path.realpath(os.path.expanduser("~"))):
        raise ValueError(f"will not empty {full}")
    shutil.rmtree(full, ignore_errors=True)
    os.makedirs(full)
