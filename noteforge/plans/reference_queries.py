"""Queries of the orphan-reference operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteforge.operators import references as R
from noteforge.session import cut, table


def _refs(spark: SparkSession, d: str) -> DataFrame:
    docs = R.references(table(spark, d, "documents"), "documents", "doc_id", R.trimmed(F.col("image_path")), "ingested_at")
    assets = table(spark, d, "image_assets").select("image_row_id", "listed_at", "deleted_at", F.explode(F.array_distinct("doc_row_ids")).alias("doc"))
    assets = R.references(assets, "image_assets", "image_row_id", F.col("doc").cast("string"), "listed_at", until="deleted_at")
    entries = R.references(table(spark, d, "text_entries"), "text_entries", "entry_id", F.col("image_id").cast("string"), "loaded_at", F.col("dataset"))
    return docs.unionByName(assets).unionByName(entries)


def _present(spark: SparkSession, d: str) -> DataFrame:
    a = R.spans(table(spark, d, "image_assets"), "documents", F.col("image_path"), "loaded_at", "deleted_at")
    b = R.spans(table(spark, d, "documents"), "image_assets", F.col("doc_id").cast("string"), "ingested_at")
    c = R.spans(table(spark, d, "image_entries"), "text_entries", F.col("image_id").cast("string"), "loaded_at", "deleted_at", F.col("dataset"))
    return a.unionByName(b).unionByName(c)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(_refs(spark, d), _present(spark, d))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    refs = _refs(spark, d)
    return R.orphan_report(refs, R.orphans(refs, _present(spark, d)))


def _deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The changes of the first and of the second half of the time that they span."""
    every = cut(R.changes(_refs(spark, d), _present(spark, d)), "changes")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(at AS TIMESTAMP_NTZ))")
    low, high = every.agg(F.min(micros), F.max(micros)).first()
    middle = ((low or 0) + (high or 0)) // 2
    return every.where(micros < middle), every.where(micros >= middle)


def p2_delivered(spark: SparkSession, d: str) -> DataFrame:
    """As p2_found, in two deliveries with the state stored between them."""
    first, second = _deliveries(spark, d)
    state = cut(R.summed(first), "state")
    return R.delivered(first).unionByName(R.delivered(second, state))


def p2_current(spark: SparkSession, d: str) -> DataFrame:
    first, second = _deliveries(spark, d)
    state = cut(R.summed(first), "state")
    return R.current_orphans(R.merge_counts(state, R.summed(second))).select("table_name", F.translate("key", "\u0001", ":").alias("ref_key"), "refs")


_REFS = r"""
refs AS (
  SELECT DISTINCT 'documents' AS table_name, doc_id AS row_key, NULL AS within,
         regexp_replace(image_path, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS ref_key, ingested_at AS moment, NULL AS ended
  FROM documents WHERE image_path IS NOT NULL AND ingested_at IS NOT NULL
  UNION SELECT 'image_assets', image_row_id, NULL, CAST(u.doc AS VARCHAR), listed_at, deleted_at
  FROM image_assets, unnest(doc_row_ids) AS u(doc) WHERE u.doc IS NOT NULL AND listed_at IS NOT NULL
  UNION SELECT 'text_entries', entry_id, dataset, CAST(image_id AS VARCHAR), loaded_at, NULL
  FROM text_entries WHERE image_id IS NOT NULL AND loaded_at IS NOT NULL),
asked AS (SELECT * FROM refs WHERE ref_key <> ''),
spans AS (
  SELECT 'documents' AS table_name, NULL AS within, image_path AS ref_key, loaded_at AS since, deleted_at AS until FROM image_assets
  UNION ALL SELECT 'image_assets', NULL, CAST(doc_id AS VARCHAR), ingested_at, NULL FROM documents
  UNION ALL SELECT 'text_entries', dataset, CAST(image_id AS VARCHAR), loaded_at, deleted_at FROM image_entries)"""

_FOUND = f"""{_REFS},
found AS (
  SELECT a.table_name, a.row_key, a.ref_key, strftime(a.moment, '%Y-%m') AS period FROM asked a
  WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.table_name = a.table_name AND s.ref_key = a.ref_key
    AND s.within IS NOT DISTINCT FROM a.within AND s.since <= a.moment AND (s.until IS NULL OR s.until > a.moment)))"""

QUERIES = {
    "p2_found": (p2_found, f"WITH {_FOUND} SELECT table_name, row_key, ref_key, period FROM found"),
    "p2_report": (
        p2_report,
        f"""WITH {_FOUND},
        n AS (SELECT table_name, strftime(moment, '%Y-%m') AS period, count(*) AS n_references FROM asked GROUP BY 1, 2),
        o AS (SELECT table_name, period, count(*) AS n_orphans, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY 1, 2)
        SELECT n.table_name, n.period, n_references, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_keys, 0) AS n_keys
        FROM n LEFT JOIN o ON n.table_name = o.table_name AND n.period = o.period""",
    ),
    "p2_delivered": (p2_delivered, f"WITH {_FOUND} SELECT table_name, row_key, ref_key, period FROM found"),
    "p2_current": (
        p2_current,
        f"""WITH {_REFS},
        r AS (SELECT table_name, within, ref_key, count(*) AS refs FROM asked WHERE ended IS NULL GROUP BY ALL),
        live AS (SELECT DISTINCT table_name, within, ref_key FROM spans WHERE since IS NOT NULL AND until IS NULL)
        SELECT r.table_name, CASE WHEN r.within IS NULL THEN r.ref_key ELSE r.within || ':' || r.ref_key END AS ref_key, refs FROM r
        WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.table_name = r.table_name AND l.ref_key = r.ref_key AND l.within IS NOT DISTINCT FROM r.within)""",
    ),
}
