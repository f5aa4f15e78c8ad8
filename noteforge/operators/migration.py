"""Pair vectors become document and image vectors: aligned, renormalised, checked, written with a report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.functions import vectors
from noteforge.operators import documents as D
from noteforge.operators.integrity import assert_valid, metadata_violations, together, violation
from noteforge.session import cut
from noteforge.sinks import files, store


def source_faults(pairs: DataFrame, pair_vectors: DataFrame, dimension: int) -> DataFrame:
    """Violations of the input: pairs that make no document, documents with two texts, pairs and vectors
    that do not belong together, vectors that cannot be normalised or are of another dimension."""
    usable = F.lit(True)
    for v in ("text_vector", "image_vector"):
        usable = usable & F.coalesce(vectors.usable(F.col(v)) & (F.size(v) == dimension), F.lit(False))
    return together([
        violation(D.pair_faults(pairs), "usable pair", F.col("ordinal"), F.col("fault")),
        violation(D.text_conflicts(pairs), "one text", F.col("doc_key")),
        violation(pairs.join(pair_vectors, "ordinal", "left_anti"), "pair with vectors", F.col("ordinal")),
        violation(pair_vectors.join(pairs, "ordinal", "left_anti"), "vectors of a pair", F.col("ordinal")),
        violation(pair_vectors.groupBy("ordinal").agg(F.count("*").alias("n")).where("n > 1"), "vectors once", F.col("ordinal")),
        violation(pair_vectors.where(~usable), "usable vectors", F.col("ordinal")),
    ])


def aligned(rows: DataFrame, row: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """((row, v), (row, n_rows, max_difference)): the unit vector of each row's first pair as floats, and how far the others are.

    rows: (ordinal, row, vec). The first vector is joined back, so no row's pairs meet in one task.
    """
    unit = rows.select(row, "ordinal", F.transform(vectors.unit(F.col(vec)), lambda x: x.cast("float")).alias("v"))
    first = unit.groupBy(row).agg(F.min_by("v", "ordinal").alias("v"), F.count("*").alias("n_rows"))
    apart = F.array_max(F.zip_with(F.col("o.v"), F.col("f.v"), lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    others = unit.alias("o").join(first.where("n_rows > 1").alias("f"), row).groupBy(row).agg(F.max("n_rows").alias("n_rows"), F.max(apart).alias("max_difference"), F.count_if(apart > 0).alias("n_different"))
    return first.select(row, "v"), others


def migrate(pairs: DataFrame, pair_vectors: DataFrame, output: str, contract: dict[str, Any], atol: float = 1e-6) -> dict[str, Any]:
    """Writes documents, images, relation, text and image vectors, state and report under `output`; returns the report.

    pairs as in operators.documents, pair_vectors (ordinal, text_vector, image_vector). Refuses an output
    that exists or a left-over of an earlier run; input faults and repeated vectors that differ by
    more than atol stop it, and nothing of the output is left then.
    """
    spark = pairs.sparkSession
    if atol < 0:
        raise ValueError("atol must not be negative")
    staging = f"{output}.migrating"
    for path in (output, staging):
        if store.exists(spark, path):
            raise FileExistsError(path)
    missing = [f for f in ("model_fingerprint", "data_manifest_hash", "dimension", "normalization") if not contract.get(f)]
    if missing:
        raise ValueError(f"the contract lacks {', '.join(missing)}")
    assert_valid(source_faults(pairs, pair_vectors, int(contract["dimension"])))
    docs, images, relation = cut(D.documents_of(pairs), "docs"), cut(D.images_of(pairs), "images"), cut(D.relation_of(pairs).select("doc_row", "image_row"), "relation")
    owners = relation.groupBy("image_row").agg(F.array_sort(F.collect_list("doc_row")).alias("doc_rows"))
    assert_valid(metadata_violations(docs, images.join(owners, "image_row"), relation))
    rows = cut(D.pair_rows(pairs).join(pair_vectors, "ordinal"), "pairs")
    report: dict[str, Any] = {"schema_version": 2, "source_pair_count": rows.count(), "document_count": docs.count(), "image_count": images.count(), "relation_count": relation.count()}
    try:
        files.write_bundle(spark, staging, docs, images, relation, contract)
        for name, row in (("text", "doc_row"), ("image", "image_row")):
            unit, others = aligned(rows.select("ordinal", row, f"{name}_vector"), row, f"{name}_vector")
            found = others.agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)), F.coalesce(F.sum("n_different"), F.lit(0)), F.coalesce(F.max("max_difference"), F.lit(0.0))).first()
            norms = rows.agg(F.min(vectors.norm(F.col(f"{name}_vector"))), F.max(vectors.norm(F.col(f"{name}_vector")))).first()
            report |= {f"duplicate_{name}_rows": found[0], f"nonidentical_{name}_rows": found[1], f"max_{name}_difference": found[2], f"source_{name}_norms": [norms[0], norms[1]]}
            if found[2] > atol:
                raise ValueError(f"{name} vectors of one row differ by {found[2]}, more than {atol}")
            unit.write.parquet(f"{staging}/{name}_vectors")
            if spark.read.parquet(f"{staging}/{name}_vectors").count() != report["document_count" if name == "text" else "image_count"]:
                raise ValueError(f"{name} vectors are missing")
        report |= {"renormalized": True, "atol": atol}
        if faults := files.verify_bundle(spark, staging):
            raise ValueError("; ".join(faults))
        store.write_text(spark, f"{staging}/state.json", files.json_text({**contract, **report, "complete": True}))
        store.write_text(spark, f"{staging}/report.json", files.json_text(report))
        store.rename(spark, staging, output)
    except BaseException:
        store.delete(spark, staging)
        raise
    return report
