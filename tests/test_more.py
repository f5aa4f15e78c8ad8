"""Percentiles over counts, losses with scale and refusal, lookups, resume tables, offsets of sparse ids, sinks of text."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteforge.functions import vectors
from noteforge.operators import cleaning, evaluation, integrity, losses, ordering, sampling, sets
from noteforge.sinks import files as K
from noteforge.sinks import store
from noteforge.sources import rows as S


def test_nearest_rank_against_sorting(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 37, 400):
        values = [float(x) for x in rng.integers(0, 50, n)] + [None]
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
        for ratio in (0.0, 0.5, 0.95, 1.0):
            full = sorted(v for v in values if v is not None)
            want = full[max(1, math.ceil(ratio * n)) - 1] if n else 0.0
            assert evaluation.nearest_rank(df, "x", ratio).first()["value"] == want


def test_losses_refuse_and_scale(spark):
    logits = spark.createDataFrame([(0, "a", "x", 1.0, True), (0, "a", "y", 2.0, False), (0, "b", "x", 0.5, False)], "batch int, text_uid string, image_uid string, logit double, positive boolean")
    with pytest.raises(Exception, match="no positive for anchor"):
        losses.multi_positive_loss(logits, "text_uid", ["batch"]).collect()
    assert losses.multi_positive_loss(logits, "text_uid", ["batch"], strict=False).count() == 1
    rng = np.random.default_rng(2)
    t, i = rng.normal(size=(4, 3)), rng.normal(size=(5, 3))
    edges = [(0, 0), (0, 1), (1, 2), (2, 3), (3, 4)]
    texts = spark.createDataFrame([(0, str(k), v.tolist()) for k, v in enumerate(t)], "batch int, text_uid string, v array<double>")
    images = spark.createDataFrame([(0, str(k), v.tolist()) for k, v in enumerate(i)], "batch int, image_uid string, v array<double>")
    rel = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "text_uid string, image_uid string")
    got = losses.symmetric_loss(losses.scaled_logits(texts, images, rel, 1.5)).first()
    x = (t / np.linalg.norm(t, axis=1, keepdims=True)) @ (i / np.linalg.norm(i, axis=1, keepdims=True)).T * math.exp(1.5)
    mask = np.zeros(x.shape, bool)
    for a, b in edges:
        mask[a, b] = True

    def one(m, p):
        return float(np.mean([np.log(np.exp(r).sum()) - np.log(np.exp(r[q]).sum()) for r, q in zip(m, p)]))

    assert abs(got["text_loss"] - one(x, mask)) < 1e-9 and abs(got["image_loss"] - one(x.T, mask.T)) < 1e-9


def test_lookup_by_number_and_slice(spark):
    edges = spark.createDataFrame([(r, 10 * r + k) for r in range(6) for k in range(2)], "row bigint, doc bigint")

    def rows(*wanted):
        return sorted({r["row"] for r in S.lookup(edges, "row", list(wanted)).collect()})

    assert rows(0, -1) == [0, 5] and rows(slice(1, 3)) == [1, 2] and rows(slice(-2, None), 0) == [0, 4, 5] and rows(slice(4, 99)) == [4, 5]
    for wrong in ((6,), (-7,)):
        with pytest.raises(IndexError):
            rows(*wrong)
    with pytest.raises(ValueError):
        rows(slice(0, 5, 2))
    assert S.lookup(edges.limit(0), "row", [slice(0, 3)]).count() == 0
    assert sets.truncated(edges, "row", -1).count() == 0 and sets.truncated(edges, "row", 2).count() == 4
    lists = {r["row"]: r["l"] for r in S.grouped_rows(edges.unionByName(edges), "row", "doc", "l").collect()}
    assert lists[3] == [30, 31]


def test_resume_differences(spark):
    a = spark.createDataFrame([("seed", "1"), ("epoch", "2"), ("gone", "x"), ("none", None)], "field string, value string")
    b = spark.createDataFrame([("seed", "1"), ("epoch", "3"), ("new", "y"), ("none", None)], "field string, value string")
    assert {tuple(r) for r in sampling.resume_differences(a, b).collect()} == {("epoch", "2", "3"), ("gone", "x", None), ("new", None, "y")}


def test_running_sums_over_sparse_ids(spark):
    ids = sorted(np.random.default_rng(3).integers(0, 1 << 62, 300).tolist())
    df = spark.createDataFrame([(i, k % 2, k) for k, i in enumerate(ids)], "id bigint, key int, v bigint")
    for width in (2, 1000, 1 << 18):
        got = {r["id"]: r["s"] for r in ordering.running(df, "id", F.col("v"), "s", ["key"], width).collect()}
        want, sums = {}, {0: 0, 1: 0}
        for k, i in enumerate(ids):
            want[i] = sums[k % 2]
            sums[k % 2] += k
        assert got == want


def test_unit_takes_the_norm_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    assert [r["u"] for r in df.select(vectors.unit(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    plan = df.select(vectors.unit(F.col("v")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("aggregate(") <= 1


def test_content_files(spark):
    names = ["config.json", "a/model.safetensors", "model-00001.json", "pytorch_model.bin.index.json", "model_fingerprint.json", "index_meta.json", "README.md", "log.txt", "weights.pt"]
    kept = {r["path"] for r in integrity.content_files(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert kept == {"config.json", "a/model.safetensors", "model-00001.json", "pytorch_model.bin.index.json", "weights.pt"}


def test_first_wins_with_null_keys(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "x") for k in range(50)], "o bigint, k string")
    got = cleaning._first_wins(df, ["k"], "o", "one").collect()
    assert len(got) == 50 and [r["o"] for r in got if r["one"]] == [0] and all(r["one"] is None for r in got if r["k"] is None)


def test_header_violations(spark):
    docs = spark.createDataFrame([(0, "a")], "doc_row bigint, doc_key string")
    images = spark.createDataFrame([(0, "p", [0])], "image_row bigint, image_path string, doc_rows array<bigint>")
    rel = spark.createDataFrame([(0, 0)], "doc_row bigint, image_row bigint")
    h = "schema_version int, document_count bigint, image_count bigint, relation_count bigint, manifest_hash string"
    good, bad, old = (spark.createDataFrame([r], h) for r in ((2, 1, 1, 1, "x"), (2, 2, 1, 3, "y"), (None, 1, 1, 1, "x")))
    manifest = spark.createDataFrame([("x",)], "manifest_hash string")
    assert integrity.metadata_violations(docs, images, rel, good, manifest).count() == 0
    assert {r["rule"] for r in integrity.metadata_violations(docs, images, rel, bad, manifest).collect()} == {"document count", "relation count", "manifest hash"}
    assert {r["rule"] for r in integrity.metadata_violations(docs, images, rel, old, manifest).collect()} == {"schema version"}
    assert "one header" in {r["rule"] for r in integrity.metadata_violations(docs, images, rel, good.limit(0), manifest).collect()}


def test_texts_on_any_file_system(spark, tmp_path):
    path = f"file://{tmp_path}/d/x.json"
    store.write_text(spark, path, "ä")
    store.write_text(spark, path, "字")
    assert store.read_text(spark, path) == "字" and store.exists(spark, path)
    store.rename(spark, path, f"file://{tmp_path}/e/y.json")
    with pytest.raises(FileExistsError):
        store.rename(spark, f"file://{tmp_path}/e/y.json", f"file://{tmp_path}/e/y.json")
    store.delete(spark, f"file://{tmp_path}/e")
    assert not store.exists(spark, f"file://{tmp_path}/e/y.json")
    issues = spark.createDataFrame([("b",), ("a",), ("b",)], "reason string")
    assert "| b | 2 |" in K.summary({"kept": 3}, issues) and K.summary({}, issues.limit(0)).strip().endswith("none")
    t = K.evaluation_template(spark.createDataFrame([("q", 2), ("q", 1)], "query_id string, rank int")).collect()
    assert [(r["rank"], r["label"], r["label_reason"]) for r in t] == [(1, "", ""), (2, "", "")]
