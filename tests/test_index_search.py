"""The written index, search through it, requests, batch collect."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteforge.operators import encoding, retrieval
from noteforge.plans.corpus import bundle
from noteforge.plans.retrieval_queries import query_vectors

CONTRACT = {"model_fingerprint": "m", "data_manifest_hash": "h", "dimension": 64, "normalization": "L2"}


def test_written_index(spark, sf, tmp_path):
    texts, images, edges = bundle(spark, sf)
    index = encoding.write_index(images, "image_row", f"{tmp_path}/i", CONTRACT, cells=16)
    assert index.frame.count() == images.count()
    q = images.where("image_row % 10 = 0").withColumnRenamed("image_row", "qid")
    exact = {tuple(r) for r in retrieval.top_k(q, images, "image_row", 10).select("qid", "image_row", "rank").collect()}
    assert {tuple(r) for r in index.find(16)(q, 10).select("qid", "image_row", "rank").collect()} == exact  # all cells, ties too
    some = {tuple(r)[:2] for r in index.find(8)(q, 10).select("qid", "image_row").collect()}
    assert len(some & {e[:2] for e in exact}) >= 0.9 * len(exact)
    plan = encoding.probe(q.limit(1), index.frame, "image_row", index.centres, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "[cell#") or "PartitionFilters: [" in plan and "cell" in plan
    assert encoding.open_index(spark, f"{tmp_path}/i", CONTRACT).row == "image_row"
    for field in CONTRACT:
        with pytest.raises(ValueError):
            encoding.open_index(spark, f"{tmp_path}/i", {**CONTRACT, field: "other"})


def test_index_build_refuses(spark, tmp_path):
    def frame(rows):
        return spark.createDataFrame(rows, "r bigint, v array<double>")

    good = frame([(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    contract = {**CONTRACT, "dimension": 2}
    encoding.write_index(good, "r", f"{tmp_path}/x", contract)
    for bad in (frame([(0, [2.0, 0.0])]), frame([(0, [1.0])]), frame([(0, [1.0, 0.0]), (0, [0.0, 1.0])]), frame([(0, None)]), frame([(0, [float("nan"), 0.0])])):
        with pytest.raises(ValueError):
            encoding.write_index(bad, "r", f"{tmp_path}/x", contract)
        assert encoding.open_index(spark, f"{tmp_path}/x").frame.count() == 2  # the old one stays
    with pytest.raises(ValueError):
        encoding.write_index(good, "r", f"{tmp_path}/y", {**contract, "model_fingerprint": ""})
    assert encoding.write_index(good.limit(0), "r", f"{tmp_path}/z", contract).frame.count() == 0


def test_search_through_indexes(spark, sf, tmp_path):
    texts, images, edges = bundle(spark, sf)
    by_text = encoding.write_index(texts, "doc_row", f"{tmp_path}/t", CONTRACT, cells=8)
    by_image = encoding.write_index(images, "image_row", f"{tmp_path}/i", CONTRACT, cells=8)
    q = query_vectors(texts, images, edges)
    exact = sorted(tuple(r) for r in retrieval.search(q, texts, images, edges, 10, 5).select("qid", "rank", "doc_row").collect())
    assert sorted(tuple(r) for r in retrieval.search(q, texts, images, edges, 10, 5, find_text=by_text.find(8), find_image=by_image.find(8)).select("qid", "rank", "doc_row").collect()) == exact
    near = {(r["qid"], r["doc_row"]) for r in retrieval.search(q, texts, images, edges, 10, 5, find_text=by_text.find(5), find_image=by_image.find(5)).collect()}
    assert len(near & {(a, c) for a, _, c in exact}) >= 0.9 * len(exact)
    for wrong in ({"recall": 0}, {"final": 0}):
        with pytest.raises(ValueError):
            retrieval.search(q, texts, images, edges, **wrong)


def test_requests(spark):
    enc = encoding.HashEncoder(8)
    asked = spark.createDataFrame([(1, "  lamp ", None), (2, " ", "a.jpg"), (3, "lamp", "a.jpg")], "qid bigint, text string, image string")
    got = {(r["qid"], r["modality"]): r["v"] for r in retrieval.query_vectors(asked, enc, enc).collect()}
    assert set(got) == {(1, "text"), (2, "image"), (3, "text"), (3, "image")} and got[1, "text"] == got[3, "text"]
    assert abs(np.linalg.norm(got[2, "image"]) - 1) < 1e-9
    with pytest.raises(ValueError, match="4"):
        retrieval.query_vectors(asked.unionByName(spark.createDataFrame([(4, " ", None)], asked.schema)), enc, enc)
    timed = retrieval.collected(asked, lambda q: q.select("qid"))
    assert timed.count() == 3 and timed.where("latency_ms > 0").count() == 3


def test_more_queries_than_a_block(spark, sf):
    texts, images, edges = bundle(spark, sf)
    q = query_vectors(texts, images, edges)
    whole = sorted(tuple(r) for r in retrieval.exhaustive(q, texts, images, edges, 5).collect())
    assert sorted(tuple(r) for r in retrieval.exhaustive(q, texts, images, edges, 5, block=2, chunk=7).collect()) == whole


def test_documents_without_image_come_last(spark):
    texts = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "doc_row bigint, v array<double>")
    images = spark.createDataFrame([(0, [1.0, 0.0])], "image_row bigint, v array<double>")
    edges = spark.createDataFrame([(2, 0)], "doc_row bigint, image_row bigint")
    q = spark.createDataFrame([(0, "text", [1.0, 0.0])], "qid bigint, modality string, v array<double>")
    got = {r["doc_row"]: r["score_mm"] for r in retrieval.exhaustive(q, texts, images, edges, 3).collect()}
    assert got[2] == 0.5 and got[0] == got[1] == float("-inf")
    assert [r["doc_row"] for r in retrieval.exhaustive(q, texts, images, edges, 1, alpha=1.0).collect()] == [0]


def test_hot_keys_and_null_keys_in_joins(spark):
    from noteforge.session import salted_join

    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    groups = spark.createDataFrame([("hot", 1), ("5", 2), ("none", 3)], "k string, g int")
    for hot in (100_000, 20):
        assert salted_join(rows, groups, ["k"], "id", hot).count() == 334
        left = salted_join(rows, groups, ["k"], "id", hot, how="left")
        assert left.count() == 1000 and left.where("g IS NOT NULL").count() == 334
