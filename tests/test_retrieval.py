"""Scoring rules with small hand-made vectors, and properties that tie the operators together."""

import numpy as np
import pytest

from noteforge.operators import documents, retrieval as R

V = "array<double>"


def unit(*x):
    v = np.array(x, float)
    return (v / np.linalg.norm(v)).tolist()


@pytest.fixture(scope="module")
def notes(spark):
    texts = spark.createDataFrame([(0, unit(1, 0)), (1, unit(0, 1)), (2, unit(1, 1))], f"doc_row bigint, v {V}")
    images = spark.createDataFrame([(0, unit(1, 0.2)), (1, unit(0, 1)), (2, unit(-1, 0))], f"image_row bigint, v {V}")
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2)], "doc_row bigint, image_row bigint")
    return texts, images, edges


def queries(spark, *rows):
    return spark.createDataFrame(list(rows), f"qid bigint, modality string, v {V}")


def test_largest_image_counts_and_first_wins(spark, notes):
    texts, images, edges = notes
    q = queries(spark, (7, "text", unit(0, 1)))
    out = {r["doc_row"]: r for r in R.rescored(texts.select(texts.doc_row).selectExpr("7L AS qid", "doc_row"), q, texts, images, edges, 0.5).collect()}
    assert out[0]["score_ti"] == pytest.approx(1) and out[0]["best_image_row"] == 1
    assert out[0]["score_it"] == 0 and out[0]["score_text_index"] == pytest.approx(0)
    assert out[1]["score_mm"] == pytest.approx(1)


def test_exhaustive_ranks_like_candidates(spark, notes):
    texts, images, edges = notes
    for rows in ([(1, "text", unit(1, 2))], [(1, "image", unit(3, 1))], [(1, "text", unit(1, 2)), (1, "image", unit(3, 1)), (2, "text", unit(1, 0))]):
        q = queries(spark, *rows)
        for alpha in (0.0, 0.3, 1.0):
            a = [(r["qid"], r["rank"], r["doc_row"], round(r["score_mm"], 9)) for r in R.exhaustive(q, texts, images, edges, 3, alpha, chunk=2).orderBy("qid", "rank").collect()]
            ids = q.select("qid").distinct().join(texts.select("doc_row"))
            b = [(r["qid"], r["rank"], r["doc_row"], round(r["score_mm"], 9)) for r in R.ranked(R.rescored(ids, q, texts, images, edges, alpha), 3).orderBy("qid", "rank").collect()]
            assert a == b


def test_document_without_image(spark, notes):
    texts, images, edges = notes
    q = queries(spark, (1, "text", unit(1, 1)))
    few = edges.where("doc_row <> 2")
    last = R.exhaustive(q, texts, images, few, 3).orderBy("rank").collect()[-1]
    assert last["doc_row"] == 2 and last["score_mm"] == float("-inf")
    assert all(np.isfinite(r["score_mm"]) for r in R.exhaustive(q, texts, images, few, 3, 1.0).collect())


def test_joint_with_equal_vectors_is_single_mode(spark, notes):
    texts, images, edges = notes
    one, two = queries(spark, (1, "text", unit(2, 1))), queries(spark, (1, "text", unit(2, 1)), (1, "image", unit(2, 1)))
    f = lambda q: [(r["doc_row"], round(r["score_mm"], 9)) for r in R.search(q, texts, images, edges, 3, 3).orderBy("rank").collect()]
    assert f(one) == f(two)


def test_shared_image_expands(spark, notes):
    _, images, edges = notes
    hits = spark.createDataFrame([(1, 1, 0.9, 1), (1, 0, 0.9, 2), (1, 2, 0.1, 3)], "qid bigint, image_row bigint, score double, rank int")
    got = {r["doc_row"]: r["image_row"] for r in R.expand_to_documents(hits, edges).collect()}
    assert got == {0: 1, 1: 1, 2: 2}


def test_adaptive_depth_doubles(spark):
    n = 64
    rng = np.random.default_rng(0)
    images = spark.createDataFrame([(i, (lambda v: v / np.linalg.norm(v))(rng.normal(size=8)).tolist()) for i in range(n)], f"image_row bigint, v {V}")
    edges = spark.createDataFrame([(i // 8, i) for i in range(n)], "doc_row bigint, image_row bigint")
    q = spark.createDataFrame([(k, unit(*rng.normal(size=8))) for k in range(5)], f"qid bigint, v {V}")
    x = np.array([r["v"] for r in images.orderBy("image_row").collect()])
    for target in (3, 5, 20):
        got = {(r["qid"], r["doc_row"]) for r in R.adaptive_candidates(q, images, edges, target, 1).collect()}
        want = set()
        for r in q.collect():
            order = np.lexsort((np.arange(n), -np.round(x @ np.array(r["v"]), 12)))
            depth = min(n, max(target, target))
            while len({i // 8 for i in order[:depth]}) < target and depth < n:
                depth = min(n, depth * 2)
            want |= {(r["qid"], int(i) // 8) for i in order[:depth]}
        assert got == want


def test_recall_and_batches(spark):
    rows = lambda ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "qid bigint, doc_row bigint, rank int")
    assert R.recall_benchmark(rows([0, 1, 2, 3]), rows([0, 2, 5, 6]), (2, 4)).first()[1:] == (0.5, 0.5)
    assert R.recall_benchmark(rows([0]), rows([0]), (2,)).first()[1] is None
    b = spark.createDataFrame([("text", 2, 1.0, 1.0), ("text", 1, 0.0, 0.5)], "mode string, sample_size int, recall_at_5 double, recall_at_10 double")
    assert R.weighted_batches(b).where("mode = 'text'").first()["recall_at_5"] == pytest.approx(2 / 3)


def test_bad_vectors_and_arguments(spark, notes):
    texts, images, edges = notes
    bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [3.0, 4.0]), (5, [1.0]), (6, [None, 1.0])], f"id bigint, e {V}")
    first = bad.orderBy("id")
    assert {r["row"] for r in R.unit_rows(first.where("id in (1, 2, 3, 4, 6)"), "id", "e", "row").collect()} == {4}
    assert R.unit_rows(bad.limit(0), "id", "e", "row").count() == 0
    q = queries(spark, (1, "text", unit(1, 0)))
    with pytest.raises(ValueError):
        R.rescored(texts, q, texts, images, edges, 1.5)
    with pytest.raises(ValueError):
        R.search(q, texts, images, edges, 0)
    assert R.ranked(R.rescored(texts.selectExpr("1L AS qid", "doc_row"), q, texts, images, edges), 0).count() == 0
    assert R.top_k(q.limit(0), texts, "doc_row", 3).count() == 0


def test_pairs_become_documents(spark):
    cols = "ordinal bigint, doc_key string, text string, source string, split string, item_id string, image_id string, image_path string"
    pairs = spark.createDataFrame([
        (0, "s:train:1", "one", "s", "train", "i0", "a", "p/a.jpg"), (1, "s:train:1", "one", "s", "train", "i1", "b", "p/b.jpg"),
        (2, "s:train:2", "two", "s", "train", None, "b", "p/b.jpg"), (3, "s:train:2", "other", "s", "train", None, None, ""),
        (4, None, "x", None, None, None, None, "p/c.jpg"), (5, "s:train:2", "changed", "s", "train", None, None, "p/b.jpg"),
    ], cols)
    assert [(r["doc_row"], r["doc_key"]) for r in documents.documents_of(pairs).orderBy("doc_row").collect()] == [(0, "s:train:1"), (1, "s:train:2")]
    assert documents.images_of(pairs).count() == 2
    assert {(r["doc_row"], r["image_row"]) for r in documents.relation_of(pairs).collect()} == {(0, 0), (0, 1), (1, 1)}
    assert [r["doc_key"] for r in documents.text_conflicts(pairs).collect()] == ["s:train:2"]
    assert documents.pair_faults(pairs).count() == 2
    assert documents.header(documents.documents_of(pairs), documents.images_of(pairs), documents.relation_of(pairs)).first()[1:] == (2, 2, 3)
    assert documents.documents_of(pairs.limit(0)).count() == 0
