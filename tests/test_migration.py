"""Pairs with vectors become a bundle of documents and images with aligned, renormalised vectors."""

import json

import pytest

from noteforge.operators import migration

CONTRACT = {"model_fingerprint": "m", "data_manifest_hash": "h", "dimension": 2, "normalization": "L2"}
PAIRS = [(0, "s:train:0", "lamp", "s", "train", "x0", "i0", "a.jpg"), (1, "s:train:0", "lamp", "s", "train", "x1", "i1", "b.jpg"), (2, "s:train:1", "tent", "s", "train", "x2", "i1", "b.jpg")]
VECTORS = [(0, [2.0, 0.0], [0.0, 3.0]), (1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 5.0], [1.0, 1.0001])]


def frames(spark, pairs=PAIRS, rows=VECTORS):
    return (
        spark.createDataFrame(pairs, "ordinal bigint, doc_key string, text string, source string, split string, item_id string, image_id string, image_path string"),
        spark.createDataFrame(rows, "ordinal bigint, text_vector array<double>, image_vector array<double>"),
    )


def test_migration_writes_and_reports(spark, tmp_path):
    out = f"{tmp_path}/out"
    report = migration.migrate(*frames(spark), out, CONTRACT, atol=5e-4)
    assert (report["source_pair_count"], report["document_count"], report["image_count"], report["relation_count"]) == (3, 2, 2, 3)
    assert report["duplicate_text_rows"] == 1 and report["nonidentical_text_rows"] == 0 and report["duplicate_image_rows"] == 1 and report["nonidentical_image_rows"] == 1
    assert 0 < report["max_image_difference"] < 5e-4 and report["source_text_norms"] == [1.0, 5.0]
    text = {r["doc_row"]: r["v"] for r in spark.read.parquet(f"{out}/text_vectors").collect()}
    assert text == {0: [1.0, 0.0], 1: [0.0, 1.0]}
    image = {r["image_row"]: r["v"] for r in spark.read.parquet(f"{out}/image_vectors").collect()}
    assert image[0] == [0.0, 1.0] and abs(image[1][0] - 0.5**0.5) < 1e-6
    state = json.load(open(f"{out}/state.json", encoding="utf-8"))
    assert state["complete"] and state["model_fingerprint"] == "m"
    with pytest.raises(FileExistsError):
        migration.migrate(*frames(spark), out, CONTRACT)


@pytest.mark.parametrize("change", ["apart", "missing", "zero", "two texts", "contract", "dimension"])
def test_migration_refuses_and_leaves_nothing(spark, tmp_path, change):
    pairs, rows, contract = [list(p) for p in PAIRS], list(VECTORS), dict(CONTRACT)
    if change == "apart":
        rows[1] = (1, [0.9, 0.1], [1.0, 1.0])
    if change == "missing":
        rows = rows[:2]
    if change == "zero":
        rows[2] = (2, [0.0, 0.0], [1.0, 1.0])
    if change == "two texts":
        pairs[1][2] = "other"
    if change == "contract":
        contract["data_manifest_hash"] = ""
    if change == "dimension":
        contract["dimension"] = 3
    with pytest.raises(ValueError):
        migration.migrate(*frames(spark, [tuple(p) for p in pairs], rows), f"{tmp_path}/out", contract, 5e-4)
    assert not list(tmp_path.iterdir())
