"""Sources, sinks, streaming, extraction, text functions at their edges."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteforge.functions import text as T
from noteforge.operators import cleaning, encoding, evaluation, integrity, ordering, sampling
from noteforge.sinks import files as K
from noteforge.sources import files as S
from noteforge.sources import rows
from noteforge.streaming import progress


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä中", None), (2, "x", [1])], "id bigint, t string, l array<int>")
    K.write_jsonl(df, f"{tmp_path}/j")
    assert sorted(map(tuple, S.read_jsonl(spark, f"{tmp_path}/j", df.schema).collect())) == sorted(map(tuple, df.collect()))
    raw = "".join(open(f"{tmp_path}/j/{f}", encoding="utf-8").read() for f in os.listdir(f"{tmp_path}/j") if f.endswith(".json"))
    assert "ä中" in raw and '"l":null' in raw
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n\n[1]\nno\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "id bigint").collect()
    assert S.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "id bigint", strict=False).where("id = 1").count() == 1
    assert S.read_jsonl(spark, f"{tmp_path}/j", df.schema, limit=1).count() == 1


def test_jsonl_names_file_and_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n[3]\n')
    with pytest.raises(ValueError, match=r"x\.jsonl:4 "):
        S.read_jsonl(spark, f"{tmp_path}/x.jsonl", "id bigint")
    (tmp_path / "y.jsonl").write_text("".join(f'{{"id": {i}}}\n' for i in range(50)))
    assert [r["id"] for r in S.read_jsonl(spark, f"{tmp_path}/y.jsonl", "id bigint", limit=5).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    assert S.read_jsonl(spark, f"{tmp_path}/x.jsonl", "id bigint", strict=False, limit=2).count() == 2


def test_pair_store(spark, tmp_path):
    rows = [("0", "i0", "t0", "a", "aGk"), ("1", "i1", "t1", "b", "_-8="), ("num_samples", None, None, "2", None)]
    spark.createDataFrame(rows, "key string, image_id string, text_id string, text string, image string").write.parquet(f"{tmp_path}/p")
    pairs = S.pair_store(spark, f"{tmp_path}/p")
    assert {tuple(r) for r in S.scan_pairs(pairs, "image_id", "text_id", "text", "s").collect()} == {("s:i0", "s:t0", "a"), ("s:i1", "s:t1", "b")}
    assert [tuple(r) for r in S.decoded_pair(S.pair_at(pairs, "ordinal", -2, 2), "s").collect()] == [("s:i0", "s:t0", "a", b"hi")]
    assert bytes(S.decoded_pair(S.pair_at(pairs, "ordinal", 1, 2), "s").first()["payload"]) == b"\xff\xef"
    with pytest.raises(IndexError):
        S.pair_at(pairs, "ordinal", 2, 2)
    spark.createDataFrame(rows[1:], "key string, image_id string, text_id string, text string, image string").write.parquet(f"{tmp_path}/q")
    with pytest.raises(ValueError):
        S.pair_store(spark, f"{tmp_path}/q")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.jpg").write_bytes(b"x")
    (tmp_path / "img" / "num_images").write_bytes(b"1")
    assert [r["name"] for r in S.image_files(spark, f"{tmp_path}/img").collect()] == ["a.jpg"]


def test_strict_lines_and_annotations(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes("gut\n".encode() + b"\xff\xfe\n")
    lines, faults = S.strict_lines(spark, f"{tmp_path}/l.txt")
    assert [r["line"] for r in lines.collect()] == ["gut"] and faults.count() == 1
    (tmp_path / "a.jsonl").write_text('{"text_id":"1","text":"a","image_ids":["x","x"]}\n{"text_id":"1","text":"b","image_ids":[]}\n{"text_id":"2"}\n')
    good, bad = S.annotations(spark, f"{tmp_path}/a.jsonl")
    assert good.where("text = 'a'").first()["image_ids"] == ["x"]
    assert {(r["text_id"], r["fault"]) for r in bad.collect()} == {("1", "repeated text id"), ("2", "missing field")}


def test_atomic_csv_config(tmp_path):
    K.write_atomic(f"{tmp_path}/d/x.json", {"a": float("nan"), "b": {1, 2}, "c": np.float32(2)})
    assert S.load_json(f"{tmp_path}/d/x.json") == {"a": None, "b": [1, 2], "c": 2.0} and S.load_json(f"{tmp_path}/none", 5) == 5
    assert os.listdir(f"{tmp_path}/d") == ["x.json"]
    K.write_csv([{"a": 1, "z": 2}], f"{tmp_path}/x.csv", ["a", "b"])
    assert open(f"{tmp_path}/x.csv", "rb").read().startswith(b"\xef\xbb\xbfa,b")
    (tmp_path / "c.json").write_text('{"s": {"k": 1}, "t": 3}')
    c = S.load_config(f"{tmp_path}/c.json")
    assert S.section(c, "s") == {"k": 1} and S.section(c, "u") == {}
    with pytest.raises(ValueError):
        S.section(c, "t")
    assert S.resolve("/a", "/r") == "/a" and S.resolve("a", "/r") == "/r/a"
    with pytest.raises(ValueError):
        K.reset_dir("/")


def test_bundle_and_build(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, None)], "i bigint, s string")
    K.write_bundle(spark, f"{tmp_path}/b", t, t, t)
    assert K.verify_bundle(spark, f"{tmp_path}/b") == [] and K.verify_bundle(spark, f"{tmp_path}/none") == ["no manifest"]
    t.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/b/images")
    assert K.verify_bundle(spark, f"{tmp_path}/b") == ["images"]
    assert S.load_bundle(spark, f"{tmp_path}/b")["documents"].count() == 2
    K.build_dataset(spark, f"{tmp_path}/ds", {"t": t})
    with pytest.raises(ValueError):
        K.build_dataset(spark, f"{tmp_path}/ds", {"t": t.limit(1)}, lambda x: ["refused"])
    assert spark.read.parquet(f"{tmp_path}/ds/t").count() == 2


def test_commit_rolls_back(spark, tmp_path):
    for n in ("a", "b", "a.new"):
        (tmp_path / n).write_text(n)
    with pytest.raises(Exception):
        K.commit_files(spark, [(f"{tmp_path}/a.new", f"{tmp_path}/a"), (f"{tmp_path}/missing", f"{tmp_path}/b")])
    assert (tmp_path / "a").read_text() == "a" and (tmp_path / "b").read_text() == "b" and (tmp_path / "a.new").exists()


def test_report():
    text = K.metric_report({"n": 1, "p": 0.5}, [{"q": "a|b", "p": 0.5}], [{"q": i} for i in range(12)])
    assert "a\\|b" in text and "| 9 |" in text and "| 10 |" not in text


def test_stream_log_and_snapshot(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def deliver(name, events):
        (src / name).write_text("".join(json.dumps(e) + "\n" for e in events))

    def run():
        progress.append_log(spark, str(src), f"{tmp_path}/log", f"{tmp_path}/c1").awaitTermination()
        progress.keep_snapshot(spark, str(src), f"{tmp_path}/snap", f"{tmp_path}/c2").awaitTermination()
        return {r["key"]: r["value"] for r in progress.newest(spark, f"{tmp_path}/snap").collect()}

    deliver("1.json", [{"seq": 1, "event": "start", "values": {"a": "1", "b": "2"}}, {"seq": 2, "event": "step", "values": {"a": None}}])
    assert run() == {"a": None, "b": "2", "last_event": "step"}
    deliver("2.json", [{"seq": 3, "event": "end", "values": {"b": "3"}}])
    assert run() == {"a": None, "b": "3", "last_event": "end"}
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3
    assert run() == {"a": None, "b": "3", "last_event": "end"}


def test_extraction_resumes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id bigint, t string")
    enc = encoding.HashEncoder(16)
    assert encoding.extract_into(df.where("id < 3"), "id", "t", enc, f"{tmp_path}/e") == 2
    assert encoding.extract_into(df, "id", "t", enc, f"{tmp_path}/e") == 1
    got = {r["id"]: r["embedding"] for r in spark.read.parquet(f"{tmp_path}/e").collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[3] and abs(np.linalg.norm(got[1]) - 1) < 1e-6


def test_a_store_that_cannot_be_read_is_no_empty_store(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        encoding.extract_into(spark.createDataFrame([(1, "a")], "id bigint, t string"), "id", "t", encoding.HashEncoder(4), f"{tmp_path}/e")


def test_clustered_index_recall(spark, sf):
    from noteforge.operators.retrieval import top_k
    from noteforge.plans.retrieval_queries import corpus

    texts, images, _ = corpus(spark, sf)
    q = images.where("image_row % 10 = 0").withColumnRenamed("image_row", "qid")
    centres = encoding.fit_cells(images, 16)
    index = encoding.indexed(images, "image_row", centres)
    assert index.count() == images.count()
    a = {(r["qid"], r["image_row"]) for r in encoding.probe(q, index, "image_row", centres, 10, 12).collect()}
    b = {(r["qid"], r["image_row"]) for r in top_k(q, images, "image_row", 10).collect()}
    assert len(a & b) >= 0.9 * len(b)


def test_image_faults(spark):
    df = spark.createDataFrame([("a", bytearray(b"\xff\xd8\xff123")), ("b", bytearray(b"")), ("c", bytearray(b"text")), ("d", None)], "path string, content binary")
    got = {r["path"]: r["fault"] for r in encoding.image_faults(df).collect()}
    assert got["b"] == "empty" and got["d"] == "empty" and got["c"] == "not decodable"


def test_text_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("。",), ("a",), ("abc…",)], "t string")
    assert [r[0] for r in df.select(T.terminated(F.col("t"))).collect()] == [None, "", "。", "a。", "abc…"]
    df = spark.createDataFrame([("两个  人 走\tＡ",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(T.restored_segments(F.col("t"))).collect()] == ["两个，人走A。", "", None]
    assert spark.createDataFrame([("人:n 走:v 3:00",)], "t string").select(T.without_tags(F.col("t"))).first()[0] == "人走3:00。"
    df = spark.createDataFrame([("COCO_train2014_000000000001",), ("COCO_val2014_000000000002",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(T.scene_id(F.col("t"))).collect()] == [1000000000001, 2000000000002, None, None]
    key = T.document_key(F.col("s"), F.col("p"), F.col("t"), F.col("i"), F.col("n"), F.lit(7))
    df = spark.createDataFrame([("a", "b", "1", "2", "3"), (None, "", "", "2", None), ("a", "b", None, "", ""), ("a", "b", None, None, None)], "s string, p string, t string, i string, n string")
    assert [r[0] for r in df.select(key).collect()] == ["a:b:1", "unknown:unknown:2", "a:b:", "a:b:7"]
    df = spark.createDataFrame([(3661.9,), (-5.0,), (360000.0,)], "s double")
    assert [r[0] for r in df.select(T.clock(F.col("s"))).collect()] == ["01:01:01", "00:00:00", "100:00:00"]


def test_order_helpers(spark):
    df = spark.createDataFrame([(i * 3, i % 2) for i in range(50)], "o bigint, v int")
    got = [r["s"] for r in ordering.running(df, "o", F.col("v"), "s", width=7).orderBy("o").collect()]
    assert got == [sum(j % 2 for j in range(i)) for i in range(50)]
    assert [r["b"] for r in ordering.batched(df, "o", 8, "b").orderBy("o").collect()] == [i // 8 for i in range(50)]
    assert {r["o"] for r in rows.rows_at(df, "o", [0, -1, 999]).collect()} == {0, 147}
    assert ordering.dense_ids(df.limit(0), "o", "i").count() == 0


def test_keep_first_and_percentiles(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, "x", "a"), (4, "x", "b")], "o bigint, k string, e string")
    assert {r["o"] for r in cleaning.keep_first(df, ["k", "e"], "o").collect()} == {1, 3, 4}
    for n in range(1, 40):
        d = spark.createDataFrame([(i * i % 17,) for i in range(n)], "v int")
        s = sorted(i * i % 17 for i in range(n))
        if n in (1, 2, 7, 20, 39):
            r = cleaning.floor_index_percentiles(d.withColumn("k", F.lit(1)), ["k"], "v", {"p95": 0.95}).first()
            assert (r["min"], r["p95"], r["max"]) == (s[0], s[int((n - 1) * 0.95)], s[-1])


def test_metrics(spark):
    rows_ = spark.createDataFrame([(1, i, x, 1.0) for i, x in enumerate([2, 0, 1])] + [(2, 0, 0, None)], "query_id int, position int, label int, latency_ms double")
    m = {r["query_id"]: r for r in evaluation.query_metrics(rows_).collect()}
    assert m[1]["precision_at_5"] == pytest.approx(0.4) and m[2]["ndcg_at_5"] == 0
    dcg = 3 + 1 / 2
    assert m[1]["ndcg_at_5"] == pytest.approx(dcg / (3 + 1 / np.log2(3)))
    empty = evaluation.macro_metrics(evaluation.query_metrics(rows_.limit(0))).first()
    assert empty["num_queries"] == 0 and empty["p95_latency_ms"] == 0


def test_recall_rules(spark):
    r = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "qid int, cand int, rank int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    pool = spark.createDataFrame([(10,), (11,), (12,)], "cand int")
    a = spark.createDataFrame([(1, 11), (2, 99), (3, 12)], "qid int, cand int")
    got = evaluation.recall_at_k(r, a, q, pool, (5, 1, 1, -2)).first()
    assert (got["num_queries"], got["num_queries_without_answers"], got["recall_at_1"], got["recall_at_5"]) == (2, 1, 0.0, 0.5)
    assert evaluation.recall_at_k(r, a.limit(0), q, pool, (1,)).first()["recall_at_1"] is None


def test_sampler_counts(spark):
    df = spark.createDataFrame([("a" if i < 90 else "b", i) for i in range(100)], "s string, k bigint")
    e = sampling.balanced_epoch(df, "s", "k", 60, 1).collect()
    assert len(e) == 60
    b = [r for r in e if r["s"] == "b"]
    assert len({(r["k"], r["pass"]) for r in b}) == len(b)
    per = {}
    for r in b:
        per[r["k"]] = per.get(r["k"], 0) + 1
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 10
    x = sampling.seeded_sample(df, "k", 10, 5).collect() + sampling.seeded_sample(df, "k", 10, 5, 10).collect()
    assert len({r["k"] for r in x}) == 20
    assert sampling.resume_mismatches({"a": 1}, {"a": 1, "b": 2}, ("a", "b")) == ["b"]


def test_validators(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "a"), (5, "c")], "doc_row bigint, doc_key string")
    images = spark.createDataFrame([(0, "p", [0, 0]), (1, "p", []), (2, "q", None), (3, "r", [9])], "image_row bigint, image_path string, doc_rows array<bigint>")
    rel = spark.createDataFrame([(0, 0)], "doc_row bigint, image_row bigint")
    rules = {r["rule"] for r in integrity.metadata_violations(docs, images, rel).collect()}
    assert rules == {"dense document ids", "unique document key", "unique image path", "image with owner", "distinct owners", "known owner", "owners as related", "document with image"}
    with pytest.raises(ValueError):
        integrity.assert_valid(integrity.metadata_violations(docs, images, rel))
    integrity.assert_valid(integrity.metadata_violations(docs.limit(0), images.limit(0), rel.limit(0)))
    files = spark.createDataFrame([("b", 1, "y"), ("a", 2, "x")], "path string, size bigint, digest string")
    import hashlib

    assert integrity.directory_fingerprint(files).first()["fingerprint"] == hashlib.sha256(b"a\x002\x00x\nb\x001\x00y\n").hexdigest()


def test_cut_tables_can_be_dropped(spark, tmp_path):
    from noteforge.session import cut, drop_cuts, shared_dir

    t = cut(spark.range(5), "x")
    assert t.count() == 5
    root = f"{shared_dir(spark)}/noteforge".removeprefix("file://").removeprefix("file:")
    own = f"{root}/{spark.sparkContext.applicationId}"
    other = f"{root}/another-application"
    os.makedirs(other, exist_ok=True)
    assert os.path.isdir(own)
    drop_cuts(spark)
    assert not os.path.exists(own) and os.path.isdir(other)  # what others wrote stays
