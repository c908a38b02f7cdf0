import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidrill.functions import predicates as P
from evidrill.operators import annotation, audit, contracts, linking, retrieval
from evidrill.plans import publish
from evidrill.sources import readers


def test_pair_json(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"annotations": [{"id": 1, "image_id": 2, "similarity_score": 0.5, "source_dataset": 0, "falsified": True}, {"id": 3}], "source_datasets": {"0": "a"}}))
    rows = readers.pair_json(spark, str(tmp_path / "p.json"), "train").orderBy("row").collect()
    assert [(r["id"], r["image_id"], r["falsified"]) for r in rows] == [(1, 2, True), (3, None, None)]
    raw = readers.pair_json_raw(spark, str(tmp_path / "p.json"), "train")
    prof = {r["field"]: r for r in audit.field_profile(raw, "json").collect()}
    assert prof["image_id"]["n_missing"] == 1 and prof["id"]["types_seen"] == "BIGINT"
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="no annotations"):
        readers.pair_json(spark, str(tmp_path / "bad.json"), "train").collect()


def test_strict_types(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": true}',), ('{"a": 1.0}',), ('{"a": -1}',), ("{}",), ('{"a": null}',)], "j string")
    v = F.try_variant_get(F.parse_json("j"), "$.a", "variant")
    assert [r[0] for r in rows.select(P.strict_id(v)).collect()] == [True, False, False, False, False, False]
    assert [r[0] for r in rows.select(P.strict_class(v)).collect()] == ["INVALID_OR_MISSING", "falsified"] + ["INVALID_OR_MISSING"] * 4


def test_predicates(spark):
    rows = spark.createDataFrame([("a/b.jpg",), ("/a/b.jpg",), ("../b.jpg",), ("a\\b.jpg",), ("a/b",), ("",), ("c:/x.jpg",), (None,), ("\u00a0",)], "p string")
    got = rows.select(P.malformed_path(F.col("p")), P.unsafe_path_reason(F.col("p")), P.has_text(F.col("p"))).collect()
    assert [r[0] for r in got] == [False, True, True, True, True, False, False, False, False]
    assert [r[1] for r in got] == [None, "absolute", "empty or dotted part", "backslash", None, "empty", "drive or scheme", "empty", None]
    assert [r[2] for r in got] == [True] * 5 + [False, True, False, False]
    scores = spark.createDataFrame([("0",), ("07",), ("100",), ("101",), ("x",)], "s string")
    assert [r[0] for r in scores.select(P.whole_score(F.col("s"))).collect()] == [0, None, 100, None, None]


def test_keyed_json_and_train_table(spark, tmp_path):
    ok = {"0": {"id": 0, "image_path": "a/b/0.jpg", "caption": "x", "source": "s"}, "1": {"id": 1, "image_path": "a/b/1.jpg", "caption": "y", "source": "s", "title": None}}
    (tmp_path / "m.json").write_text(json.dumps(ok))
    rows = readers.train_table(spark, str(tmp_path / "m.json"), ["title"]).collect()
    assert [(r["id"], r["caption"], r["split"]) for r in rows] == [(0, "x", "train"), (1, "y", "train")]
    ok["0"]["id"] = 999
    (tmp_path / "bad.json").write_text(json.dumps(ok))
    with pytest.raises(Exception, match="bad record at key 0"):
        readers.train_table(spark, str(tmp_path / "bad.json"), []).collect()


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", "True", ""), ("2", "", "a,b")], "k string, f string, t string")
    publish.write_csv(df, str(tmp_path / "c"), ["k"])
    back = readers.csv_strings(spark, str(tmp_path / "c")).orderBy("k").collect()
    assert [tuple(r) for r in back] == [("1", "True", ""), ("2", "", "a,b")]
    typed = readers.csv_typed(spark, str(tmp_path / "c"), "k int,t string", ["t"]).orderBy("k").collect()
    assert [tuple(r) for r in typed] == [(1, None), (2, "a,b")]


def test_npy_and_probe(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.eye(3, dtype=np.float32))
    rows = readers.npy(spark, str(tmp_path / "v.npy")).orderBy("row").collect()
    assert [list(r["vec"]) for r in rows] == np.eye(3).tolist()
    probe = {r["name"]: r["exists"] for r in readers.file_probe(spark, str(tmp_path), ["v.npy", "w.npy"]).collect()}
    assert probe == {"v.npy": True, "w.npy": False}


def test_tar_and_assets(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for name, data in (("../escape.jpg", b"x"), ("./a/1.jpg", b"\xff\xd8\xff1"), ("a/2.jpg", b""), ("a/3.jpg", b"broken")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    members = readers.tar_members(spark, str(tmp_path / "a.tar.gz"))
    assert {r["name"]: r["safe"] for r in members.collect()} == {"../escape.jpg": False, "a/1.jpg": True, "a/2.jpg": True, "a/3.jpg": True}
    wanted = spark.createDataFrame([("root/a/1.jpg",), ("root/a/9.jpg",)], "image_path string")
    assert {r["image_path"]: r["status"] for r in readers.requested(members, wanted, "root/").collect()} == {"root/a/1.jpg": "found", "root/a/9.jpg": "missing"}
    checked = readers.image_check(members.where("safe").select(F.col("name").alias("image_path"), "content"))
    assert {r["image_path"]: r["status"] for r in checked.collect()}["a/2.jpg"] == "zero_byte"
    assert publish.asset_summary(checked).first()["n_assets"] == 3
    out = publish.extract_members(members, str(tmp_path / "out"))
    assert {r["result"] for r in out.collect()} == {"extracted"} and (tmp_path / "out/a/1.jpg").read_bytes() == b"\xff\xd8\xff1"
    assert {r["result"] for r in out.collect()} == {"kept"}


def test_freeze_publish_merge(spark, tmp_path):
    t = spark.range(5).withColumn("x", F.col("id") * 2)
    publish.freeze_or_verify({"a": t}, str(tmp_path))
    publish.freeze_or_verify({"a": t}, str(tmp_path))
    with pytest.raises(contracts.ContractError):
        publish.freeze_or_verify({"a": t.withColumn("x", F.lit(0).cast("long"))}, str(tmp_path))
    with pytest.raises(contracts.ContractError, match="only"):
        publish.freeze_or_verify({"a": t, "b": t}, str(tmp_path))
    with pytest.raises(contracts.ContractError):
        publish.publish(t, str(tmp_path / "c"), {"positive": F.col("id") < 1})
    assert not publish.exists(spark, str(tmp_path / "c"))
    publish.write_json(spark, {"a": float("nan"), "b": [1]}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": [1]}
    chunks = spark.createDataFrame([(i,) for i in (7, 3, 9, 1)], "metadata_id long")
    rows = publish.merge_chunks(chunks, chunks).collect()
    assert sorted((r["embedding_row"], r["metadata_id"]) for r in rows) == [(0, 1), (1, 3), (2, 7), (3, 9)]
    with pytest.raises(contracts.ContractError, match="not_contained"):
        publish.merge_chunks(chunks, chunks.union(spark.createDataFrame([(2,)], "metadata_id long")))


def test_link_null_captions_are_equal_and_missing_records_unknown(spark):
    pairs = spark.createDataFrame([(1, 2, True), (1, 9, True), (2, 2, False)], "id long, image_id long, falsified boolean")
    records = spark.createDataFrame([(1, None, "s"), (2, None, "t")], "id long, caption string, source string")
    rows = linking.link(pairs, records, ["caption", "source"]).orderBy("id", "image_id").collect()
    assert [r["captions_equal"] for r in rows] == [True, None, True]
    with pytest.raises(Exception, match="no row"):
        linking.require(pairs.select(F.col("image_id").alias("id")), records, "id").collect()


def test_annotation_rules(spark):
    rows = spark.createDataFrame(
        [("SAME", "LABELED", "90", "HIGH", "False", "False", ""), ("SAME", "LABELED", "60", "LOW", "False", "True", "\u00a0"), ("", "UNLABELED", "", "", "", "", ""), ("X", "REVIEW", "101", "HIGH", "True", "", "")],
        "event_label string, status string, confidence_score string, confidence string, needs_review string, web_checked string, web_evidence_note string",
    )
    found = {r["check"]: r["n"] for r in contracts.annotation(rows).collect()}
    assert found == {"label": 1, "status": 0, "score": 1, "band": 1, "low_unflagged": 1, "flag_status": 0, "web_note": 1}
    with pytest.raises(contracts.ContractError):
        contracts.enforce(contracts.annotation(rows))
    two = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="two proposals"):
        annotation.apply_updates(spark.createDataFrame([(1, "x")], "k long, v string"), two, "k", ["v"], F.lit(True)).collect()


def test_empty_denominators_are_null(spark):
    none = spark.createDataFrame([], "channel string, event_label string")
    assert annotation.event_rates(none, []).first()["same_rate"] is None
    hashes = spark.createDataFrame([("q", "h"), ("c", "h"), ("d", "z")], "image_path string, sha256 string")
    pairs = spark.createDataFrame([("q", "c", False), ("q", "d", True)], "query_path string, candidate_path string, is_exact boolean")
    assert {r["check"]: r["n"] for r in contracts.byte_identity(pairs, hashes).collect()} == {"unflagged": 1, "not_identical": 1}


def test_encoder_rejects_zero_vectors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, caption string")
    got = retrieval.encode(rows, lambda xs: [[float(len(x)), 0.0] for x in xs], "caption", "id").collect()
    assert {r["id"]: list(r["vec"]) for r in got} == {1: [1.0, 0.0], 2: [1.0, 0.0]}
    with pytest.raises(Exception, match="zero or infinite"):
        retrieval.encode(rows, lambda xs: [[0.0]] * len(xs), "caption", "id").collect()


def test_depth_coverage_of_known_ranks(spark):
    first = spark.createDataFrame([("1", "a", 3), ("1", "b", None), ("2", "a", None), ("2", "b", 12), ("3", "a", 18), ("3", "b", 30)], "qid string, channel string, first_rank int")
    got = {(r["scope"], r["depth"]): r["n_covered"] for r in annotation.coverage_by_depth(first, [5, 20, 50]).collect()}
    assert got == {("a", 5): 1, ("a", 20): 2, ("a", 50): 2, ("b", 5): 0, ("b", 20): 1, ("b", 50): 2, ("union", 5): 1, ("union", 20): 3, ("union", 50): 3}
