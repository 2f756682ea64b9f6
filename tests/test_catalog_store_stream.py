import json

import pytest
from pyspark.sql import functions as F

from mediasift.functions import scalars as S
from mediasift.operators import catalog as C
from mediasift.operators import cleanup as K
from mediasift.operators import store as T
from mediasift.sources import media as M


def test_scan(spark, tmp_path):
    for name, size in (("a/x.mp4", 10), ("a/.h.mp4", 10), ("b/y.MOV", 5), ("b/empty.mp4", 0), ("skip/z.mp4", 9), ("a/n.txt", 4)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"v" * size)
    got = M.scan(spark, [str(tmp_path)], exclude=("SKIP",)).collect()
    assert sorted((r["name"], r["size"]) for r in got) == [("x.mp4", 10), ("y.MOV", 5)]
    listing = tmp_path / "dirs.txt"
    listing.write_text(f"# roots\n{tmp_path}/a\n{tmp_path}/b\n")
    _, counts = M.batch_scan(spark, str(listing))
    assert {(r["root"][-1], r["files"]) for r in counts.collect()} == {("a", 1), ("b", 1)}


def test_batch_goes_on_past_a_missing_root(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("z.mp4", "b.mov"):
        (tmp_path / "a" / name).write_bytes(b"v")
    listing = tmp_path / "dirs.txt"
    listing.write_text(f"{tmp_path}/nowhere\n{tmp_path}/a\n")
    files, counts = M.batch_scan(spark, str(listing))
    assert files.count() == 2
    assert {(r["root"].rsplit("/", 1)[1], r["status"], r["files"]) for r in counts.collect()} == {("nowhere", "missing", 0), ("a", "ok", 2)}
    assert [r["name"] for r in M.simple_scan(spark, str(tmp_path)).collect()] == ["b.mov", "z.mp4"]


def test_suspects_come_back(spark, tmp_path):
    rows = [("2", "dog", 0.3, "low;closer", "cat"), ("1", "cat", 0.25, "outlier", None)]
    M.write_suspects(spark.createDataFrame(rows, "id string, label string, score double, reasons string, suggested string"), str(tmp_path / "s"))
    assert [tuple(r) for r in M.read_suspects(spark, str(tmp_path / "s")).collect()] == [rows[1], rows[0]]


def test_sets_in_ignore_rules(spark):
    files = spark.createDataFrame([(n, f"/v/{n}") for n in ("a1.mp4", "b1.mp4", "c1.mp4", "^1.mp4", "a2.mp4")], "name string, path string")
    left = lambda rule: sorted(r["name"] for r in C.without_ignored(files, spark.createDataFrame([(rule,)], "rule string")).collect())
    assert left("[!ab]1.mp4") == ["a1.mp4", "a2.mp4", "b1.mp4"]
    assert left("[ab]?.mp4") == ["^1.mp4", "c1.mp4"] and left("[^a]1.mp4") == ["a2.mp4", "b1.mp4", "c1.mp4"]


def test_save_drops_pixels(spark, tmp_path):
    T.save(spark.createDataFrame([("p", 1, b"x")], "path string, size long, pixels binary"), str(tmp_path / "s"))
    assert T.load(spark, str(tmp_path / "s")).columns == ["path", "size"]


def test_legacy_store(spark, tmp_path):
    p = tmp_path / "cache.json"
    p.write_text(json.dumps({"_version": "2.0", "/v/a.mp4": {"size": 3, "mtime": 1.5, "phash": ["ffffffffffffffff"], "dhash": ["1"], "duration": 2.0}}))
    r = M.legacy_store(spark, str(p)).collect()
    assert len(r) == 1 and r[0]["phash"] == [-1] and r[0]["dhash"] == [1] and r[0]["audio"] is None
    p.write_text("not json")
    assert M.legacy_store(spark, str(p)).count() == 0


def test_groups_json(spark, tmp_path):
    p = tmp_path / "g.json"
    for text in ('{"groups": [["a", "b"], ["c"]]}', '[["a", "b"], ["c"]]'):
        p.write_text(text)
        assert sorted((r["group_no"], r["path"]) for r in M.groups_from_json(spark, str(p)).collect()) == [(0, "a"), (0, "b"), (1, "c")]


def test_labels_csv(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("﻿FileName,标签\nd/a.mp4,dog\na.mp4,cat\nb.mp4,\n", encoding="utf-8")
    assert [(r["name"], r["label"]) for r in C.labels_from_csv(spark, str(p)).collect()] == [("a.mp4", "cat")]
    p.write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        C.labels_from_csv(spark, str(p))


def test_sizes(spark):
    rows = spark.createDataFrame([("100MB", 100 << 20), ("1.5 KB", 1536), ("7", 7), ("x", None)], "s string, n long")
    assert all(r["n"] == r["m"] for r in rows.select("n", S.parse_size(F.col("s")).alias("m")).collect())


def test_regex_labels(spark):
    rows = spark.createDataFrame([("/m/7-gate2_horse_run-pos-night-31.mp4", "7-gate2_horse_run-pos-night-31.mp4")], "path string, name string")
    r = rows.select(C.label_of("regex", "gate2_(.+?)-(?:pos|neg)").alias("x"), C.label_of("prefix").alias("p")).first()
    assert r["x"] == "horse_run" and r["p"] is None


def test_protected_is_no_prefix(spark):
    rows = spark.createDataFrame([(1, "/src3/a"), (2, "/src31/a"), (3, "/SRC3")], "id long, path string")
    left = C.without_protected(rows, spark.createDataFrame([("/src3/",)], "folder string"))
    assert [r["id"] for r in left.collect()] == [2]


def test_validity_boundaries(spark):
    catalog = spark.createDataFrame([("a", 1, 1.0, "m"), ("b", 1, 1.0, "m"), ("c", 1, 2.0, None), ("d", 1, 1.0, "m")], "path string, size long, mtime double, md5 string")
    store = spark.createDataFrame([("a", 1, 1.9, "m"), ("b", 2, 1.0, "m"), ("c", 1, 1.0, "m")], "path string, size long, mtime double, md5 string")
    assert {r["path"]: r["valid"] for r in T.validity(catalog, store).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert {r["path"] for r in T.validity(catalog, store, use_md5=True).where("valid").collect()} == {"a"}


def test_tampered_file_conflicts(spark):
    ledger = spark.createDataFrame([("s1", "t1", 5, "x"), ("s2", "t2", 5, "x"), ("s3", "t3", 5, "x")], "source string, target string, size long, sha256 string")
    now = spark.createDataFrame([("t1", 5, "x"), ("t2", 5, "y"), ("t3", 5, "x"), ("s3", 5, "x")], "path string, size long, sha256 string")
    assert {r["source"]: r["restore"] for r in K.restorable(ledger, now).collect()} == {"s1": "ready", "s2": "conflict", "s3": "conflict"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
