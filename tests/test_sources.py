"""Listing by executors, and stores that are read in splits."""

import gzip
import json
import random

import pytest

from mediasift.sources import media as M
from mediasift.sources.listing import MediaListing


def tree(top, n=150, seed=3):
    rng = random.Random(seed)
    for k in range(n):
        folder = top / "/".join(rng.choice(["a", "b", "Skip", "__pycache__", "ü x"]) for _ in range(rng.randint(0, 4)))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{rng.choice(['', '.', '~$'])}f{k}.{rng.choice(['mp4', 'MOV', 'txt', 'tar.mkv'])}").write_bytes(b"v" * rng.choice([0, 1, 10, 999]))


@pytest.mark.parametrize("prefixes", [1, 4, 1000])
def test_executors_list_what_spark_lists(spark, tmp_path, monkeypatch, prefixes):
    tree(tmp_path)
    monkeypatch.setattr("mediasift.sources.listing.PREFIXES", prefixes)
    roots = [str(tmp_path), str(tmp_path / "a"), str(tmp_path / "a" / "b")]
    for more in ({}, {"exclude": ("sKIP",)}, {"least": 5, "most": 500}, {"extensions": ("MKV",)}, {"recursive": False}):
        here = roots if more.get("recursive", True) else [r for r in roots if r]
        got = M.scan(spark, here, **more).collect()
        monkeypatch.setattr(M, "reachable", lambda r: False)
        want = M.scan(spark, here, **more).collect()
        monkeypatch.undo()
        monkeypatch.setattr("mediasift.sources.listing.PREFIXES", prefixes)
        key = lambda rows: sorted((r["path"], r["name"], r["dir"], r["ext"], r["size"]) for r in rows)
        assert key(got) == key(want) and len(set(key(got))) == len(got)
        times = {r["path"]: r["mtime"] for r in want}
        assert all(abs(times[r["path"]] - r["mtime"]) < 0.01 for r in got)
    assert M.scan(spark, roots).count() > 10


def test_the_driver_holds_directories_only(tmp_path):
    tree(tmp_path)
    reader = MediaListing({"roots": json.dumps([str(tmp_path)]), "exclude": '["skip"]', "prefixes": "5"}).reader(None)
    parts = reader.partitions()
    assert len(parts) >= 5 and all((tmp_path / p.path).is_dir() and "skip" not in p.path.lower() for p in parts)
    deep = {p.path for p in parts if p.deep}
    assert not any(a != b and b.startswith(a + "/") for a in deep for b in {p.path for p in parts})


def test_roots_in_roots_count_for_both(spark, tmp_path):
    for name in ("x.mp4", "in/y.mp4", "in/z.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"v")
    (tmp_path / "dirs.txt").write_text(f"{tmp_path}\n{tmp_path}/in/\n{tmp_path}/in\n")
    files, counts = M.batch_scan(spark, str(tmp_path / "dirs.txt"))
    assert sorted(r["files"] for r in counts.collect()) == [2, 3] and files.select("path").distinct().count() == 3


def entries(n, seed=1):
    rng = random.Random(seed)
    out = {"_version": "2.6", "_note": {"deep": [1, {"a": 2}]}}
    for k in range(n):
        name = rng.choice(['/v/{}.mp4', '/v/"q{}": {{.mp4', "/v/}},{}.mp4", "/ü/{}\n  }},\n.mp4", "/back\\\\{}.mov"]).format(k)
        tags = [{"label": "x", "score": 0.5}] * rng.randint(0, 2)
        out[name] = {"size": k, "mtime": k + 0.5, "md5": None, "phash": [f"{rng.getrandbits(64):016x}" for _ in range(rng.randint(0, 3))], "dhash": [], "audio": None, "scene_tags": tags, "duration": 1.0 * k}
        if k % 17 == 0:
            out[f"/empty/{k}"] = {}
    return out


def rows(df):
    return sorted((r["path"], r["size"], r["mtime"], tuple(r["phash"] or ()), r["duration"]) for r in df.collect())


@pytest.mark.parametrize("split", ["97b", "1k", "64k", "128m"])
def test_any_split_gives_the_same_entries(spark, tmp_path, split):
    made = entries(150)
    (tmp_path / "s.json").write_text(json.dumps(made, ensure_ascii=False, indent=2), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = rows(M.legacy_store(spark, str(tmp_path / "s.json")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    signed = lambda h: int(h, 16) - (1 << 64 if int(h, 16) >> 63 else 0)
    want = sorted((p, e.get("size"), e.get("mtime"), tuple(map(signed, e.get("phash", ()))), e.get("duration")) for p, e in made.items() if p[0] != "_")
    assert got == want


def test_parts_of_all_kinds(spark, tmp_path):
    made = entries(20)
    (tmp_path / "compact.json").write_text(json.dumps(made))
    (tmp_path / "none.json").write_text(json.dumps({"_version": "2.6"}, indent=2))
    with gzip.open(tmp_path / "zipped.json.gz", "wt", encoding="utf-8") as f:
        f.write(json.dumps({"_version": "2.0"} | {f"/z/{k}": {"size": k} for k in range(50)}, indent=2))
    (tmp_path / "old.json").write_text(json.dumps({"_version": "1.0", "/o": {"size": 1}, "/o2": {"size": 1}}, indent=2))
    whole = json.dumps({"_version": "2.6", "/t": {"size": 1}, "/t2": {"size": 2}, "/t3": {"size": 3}}, indent=2)
    for k, at in enumerate((len(whole) - 2, whole.index('"/t2"') + 1, whole.index('"/t3"'), 9)):
        (tmp_path / f"torn{k}.json").write_text(whole[:at])
    got = rows(M.legacy_store(spark, str(tmp_path)))
    assert len(got) == len([p for p in made if p[0] != "_"]) + 50 and not any(r[0].startswith(("/o", "/t")) for r in got)
