"""Incremental scans and suppression of repeats in streams."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mediasift.operators import pairs as P
from mediasift.operators.components import components
from mediasift.streaming import incremental as I


def row(i, h, mtime=1.0):
    return (i, f"/v/{i}.mp4", 10, mtime, [h], [h], None, 10.0)


class Scan:
    """A stream of files in a folder, run batch by batch."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def arrive(self, rows):
        self.spark.createDataFrame(rows, I.SIGNATURE).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        self.go()

    def go(self):
        stream = I.signature_stream(self.spark, str(self.path / "in"))
        I.incremental_scan(stream, str(self.path / "store"), str(self.path / "pairs"), str(self.path / "ck")).awaitTermination(120)

    def again(self, number):
        """Forget that a batch was done, and start anew."""
        for p in (self.path / "ck" / "commits").glob(f"*{number}*"):
            p.unlink()
        self.go()

    def result(self):
        store = I.current_store(self.spark, str(self.path / "store"), StructType.fromDDL(I.SIGNATURE))
        pairs = I.current_pairs(self.spark, str(self.path / "pairs"), store)
        return sorted((r["id"], r["mtime"]) for r in store.collect()), sorted((r["a"], r["b"]) for r in pairs.collect())


def test_incremental_stream(spark, tmp_path):
    scan = Scan(spark, tmp_path)
    scan.arrive([row(1, 5), row(2, -99)])
    scan.arrive([row(3, 4), row(1, 5)])
    once = scan.result()
    assert once == ([(1, 1.0), (2, 1.0), (3, 1.0)], [(1, 3)])
    scan.again(1)
    assert scan.result() == once
    (tmp_path / "pairs" / "batch=1").rename(tmp_path / "gone")  # as if it had died between both writes
    scan.again(1)
    assert scan.result() == once


def test_changed_file_replaces_its_entry(spark, tmp_path):
    scan = Scan(spark, tmp_path)
    scan.arrive([row(1, 5), row(2, 4), row(3, 6)])
    assert scan.result()[1] == [(1, 2), (1, 3), (2, 3)]
    scan.arrive([row(1, -98, 9.0), row(4, -98)])
    want = ([(1, 9.0), (2, 1.0), (3, 1.0), (4, 1.0)], [(1, 4), (2, 3)])
    assert scan.result() == want
    scan.again(1)
    assert scan.result() == want


def gone(i, mtime):
    return (i, f"/v/{i}.mp4", None, mtime, None, None, None, None)


def test_links_of_a_class_outlive_its_head(spark, tmp_path):
    scan = Scan(spark, tmp_path)
    scan.arrive([row(1, 5), row(2, 5), row(3, 5), row(4, 4)])
    assert scan.result()[1] == [(1, 2), (1, 3), (1, 4)]
    scan.arrive([row(1, -98, 9.0)])
    assert scan.result()[1] == [(2, 3), (2, 4)]
    scan.arrive([gone(2, 10.0)])
    assert scan.result()[1] == [(3, 4)]
    scan.arrive([row(2, 5, 11.0), row(5, -98)])
    assert scan.result()[1] == [(1, 5), (2, 3), (2, 4)]


def full(spark, rows):
    """Links of a full scan, and their components."""
    items = spark.createDataFrame(rows, I.SIGNATURE)
    links = P.similar_pairs(items).select("a", "b", "similarity").unionByName(P.copy_links(items).withColumn("similarity", F.lit(1.0)))
    return sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in links.collect()), sorted(map(tuple, components(links).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_changes_gives_the_links_of_a_full_scan(spark, tmp_path, seed):
    rng = random.Random(seed)
    hashes = [0, 1, 3, 7, 2**40 - 1, 2**40, -1, -2, 2**20, 2**20 + 2**50]

    def made(i, mtime):
        lists = [rng.choice(hashes) for _ in range(rng.choice([0, 1, 1, 2]))]
        return (i, f"/v/{i}.mp4", 10 + rng.randint(0, 3), mtime, lists, rng.choice([lists, lists[:1], None]), rng.choice([None, None, [5], [-6]]), rng.choice([0.0, 10.0, 11.0, 30.0, None]))

    scan, there = Scan(spark, tmp_path), {}
    for batch in range(5):
        arrived = []
        for i in rng.sample(range(24), 9):
            if i in there and rng.random() < 0.4:
                arrived.append(gone(i, 10.0 * batch))
                del there[i]
            else:
                there[i] = made(i, 10.0 * batch)
                arrived.append(there[i])
        scan.arrive(arrived)
        if batch % 2:
            scan.again(batch)
    store = I.current_store(spark, str(tmp_path / "store"), StructType.fromDDL(I.SIGNATURE))
    links = I.current_pairs(spark, str(tmp_path / "pairs"), store)
    assert sorted(r["id"] for r in store.collect()) == sorted(there)
    got = sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in links.collect()), sorted(map(tuple, components(links).collect()))
    assert got == full(spark, list(there.values()))


TIMED = I.SIGNATURE + ", t timestamp"


def at(i, minute, phash, dhash=(1,), audio=None, duration=1.0):
    from datetime import datetime, timedelta

    return (i, f"/v/{i}", 1, 1.0, phash, None if dhash is None else list(dhash), audio, duration, datetime(2026, 1, 1) + timedelta(minutes=minute))


class Suppress:
    def __init__(self, spark, path):
        self.spark, self.path, self.late = spark, path, 0

    def arrive(self, rows):
        self.spark.createDataFrame(rows, TIMED).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        stream = self.spark.readStream.schema(TIMED).parquet(str(self.path / "in"))
        query = I.distinct_signatures(stream, "t").writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        self.late += I.late_rows(query)
        return sorted(r["id"] for r in self.spark.read.parquet(str(self.path / "out")).collect())


def test_repeats_in_a_stream(spark, tmp_path):
    s = Suppress(spark, tmp_path)
    rows = [at(1, 0, [7]), at(2, 1, [7]), at(3, 0, [7], (2,)), at(4, 0, [7], audio=[3]), at(5, 0, [7], duration=2.0), at(6, 5, []), at(7, 5, None, None), at(8, 6, [], ()), at(9, 5, None, None)]
    assert s.arrive(rows) == [1, 3, 4, 5, 6, 7, 8, 9]  # rows 6 to 9: one with a dHash alone, three without any
    assert s.arrive([at(10, 30, [7]), at(11, 31, [8]), at(12, 300, [9])]) == [1, 3, 4, 5, 6, 7, 8, 9, 11, 12]  # a new start remembers
    assert s.arrive([at(13, 301, [7]), at(14, 2, [77])])[-1] == 13 and s.late == 1  # the first is forgotten; the last is late
