"""Matches between long items, and between an item and very many."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediasift.operators import joins
from mediasift.operators import pairs as P
from mediasift.operators import segments as S
from mediasift.plans import fixtures as X


def plain(pairs, seconds):
    out = []
    for a, b in pairs:
        for t1, h1 in seconds.get(a, ()):
            gaps = [((h1 ^ h2).bit_count(), t2) for t2, h2 in seconds.get(b, ())]
            if gaps:
                out.append((a, b, t1, min(gaps)[1], 1 - min(gaps)[0] / 64))
    return sorted(out)


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_blocks_of_seconds_give_the_same_matches(spark, block):
    rng = np.random.default_rng(7)
    seconds = {i: [(float(t), int(rng.integers(0, 16))) for t in range(int(rng.integers(0, 14)))] for i in range(8)}
    pairs = [(i, j) for i in range(8) for j in range(i + 1, 8)]
    samples = spark.createDataFrame([(i, t, h) for i, v in seconds.items() for t, h in v], "id long, t double, h long")
    got = S.best_matches(spark.createDataFrame(pairs, "a long, b long"), samples, block).collect()
    assert sorted(tuple(r) for r in got) == plain(pairs, seconds)


def test_a_day_and_an_item_in_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    day = spark.range(20_000).select(F.lit(0).cast("long").alias("id"), F.col("id").cast("double").alias("t"), F.xxhash64("id").alias("h"))
    short = spark.range(1, 1001).select("id", F.lit(5.0).alias("t"), F.xxhash64(F.col("id") * 7).alias("h"))
    got = S.best_matches(spark.range(1, 1001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).where("b % 300 = 0"), day.unionByName(short))
    assert got.count() == 3 * 20_000
    many = S.best_matches(spark.range(1, 1001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")), day.unionByName(short))
    exact = many.where("sim = 1.0 and t2 = a * 7").count()
    assert many.count() == 1000 and exact == 1000


def test_items_without_a_hash_are_a_star(spark):
    items = spark.createDataFrame([(k, [] if k < 300 else [k]) for k in range(302)], "id long, phash array<long>")
    got = {(r["a"], r["b"]) for r in P.lsh_candidates(items).collect()}
    assert {p for p in got if p[0] < 300} == {(0, k) for k in range(1, 300)} and (300, 301) in got


@pytest.mark.parametrize("block", [3, 4096])
def test_intervals_are_those_of_the_matches(spark, block):
    """F3"""
    rng = np.random.default_rng(11)
    samples = spark.createDataFrame([(i, float(t), int(rng.integers(0, 8))) for i in range(9) for t in range(int(rng.integers(1, 12)))] + [(0, 1.0, 255), (7, 0.0, 3)], "id long, t double, h long")
    pairs = spark.createDataFrame([(i, j) for i in range(10) for j in range(i + 1, 10)] + [(0, 1), (None, 2)], "a long, b long")
    got = S.intervals(pairs, samples, 0.985, block)
    whole = S.similar_intervals(S.best_matches(pairs, samples), 0.985).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() > 40


def test_very_many_short_pairs_are_matched_together(monkeypatch):
    """F1"""
    n, calls, least = 3000, [], S._least
    monkeypatch.setattr(S, "_least", lambda *x: calls.append(1) or least(*x))
    items = {"block_a": [0] * n, "block_b": [0] * n, "t": [[0, 1]] * n, "h": [[k, k + 1] for k in range(n)]}
    side = lambda k, **more: items | {"side": [k] * n, "a": list(range(n)), "b": list(range(n))} | more
    tables = [pa.table(side(0)), pa.table(side(1)), pa.table(side(2, b=list(range(1, n)) + [n + 5], t=[None] * n, h=[None] * n))]
    rows = pa.concat_tables([t.cast(pa.schema([("block_a", pa.int32()), ("block_b", pa.int32()), ("t", pa.list_(pa.int64())), ("h", pa.list_(pa.int64())), ("side", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])) for t in tables])
    a, b, t1, gap, t2, _ = (np.concatenate(c) for c in zip(*S._matched(rows), strict=True))
    assert len(a) == 2 * (n - 1) and (b == a + 1).all() and (gap[t1 == 1] == 0).all() and (t2[t1 == 1] == 0).all() and len(calls) < 10


def test_seconds_of_a_text_are_its_frames(spark):
    texts = ["", "a", "é" * 63 + "b", "x" * 64, "ab😀" * 60, "".join(map(chr, range(33, 300))) * 9, "z" * 127, "y" * 128]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    plain = d.select("id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.length("text") / 64)).cast("int") - 1)).alias("t"))
    plain = plain.select("id", "t", X.hash_of(X.frame_at(F.col("text"), F.col("t") * 64), "phash").alias("h"))
    got = d.select("id", F.posexplode(X.second_hashes(F.col("text"), "phash")).alias("t", "h"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
