import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.functions import hashes as H
from mediasift.operators import groups as G
from mediasift.operators import pairs as P
from mediasift.operators.components import components

SIG = "id long, phash array<long>, dhash array<long>, audio array<long>, duration double"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return F.array(*[F.lit(x).cast("long") for x in xs])


def test_hex_round_trip(spark):
    rows = spark.createDataFrame([("ffffffffffffffff",), ("0000000000000001",), ("8000000000000000",)], "h string")
    got = rows.select(H.from_hex("h").alias("v"), H.to_hex(H.from_hex("h")).alias("b"), "h").collect()
    assert [r["v"] for r in got] == [-1, 1, -(1 << 63)] and all(r["b"] == r["h"] for r in got)


def test_one_bit(spark):
    assert one(spark, H.list_similarity(lit(0), lit(1))) == 0.984375
    assert one(spark, H.list_similarity(lit(0, 1), lit(0))) == 1 - 0.5 / 64
    assert one(spark, H.list_similarity(F.array().cast("array<long>"), lit(0))) == 0.0


def test_audio_lowers(spark):
    a = lit(0)
    near = H.fused_similarity(a, a, lit(0), a, a, lit(-1))
    assert one(spark, near) == pytest.approx(0.8)
    none = F.lit(None).cast("array<long>")
    assert one(spark, H.fused_similarity(a, none, none, lit(1), a, none)) == 0.984375


def test_foreground_counts_half(spark):
    none = F.lit(None).cast("array<long>")
    assert one(spark, H.symmetric_with_foreground(lit(0), lit(0), lit(0), lit(-1))) == 0.5
    assert one(spark, H.symmetric_with_foreground(lit(0), lit(1), lit(0), none)) == 0.984375


def test_duration(spark):
    assert not one(spark, H.duration_too_different(F.lit(0.0), F.lit(9.0)))
    assert not one(spark, H.duration_too_different(F.lit(8.0), F.lit(10.0)))
    assert one(spark, H.duration_too_different(F.lit(7.9), F.lit(10.0)))


@pytest.mark.parametrize(("buckets", "bits", "rate"), [(32, 8, 96.1), (32, 16, 67.1), (128, 8, 89.1), (128, 16, 41.3)])
def test_band_recall(spark, buckets, bits, rate):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(4000):
        h = int(rng.integers(0, 1 << 63)) | int(rng.integers(0, 2)) << 63
        g = h
        for b in rng.choice(64, bits, replace=False):
            g ^= 1 << int(b)
        rows.append([x - (1 << 64) if x >> 63 else x for x in (h, g)])
    df = spark.createDataFrame(rows, "a long, b long")
    hit = F.exists(F.zip_with(H.band_keys("a", buckets), H.band_keys("b", buckets), lambda x, y: x == y), lambda t: t)
    assert df.agg((F.avg(hit.cast("double")) * 100).alias("r")).first()["r"] == pytest.approx(rate, abs=2.5)


def test_identical_pair_survives(spark):
    rows = [(i, [(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63)], [i], None, 10.0) for i in range(59)] + [(59, [(7 * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63)], [8], None, 10.0)]
    items = spark.createDataFrame(rows, SIG)
    assert (7, 59) in {(r["a"], r["b"]) for r in P.lsh_candidates(items, 32).collect()}
    once = P.lsh_candidates(items, 32).groupBy("a", "b").count().where("count > 1").count()
    assert once == 0


def test_statistics_count_pairs(spark):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, [int(x)], [0], None, 1.0) for i, x in enumerate(rng.integers(-(1 << 62), 1 << 62, 300))], SIG)
    s = P.candidate_statistics(items, 32).first()
    assert s["all_pairs"] == 300 * 299 // 2 and s["candidate_pairs"] == P.lsh_candidates(items, 32).count()


def test_copies_are_a_star(spark):
    items = spark.createDataFrame([(i, [5], [6], None, 3.0) for i in range(50)] + [(50, [5], [6], [1], 3.0)], SIG)
    assert P.copy_links(items).count() == 49
    assert P.similar_pairs(items).count() == 1


def test_empty_tables(spark):
    items = spark.createDataFrame([], SIG)
    assert P.similar_pairs(items).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_random(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([*edges, (None, 4)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for e in edges for x in e}


def test_retention_ties(spark):
    rows = [(1, 7, 10, 1.0, 4, 4, 2.0), (1, 3, 10, 2.0, 2, 2, 1.0), (1, 9, 5, 3.0, 8, 8, 0.0)]
    m = spark.createDataFrame(rows, "group_id long, id long, size long, mtime double, width int, height int, duration double")
    kept = {s: G.retention(m, s).where("retained").first()["id"] for s in G.STRATEGIES}
    assert kept == {"max_size": 3, "latest": 9, "max_res": 9, "max_bitrate": 3}
    assert [r["id"] for r in G.retention(m).orderBy("rank").collect()] == [3, 7, 9]


def plain_similarity(x, y):
    """From x to y, by loops."""
    bits = lambda p, q: ((p ^ q) & (1 << 64) - 1).bit_count()
    one = lambda a, b: 1 - sum(min(bits(p, q) for q in b) for p in a) / (len(a) * 64) if a and b else 0.0
    p, d = one(x[1], y[1]), one(x[2], y[2])
    s = p * 0.7 + d * 0.3 if x[1] and x[2] else p if x[1] else d if x[2] else 0.0
    if x[3] and y[3] and one(x[3], y[3]) < 0.3:
        s *= 0.8
    fits = not (x[4] and y[4] and abs(x[4] - y[4]) / max(x[4], y[4]) > 0.2)
    return s if fits else -1.0


@pytest.mark.parametrize("block", [2048, 16])
def test_all_pairs_above_are_found(spark, monkeypatch, block):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 6)]

    def near():
        h = base[int(rng.integers(0, 6))]
        for b in rng.choice(63, int(rng.integers(0, 22)), replace=False):
            h ^= 1 << int(b)
        return h

    lists = lambda: None if rng.random() < 0.08 else [near() for _ in range(int(rng.integers(0, 4)))]
    rows = [(i, lists(), lists(), lists() if i % 2 else None, [None, 0.0, 8.0, 10.0, 12.4, 30.0][int(rng.integers(0, 6))]) for i in range(150)]
    want = {(x[0], y[0]): s for x in rows for y in rows if x[0] < y[0] and (s := plain_similarity(x, y)) >= 0.7}
    monkeypatch.setattr(P.B.in_cells, "__defaults__", (None, None, block))
    monkeypatch.setattr(P.B, "TILE", 1 << 8 if block < 100 else 8 << 20)
    items = spark.createDataFrame(rows, SIG)
    got = {(r["a"], r["b"]): r["similarity"] for r in P.pairs_above(items).collect()}
    assert got == pytest.approx(want) and len(want) > 100
    fresh = P.pairs_above(items, fresh=F.col("id") < 20).collect()
    assert {(r["a"], r["b"]) for r in fresh} == {p for p in want if p[0] < 20}


def test_recall_counts_lost_pairs(spark):
    items = spark.createDataFrame([(0, [0], [0], None, 1.0), (1, [0x0001000100010001], [0], None, 1.0), (2, [1], [0], None, 1.0)], SIG)
    r = P.recall(items).first()
    assert (r["pairs"], r["found"]) == (2, 1)


def test_metadata_star(spark):
    rows = [(i, 5, 100.0 + i % 2 * 0.2) for i in range(6)] + [(6, 5, 200.0), (7, 6, 100.0)]
    got = P.metadata_candidates(spark.createDataFrame(rows, "id long, size long, mtime double")).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(0, i) for i in range(1, 6)]


def test_recall_makes_no_candidates(spark, monkeypatch):
    """Recall by look-up is that by a join with all candidates, items without a hash included."""
    rows = [(k, [k % 5 << 20 | k] if k % 5 or k == 200 else [], [k], None, 10.0) for k in range(1, 201)]
    items = spark.createDataFrame(rows, "id long, phash array<long>, dhash array<long>, audio array<long>, duration double")
    true = P.pairs_above(P.representatives(items).drop("copies")).where("a % 100 = 0 or b % 100 = 0").select("a", "b")
    for buckets in (None, 32):
        met = P.lsh_candidates(P.representatives(items).select("id", "phash"), buckets).select("a", "b")
        want = (true.count(), true.join(met.hint("merge"), ["a", "b"]).count())
        with monkeypatch.context() as m:
            m.setattr(P, "lsh_candidates", None)
            assert tuple(P.recall(items, bucket_count=buckets).first()) == want and 0 < want[1] <= want[0]
