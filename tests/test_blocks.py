"""All pairs in blocks of any size."""

import tracemalloc
from time import perf_counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediasift.operators import blocks as B
from mediasift.operators import groups as G
from mediasift.operators import labels as L
from mediasift.operators import pairs as P


def items(spark, n=90):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 12)
    rows = [(k, "abc"[k % 3] if k % 7 else None, [int(base[k % 12]) ^ (1 << int(b)) for b in rng.integers(0, 62, rng.integers(0, 4))], [int(base[k % 12])], float(k % 5), rng.normal(size=8).tolist(), None, float(k % 4) * 10) for k in range(n)]
    return spark.createDataFrame(rows, "id long, label string, phash array<long>, dhash array<long>, motion_mean double, emb array<double>, audio array<long>, duration double")


@pytest.mark.parametrize("tile", [300, 1 << 23])
@pytest.mark.parametrize("least,most,few", [(1000, 1000, 8), (7, 20, 3), (1, 1 << 16, 8)])
def test_blocks_and_tiles_change_nothing(spark, monkeypatch, least, most, few, tile):
    df = items(spark)
    rounded = lambda rows: sorted(map(str, rows))
    want = P.pairs_above(df, 0.7).collect(), L.label_sums(df.where("label is not null")).collect(), L.label_pairs(df.where("label is not null"), least=0.4).collect()
    monkeypatch.setattr(B, "TILE", tile)
    monkeypatch.setattr(B, "FEW_BLOCKS", few)
    monkeypatch.setattr(B.in_cells, "__defaults__", (None, None, least, most))
    monkeypatch.setattr(L, "LEAST_ITEMS", least)
    monkeypatch.setattr(L, "MOST_ITEMS", most)
    got = P.pairs_above(df, 0.7).collect(), L.label_sums(df.where("label is not null")).collect(), L.label_pairs(df.where("label is not null"), least=0.4).collect()
    keep = lambda r: [round(v, 9) if isinstance(v, float) else v for v in r]
    assert [rounded(map(keep, x)) for x in got] == [rounded(map(keep, x)) for x in want] and all(len(x) > 20 for x in got)


def test_an_item_meets_few_cells(spark):
    df = spark.range(40_000).select("id")
    cells = B.in_cells(df)
    copies = cells.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert copies == B.FEW_BLOCKS and cells.select("cell").distinct().count() == B.FEW_BLOCKS * (B.FEW_BLOCKS + 1) // 2


def lists(rng, n, most, base):
    return [[int(base[rng.integers(len(base))]) ^ (1 << int(q)) for q in rng.integers(0, 63, rng.integers(1, most + 1))] for _ in range(n)]


@pytest.mark.parametrize("most", [1, 4, 7])
def test_least_sums_are_lower_bounds_and_hardly_less(most):
    rng = np.random.default_rng(most)
    base = rng.integers(-(2**62), 2**62, 9)
    base[1] = ~base[0]  # a distance of 64
    a, b = (B.padded(pd.Series(lists(rng, n, most, base))) for n in (41, 52))
    there, back = B.nearest_sums(a, b)
    low = B.least_sums(*a, [B.packed(h) for h in b[0].T], b[1])
    place, real = B.unpacked(np.arange(low[0].shape[1]))
    real &= place < 52
    for exact, bound, n in ((there, low[0], a[1][:, None]), (back, low[1], b[1][None])):
        assert (bound[:, real] <= exact).all() and (exact - bound[:, real] <= n).all()


def test_comparing_costs_a_fraction_of_all_distances():
    """Two blocks, and a third of the pairs too far apart in duration to be looked at."""
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"id": np.arange(3000), "phash": list(rng.integers(-(2**62), 2**62, (3000, 4))), "dhash": list(rng.integers(-(2**62), 2**62, (3000, 4))), "audio": None, "duration": np.linspace(100, 200, 3000), "side": np.arange(3000) % 2})
    took = []
    for run in (lambda: P._compare(0.7, (0.7, 0.3), 0.8, 0.2)(rows), lambda: [B.nearest_sums(B.padded(rows[c][::2]), B.padded(rows[c][1::2])) for c in ("phash", "dhash")]):
        start = perf_counter()
        run()
        took.append(perf_counter() - start)
    assert took[0] < took[1] / 2


def test_label_pairs_come_a_tile_at_a_time(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", lambda self, run, schema: taken.update(run=run))
    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"id": np.arange(2000), "label": "a", "phash": list(rng.integers(-(2**62), 2**62, (2000, 1))), "dhash": list(rng.integers(-(2**62), 2**62, (2000, 1))), "motion_mean": 1.0, "emb": list(rng.normal(size=(2000, 8))), "side": 2})
    L.label_pairs(items(spark, 10))
    sizes = [len(part) for part in taken["run"](iter([rows[:1500], rows[1500:]]))]
    assert sum(sizes) == 2000 * 1999 // 2 and max(sizes) < 200_000


def test_cells_are_dealt_by_their_pairs_not_their_bytes(spark):
    cells = B.in_cells(spark.range(40_000).select("id"))
    run = lambda rows: pd.DataFrame({"task": [__import__("pyspark").TaskContext.get().partitionId()]})
    tasks = {r["task"] for r in cells.groupBy("cell").applyInPandas(run, "task int").collect()}
    assert len(tasks) > 12  # of 36 cells; at most 8 before, and one of small tables


def test_padded_takes_null_empty_and_short_lists():
    column = pd.Series([None, [], [5], [1, 2, 3]])
    hashes, size = B.padded(column)
    assert hashes.tolist() == [[0, 0, 0], [0, 0, 0], [5, 5, 5], [1, 2, 3]] and size.tolist() == [0, 0, 1, 3]
    again = B.padded(pa.chunked_array([pa.array(column.to_list()[:2], pa.list_(pa.int64())), pa.array(column.to_list()[2:], pa.list_(pa.int64()))]))
    assert (again[0] == hashes).all() and (again[1] == size).all()
    assert B.padded(pd.Series([], dtype=object))[0].shape == (0, 1)


def test_asked_pairs_are_those_of_all_rows_worked_out_in_blocks(spark, monkeypatch):
    """As row by row, with lists that are null, empty or short, and durations that are null, 0, NaN or infinite (F27)."""
    rng = np.random.default_rng(9)
    base = rng.integers(-(2**62), 2**62, 5)
    hashes = lambda k: None if k % 11 == 0 else lists(rng, 1, 4, base)[0][: k % 9]
    seconds = lambda k: {0: None, 1: 0.0, 2: float("nan"), 3: float("inf"), 4: -1.0}.get(k % 17, 80.0 + k % 41)
    rows = [(None if k == 3 else k // 2 * 2 if k > 290 else k, hashes(k), hashes(k + 5), hashes(k + 3), seconds(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, phash array<long>, dhash array<long>, audio array<long>, duration double")
    want = P.scored(P.duration_compatible(P.all_pairs(df.where("id % 10 = 0"), df))).select("a", "b", "similarity").collect()
    monkeypatch.setattr(B, "ROWS", 16)
    monkeypatch.setattr(B, "COLUMNS", 48)
    got = P.asked_pairs(df, F.col("id") % 10 == 0)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and len(want) > 1000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_d1_all_pairs_scores_no_row_by_itself(spark):
    from mediasift.plans import catalogue

    plan = catalogue.queries()["d1_all_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "bit_count" not in plan


def one_hash_each(n, seed):
    rng = np.random.default_rng(seed)
    emb = rng.normal(size=(n, 64))
    emb[: n // 50] *= 0
    emb[1] = np.nan
    hashes = lambda: (rng.integers(-(2**62), 2**62, (n, 1)).view(np.uint64), np.ones(n, np.int64))
    return {"id": np.arange(n), "motion": rng.exponential(size=n), "phash": hashes(), "dhash": hashes(), "emb": emb, "size": np.sqrt((emb * emb).sum(axis=1))}


@pytest.mark.parametrize("clip", [True, False])
def test_one_product_gives_the_similarities_at_a_fraction(clip):
    """F32"""
    x, y = one_hash_each(400, 1), one_hash_each(4000, 2)
    if not clip:
        x, y = ({c: v for c, v in z.items() if c not in ("emb", "size")} for z in (x, y))
    cuts, took, got = [slice(k, k + 16) for k in range(0, 400, 16)], [], []
    for run in (L._likeness(x, y, 0.9), lambda cut: L._alike(L._some(x, cut), y, 0.9)):
        run(cuts[0])
        start = perf_counter()
        got.append([run(cut) for cut in cuts])
        took.append(perf_counter() - start)
    assert np.allclose(*map(np.vstack, got), rtol=0, atol=1e-14, equal_nan=True)
    assert took[0] < took[1] * 0.7


def test_cells_of_labelled_items_stay_bounded(spark):
    """However many items there are, two blocks have 2^26 pairs at most, give or take what hashing leaves uneven (F32)."""
    df = spark.range(140_000).select("id", F.lit("a").alias("label"), F.array(F.lit(1)).alias("phash"), F.array(F.lit(1)).alias("dhash"), F.rand(1).alias("motion_mean"), F.array(F.lit(1.0)).alias("emb"))
    sizes = L._cells(df)[0].groupBy("cell", "side").count().agg(F.max("count")).first()[0]
    assert sizes <= 1.1 * 2**13


@pytest.mark.parametrize("key_items,chunk", [(2048, 1 << 18), (9, 50)])
def test_candidates_are_scored_where_they_meet(spark, monkeypatch, key_items, chunk):
    """As row by row over joined pairs, with hot keys in blocks, and lists that are null, empty or short (F37)."""
    from mediasift.functions import hashes as H

    rng = np.random.default_rng(10)
    base = rng.integers(-(2**62), 2**62, 6)
    hashes = lambda k: None if k % 13 == 0 else lists(rng, 1, 4, base)[0][: k % 9]
    rows = [(None if k == 3 else k, hashes(k), hashes(k + 5), hashes(k + 3), None if k % 7 else 9.0) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, phash array<long>, dhash array<long>, audio array<long>, duration double")
    monkeypatch.setattr(P, "KEY_ITEMS", key_items)
    monkeypatch.setattr(P, "CHUNK", chunk)
    old = P.lsh_candidates(df)
    want = old.select("a", "b", *[H.list_similarity(f"a_{c}", f"b_{c}").alias(c) for c in ("phash", "dhash")]).collect()
    got = P.lsh_scored(df, lambda x, y: {c: P.listed(x, y, c) for c in P.KINDS}, "phash double, dhash double")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and len(want) > 500
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))


def test_fused_scores_of_candidates_are_those_of_single_rows(spark):
    """With lists and durations of all sorts (F37, the queries that share the step)."""
    rng = np.random.default_rng(11)
    base = rng.integers(-(2**62), 2**62, 6)
    hashes = lambda k: None if k % 13 == 0 else lists(rng, 1, 4, base)[0][: k % 9]
    seconds = lambda k: {0: None, 1: 0.0, 2: float("nan"), 3: float("inf")}.get(k % 17, 80.0 + k % 41)
    rows = [(k, hashes(k), hashes(k + 5), [int(base[k % 3]) ^ (-1 if k % 2 else 1)] if k % 4 else None, seconds(k)) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, phash array<long>, dhash array<long>, audio array<long>, duration double")
    want = P.scored(P.duration_compatible(P.lsh_candidates(df))).select("a", "b", "similarity").collect()
    score = lambda x, y: {"similarity": P.fused(x, y), "fits": P.fitting(x, y)}
    got = P.lsh_scored(df, score, "similarity double, fits boolean").where("fits").select("a", "b", "similarity").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 200


@pytest.mark.parametrize("most", [20, 1 << 13])
@pytest.mark.parametrize("clip", [True, False])
def test_pairs_are_summed_without_a_row_each(spark, monkeypatch, clip, most):
    """F4"""
    df = items(spark)
    plain = L.label_pairs(df, clip).agg(F.count(F.lit(1)), F.avg("sim"), F.min("sim"), F.max("sim")).first()
    monkeypatch.setattr(L, "LEAST_ITEMS", most)
    monkeypatch.setattr(L, "MOST_ITEMS", most)
    got = L.pair_summary(df, clip)
    monkeypatch.setattr(L, "label_pairs", None)
    assert got.first()["pairs"] == plain[0] == 90 * 89 // 2 and np.allclose(got.first()[1:], plain[1:], rtol=0, atol=1e-12)
    assert [tuple(L.pair_summary(df.where(f"id < {n}")).first()) for n in (0, 1)] == [(0, None, None, None)] * 2


def test_known_pairs_are_skipped_after_one_comparison(spark, monkeypatch):
    """F6"""
    from mediasift.plans import catalogue

    calls, compared = [], P.pairs_above
    monkeypatch.setattr(P, "pairs_above", lambda *x, **y: calls.append(1) or compared(*x, **y))
    got = catalogue.queries()["d5_skip_pairs"](spark, "/root/testdata/sf0.001")
    every = catalogue.queries()["d9_similar_pairs"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 2  # one each
    left = {(r["a"], r["b"]) for r in every.collect() if (r["a"] + r["b"]) % 3}
    assert {(r["a"], r["b"]) for r in got.collect()} == left and left


def lists_of(rng, n, most):
    sizes = rng.integers(1, most + 1, n)
    base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    flips = lambda: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, rng.integers(0, 28)).astype(np.uint64), initial=np.uint64(0))
    hashes = np.array([[base[rng.integers(0, 5)] ^ flips() for _ in range(most)] for _ in range(n)])
    return np.where(np.arange(most) < sizes[:, None], hashes, hashes[np.arange(n), sizes - 1][:, None]), sizes


@pytest.mark.parametrize("most", [1, 4, 6])
@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.95])
def test_screening_in_whole_numbers_loses_no_pair(most, threshold):
    """F11"""
    rng, weights = np.random.default_rng(most), (0.7, 0.3)
    x, y = ({"id": np.arange(n), "phash": lists_of(rng, n, most), "dhash": lists_of(rng, n, most)} for n in (37, 50))
    columns = y | {"packed": {c: [B.packed(h) for h in y[c][0].T] for c in P.KINDS}}
    got = set(zip(*map(np.ndarray.tolist, P._may_reach(x, columns, threshold, weights, ((True, True),) * 2)), strict=True))
    i, j = (v.ravel() for v in np.mgrid[:37, :50])
    best = np.maximum(*P._similarity(P._taken(x, i), P._taken(y, j), weights))
    assert {(a, b) for a, b, s in zip(i.tolist(), j.tolist(), best, strict=True) if s >= threshold} <= got
    assert all(s >= threshold - 0.02 for a, b, s in zip(i.tolist(), j.tolist(), best, strict=True) if (a, b) in got)


def test_screening_takes_little_memory():
    """F11"""
    rng = np.random.default_rng(5)
    x, y = ({"id": np.arange(n), "phash": lists_of(rng, n, 4), "dhash": lists_of(rng, n, 4)} for n in (256, 768))
    columns = y | {"packed": {c: [B.packed(h) for h in y[c][0].T] for c in P.KINDS}}
    tracemalloc.start()
    P._may_reach(x, columns, 0.7, (0.7, 0.3), ((True, True),) * 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12.25 * 256 * 1024  # bytes a place


def test_links_of_groups_are_few_and_make_the_same_groups(spark, monkeypatch):
    """F5, F7-F10, F12-F15"""
    df = items(spark, 300).drop("label", "motion_mean", "emb")
    monkeypatch.setattr(B, "FEW_BLOCKS", 3)
    monkeypatch.setattr(B.in_cells, "__defaults__", (None, None, 40, 60))
    pairs, links = P.similar_pairs(df).select("a", "b", "similarity").localCheckpoint(), P.group_links(df).localCheckpoint()
    of = lambda found: {(r["group_id"], r["id"]) for r in G.group_members(found).collect()}
    most = lambda found: {(r["group_id"], round(r["max_similarity"], 12)) for r in G.group_similarity(found, G.group_members(found)).collect()}
    assert of(links) == of(pairs) and most(links) == most(pairs) and len(of(pairs)) > 100
    assert links.where("a >= b").isEmpty() and links.count() < pairs.count() / 2


def test_no_query_on_groups_makes_all_pairs_rows(spark, monkeypatch):
    from mediasift.plans import catalogue

    monkeypatch.setattr(P, "pairs_above", None)
    for name in ("e4_member_order", "a17_group_report", "e9_scan_facts", "e5_groups_above", "l5_health_check"):
        catalogue.queries()[name](spark, "/root/testdata/sf0.001")
