import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm import veccodes as V

SCHEMA = "vec_id long, embedding array<float>, label int, id string, part int, n int, x string"


def brute(rows, parts, entries, rounds):
    """Codes, errors and books by all distances, in whole numbers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 256).astype(np.int64).reshape(len(rows), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for k in range(rounds + 1):
        d = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(parts)]
        code = np.stack([y.argmin(1) for y in d], 1)
        if k < rounds:
            for p in range(parts):
                for e in set(code[:, p].tolist()):
                    mine = x[code[:, p] == e, p]
                    books[p][e] = [int(s) // len(mine) for s in mine.sum(0)]
    error = sum(y.min(1) for y in d)
    return {(r[0], tuple(np.float32(r[1]))): ("".join("%02x" % c for c in code[k]), int(error[k]), r[2]) for k, r in enumerate(rows)}, books


def vectors(n, width, kind, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "grid":  # many equal distances
        v = rng.integers(-2, 3, (n, width)) / 4
    elif kind == "copies":
        v = rng.normal(size=(n, width))
        v[: n // 3] = v[0]
    else:
        v = rng.normal(size=(20, width))[rng.integers(0, 20, n)] + 0.05 * rng.normal(size=(n, width))
    return [(k, v[k].astype(np.float32).tolist(), None if k % 5 == 0 else k % 3) for k in range(n)]


@pytest.mark.parametrize("kind", ["grid", "copies", "clusters"])
def test_equals_all_distances(spark, kind):
    rows = vectors(900, 12, kind)
    df = spark.createDataFrame([r + (None,) * 4 for r in rows], SCHEMA).repartition(5)
    want, books = brute(rows, 4, 16, 5)
    found = V.train(df, parts=4, entries=16, rounds=5)
    assert all((a == b).all() for a, b in zip(found.books, books, strict=True))
    got = {r["id"]: (r["code"], r["error"]) for r in V.codes(found).collect()}
    assert got == {k[0]: v[:2] for k, v in want.items()}
    assert len(found.looked) == 5 and all(n.sum() == 900 * 4 for _, n in found.looked)


def test_bounds_spare_most_comparisons_once_entries_settle(spark):
    df = spark.createDataFrame([r + (None,) * 4 for r in vectors(900, 12, "clusters")], SCHEMA)
    b, looked = V.train(df, parts=4, entries=16, rounds=6).looked[-1]
    assert looked[0] > 0.6 * looked.sum() and looked[b + 1 :].sum() < 0.1 * looked.sum()


def test_b_follows_what_was_needed():
    few, many = np.zeros(V.MOST_B + 2, np.int64), np.zeros(V.MOST_B + 2, np.int64)
    few[[0, 1, 2]], many[[0, 5]] = (90, 8, 2), (50, 50)
    assert V.adapted(few, 4) == 1 and V.adapted(many, 4) == 8 and V.adapted(np.zeros(V.MOST_B + 2, np.int64), 4) == 4


def test_bounds_are_below_distances_after_moves():
    rng = np.random.default_rng(3)
    x, book = rng.integers(-300, 300, (500, 4)), rng.integers(-300, 300, (32, 4))
    state = V.Bounds.fresh(x, book, 4)
    for k in range(6):
        new = book + rng.integers(-9, 10, book.shape)
        gap = new - book
        state.moved(x, new, np.sqrt((gap * gap).sum(1)) * (1 + 1e-12))
        state, book = V.Bounds.unpacked(state.resized((6, 3, 3, 8, 1, 2)[k]).packed()), new
        d = np.sqrt(V.squares(x, book).astype(float))
        assert (state.code == V.squares(x, book).argmin(1)).all()
        for row in range(500):
            near = {int(e): f for e, f in zip(state.near[row], state.low[row], strict=True) if e != V.NONE}
            assert all(f <= d[row, e] for e, f in near.items())
            assert all(state.outer[row] <= d[row, e] for e in range(32) if e not in near and e != state.code[row])


def test_odd_rows(spark):
    good = [(k, [0.01 * k] * 16, k % 2) for k in range(70)] + [(None, [0.5] * 16, None), (7, [0.07] * 16, 1), (7, [0.07] * 16, 1)]
    bad = [(900, None, 1), (901, [], 1), (902, [None] + [0.1] * 15, 1), (903, [float("nan")] + [0.1] * 15, 1), (904, [float("-inf")] + [0.1] * 15, 1), (905, [0.1] * 32, 1), (906, [1e30] * 16, 1)]
    df = spark.createDataFrame([r + (None,) * 4 for r in good + bad], SCHEMA)
    got = V.compressed(df).collect()
    want, books = brute(good, 16, 64, 2)
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in got) == sorted((str(k), *want[(k, tuple(np.float32(v)))][:2]) for k, v, _ in good)
    sums = {}
    for k, v, label in good:
        sums[label] = sums.get(label, 0) + want[(k, tuple(np.float32(v)))][1]
    assert {r["label_error"] for r in got if r["vec_id"] is None} == {sums[None]}
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.reshape(-1).tolist()).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {digest}
    assert V.compressed(df.where("vec_id > 899 and vec_id <> 905")).count() == 0 and V.compressed(df.where("false")).columns == V.compressed(df).columns


def test_few_vectors_and_large_components(spark):
    rows = [(k, [200000.0 * (-1) ** k + k] * 32, 1) for k in range(5)]
    df = spark.createDataFrame([r + (None,) * 4 for r in rows], SCHEMA)
    want, _ = brute(rows, 16, 64, 2)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in V.compressed(df).collect()} == {k[0]: v[:2] for k, v in want.items()}


def test_hot_label_is_joined_around(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise((F.col("id") % 50).cast("int")).alias("label"), F.lit("00").alias("code"), F.lit(2).cast("long").alias("error"))
    got = {(r["label"], r["label_error"]) for r in V.with_label_error(rows).collect()}
    assert (1, 2 * rows.where("label = 1").count()) in got
