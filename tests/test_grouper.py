"""Complete-linkage split, ranks and components against plain versions, and around hot keys with adaptive execution off."""

import random
import tracemalloc
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mediasift.operators import components as components_module
from mediasift.operators import groups as G
from mediasift.operators import joins
from mediasift.operators.components import components

LINKS = "a long, b long, similarity double"


@contextmanager
def plain_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def split(links, floor):
    """The definition: while a pair is below the floor (absent pairs are 0), the lowest mean goes, the first on ties."""
    sim = {(min(a, b), max(a, b)): s for a, b, s in links}
    of = lambda a, b: sim.get((min(a, b), max(a, b)), 0.0)
    label = {x: x for p in sim for x in p}
    for _ in label:
        for (a, b), s in sim.items():
            if s >= floor:
                label[a] = label[b] = min(label[a], label[b])
    out = []
    for root in set(label.values()):
        left = sorted(x for x in label if label[x] == root)
        while len(left) > 1 and min(of(a, b) for a in left for b in left if a != b) < floor:
            mean = {a: round(sum(of(a, b) for b in left if b != a) / (len(left) - 1), 9) for a in left}
            left.remove(min(left, key=lambda a: mean[a]))
        if len(left) > 1:
            out.append(left)
    return sorted(out)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r["group_id"], []).append(r["id"])
    return sorted(sorted(g) for g in out.values())


def test_weak_links_count_at_their_value(spark):
    links = [(1, 2, 0.85), (2, 3, 0.86), (3, 4, 0.87), (1, 4, 0.88), (2, 4, 0.79)]
    assert groups(G.split_groups(spark.createDataFrame(links, LINKS), 0.8).collect()) == split(links, 0.8) == [[3, 4]]


@pytest.mark.parametrize("seed", range(3))
def test_split_is_as_defined(spark, seed):
    rnd = random.Random(seed)
    links = []
    for block in range(25):
        n = rnd.randrange(2, 9)
        links += [(20 * block + i, 20 * block + j, rnd.choice((0.5, 0.7, 0.79, 0.8, 0.85, 0.9, 0.97))) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.8]
    assert groups(G.split_groups(spark.createDataFrame(links, LINKS), 0.8).collect()) == split(links, 0.8)


def test_copies_weigh_as_if_they_were_items(spark):
    rnd = random.Random(5)
    links, copies, spelled = [], [], []
    for block in range(20):
        ids = [100 * block + k for k in range(5)]
        more = {i: [i + 10 * (1 + k) for k in range(rnd.randrange(4))] for i in ids}
        sims = {(i, j): rnd.choice((0.71, 0.76, 0.82, 0.9, 0.95)) + rnd.random() / 1000 for i in ids for j in ids if i < j and rnd.random() < 0.85}
        links += [(i, j, s) for (i, j), s in sims.items()]
        copies += [(i, c) for i in ids for c in more[i]]
        kind = {x: i for i in ids for x in [i, *more[i]]}
        spelled += [(x, y, 1.0 if kind[x] == kind[y] else sims[min(kind[x], kind[y]), max(kind[x], kind[y])]) for x in kind for y in kind if x < y and (kind[x] == kind[y] or (min(kind[x], kind[y]), max(kind[x], kind[y])) in sims)]
    got = groups(G.split_groups(spark.createDataFrame(links, LINKS), 0.8, spark.createDataFrame(copies, "a long, b long")).collect())
    whole = split(spelled, 0.8)
    assert all(g in got for g in whole)  # what else there is are copies whose representative was ejected: equal items stay together
    assert all(len({x % 10 for x in g}) == 1 for g in got if g not in whole)


def test_ranks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice((1, 1, 1, 2, 3)), i, rnd.randrange(9)) for i in range(3000)]
    with plain_plans(spark):
        got = G.ranked(spark.createDataFrame(rows, "g long, id long, size long"), "g", [F.desc("size"), F.asc("id")]).collect()
    for g in (1, 2, 3):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [(r["id"], r["rank"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == [(r[1], k + 1) for k, r in enumerate(want)]


def test_hub_and_giant_component(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    monkeypatch.setattr(components_module, "PART_LINKS", 100)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1500)] + [(5, 1500), (2000, 2001)]
    with plain_plans(spark):
        got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: 2000 if x >= 2000 else 0 for e in edges for x in e}


def test_join_around_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    rows = spark.createDataFrame([(None if k % 7 == 0 else k % 3 * (k % 100), k) for k in range(3000)], "key long, id long")
    one = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    with plain_plans(spark):
        got = {(r["key"], r["id"], r["first"]) for r in joins.with_one(rows, one, ["key"]).collect()}
    first = {}
    for r in rows.collect():
        first[r["key"]] = min(r["id"], first.get(r["key"], r["id"]))
    assert got == {(r["key"], r["id"], first[r["key"]]) for r in rows.collect() if r["key"] is not None}


def test_links_of_a_large_component_are_not_held(monkeypatch):
    """half a million links both ways, in batches as Spark gives them, take a few numbers a member."""
    monkeypatch.setattr(G, "HELD_BYTES", 1 << 16)
    n, rng = 1000, np.random.default_rng(3)
    near = np.triu(rng.integers(700_000_000, 1_000_000_000, (n, n)), 1)
    near[:, n // 2 :][rng.random((n, n // 2)) < 0.3] = 0  # not linked
    near = np.triu(near, 1) + np.triu(near, 1).T
    more = rng.integers(0, 3, n)
    left = list(range(n))  # by the definition, in whole numbers
    while (low := (near[np.ix_(left, left)] < 950_000_000) & ~np.eye(len(left), dtype=bool)).any():
        sums = near[np.ix_(left, left)] @ (1 + more[left]) + more[left] * 10**9
        left.pop(int(np.argmin(np.rint(sums / G.TIE))))
    x, y = np.nonzero(near)
    coded = (near[x, y] * 2 + (near[x, y] >= 950_000_000)).astype(np.int32)
    table = pa.table({"x": x * 7, "y": y * 7, "near": coded, "more_x": more[x].astype(np.int32), "more_y": more[y].astype(np.int32)})
    batches = table.to_batches(max_chunksize=10_000)
    tracemalloc.start()
    kept = G.ejected(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept.tolist() == [7 * k for k in left] and len(x) > 700_000 and peak < 4 << 20
    backwards = pa.table({c: table[c].to_numpy()[::-1] for c in table.column_names}).to_batches(max_chunksize=10_000)
    with pytest.raises(ValueError):
        G.ejected(iter(backwards))
