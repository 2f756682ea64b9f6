"""Pruned search against the search over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.operators import nearest as N
from mediasift.operators import semantic as M


def clustered(n, clusters, spread, seed=3, width=16):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, width))
    return [(k, (middle[k % clusters] + spread * rng.normal(size=width)).tolist()) for k in range(n)]


def rows_of(hits):
    return {(r["query"], r["rank"]): (r["id"], r["score"]) for r in hits.select("query", "id", "score", "rank").collect()}


def both(spark, rows, k, queries="true"):
    items = spark.createDataFrame(rows, "id long, emb array<double>").repartition(4).cache()
    asked = items.where(queries).select(F.col("id").alias("query"), "emb")
    found = N.search(N.fit(items, k), asked)
    return found, rows_of(found.hits), rows_of(M.search(items, asked, k))


@pytest.mark.parametrize("blocks", [(N.ITEMS, N.QUERIES), (50, 30)])
def test_all_rows_as_queries(spark, monkeypatch, blocks):
    monkeypatch.setattr(N, "ITEMS", blocks[0])
    monkeypatch.setattr(N, "QUERIES", blocks[1])
    found, mine, full = both(spark, clustered(3000, 40, 0.1), 5)
    assert mine == full and len(mine) == 15000  # bit by bit, ties and ranks included
    assert found.looked < found.pairs / 10, (found.looked, found.pairs)  # most cells are skipped


def test_vectors_without_clusters(spark):
    rng = np.random.default_rng(8)
    found, mine, full = both(spark, [(k, rng.normal(size=12).tolist()) for k in range(800)], 3, "id % 3 = 0")
    assert mine == full and found.looked <= found.pairs


def test_a_third_of_all_rows_are_copies(spark):
    rows = clustered(600, 10, 0.2)
    rows = [(k, rows[0][1] if k % 3 == 0 else v) for k, v in rows]
    found, mine, full = both(spark, rows, 4)
    assert mine == full and found.pairs == 401 * 401  # copies meet once


def test_ties_go_to_the_smaller_id(spark):
    turned = [(k, [0.0] * (k % 4) + [1.0] + [0.0] * (3 - k % 4)) for k in range(40)]
    for k in (1, 9, 25, 60):
        _, mine, full = both(spark, turned, k)
        assert mine == full


def test_odd_vectors(spark):
    odd = [(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1e200, 1e200]), (9, [-0.0, 2.0])]
    items = spark.createDataFrame(odd, "id long, emb array<double>")
    asked = items.select(F.col("id").alias("query"), "emb")
    got = rows_of(N.search(N.fit(items, 5), asked).hits)
    assert {q for q, _ in got} == {1, 2, 9} and [got[1, r][0] for r in (1, 2)] == [9, 2] and len(got) == 6
    one = items.where("id = 1")
    assert N.search(N.fit(one, 5), asked.where("query = 1")).hits.count() == 0  # only itself
    assert N.search(N.fit(one, 5), asked.where("query = 2")).hits.count() == 1
    assert N.search(N.fit(items, 5), asked.where("false")).hits.count() == 0
    assert N.fit(items.where("id = 4"), 5) is None


def test_stated_queries_meet_blocks_not_rows(spark, monkeypatch):
    """As row by row, with equal vectors, and with vectors that are null, have no length, another length, a null or NaN."""
    from pyspark.sql import Window

    from mediasift.operators.labels import cosine

    rng = np.random.default_rng(8)
    rows = [(k, rng.integers(-3, 4, 4).astype(float).tolist()) for k in range(120)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, 2.0]), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4)]
    items = spark.createDataFrame(rows, "id long, emb array<double>")
    asked = items.where("id % 10 = 0 or id > 200").withColumnRenamed("id", "query")
    pairs = items.select("id", F.col("emb").alias("_e")).crossJoin(asked).where("id <> query").select("query", "id", cosine(F.col("_e"), F.col("emb")).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where("rank <= 5")
    monkeypatch.setattr(M, "ITEMS", 40)
    monkeypatch.setattr(M, "QUERIES", 7)
    got = M.search(items, asked, 5)
    assert sorted(map(repr, got.select("query", "rank", "id", "score").collect())) == sorted(map(repr, want.select("query", "rank", "id", "score").collect()))
    assert "CoGroup" in got._jdf.queryExecution().toString()


def test_queries_that_nothing_spares_meet_blocks_not_cells(spark, monkeypatch):
    """Vectors without clusters, a fifth of them copies: after the first cells all is done in one round, with the same rows (F35)."""
    rng = np.random.default_rng(8)
    some = rng.integers(-4, 5, (900, 12)).astype(float)
    some[::5] = some[0]
    for name, value in (("WIDE_ITEMS", 200), ("WIDE_QUERIES", 90), ("ROWS", 16), ("COLUMNS", 40)):
        monkeypatch.setattr(N, name, value)
    found, mine, full = both(spark, [(k, v.tolist()) for k, v in enumerate(some)], 6, "id % 2 = 0")
    assert mine == full and len(mine) == 450 * 6
    assert found.rounds == 2 and found.looked <= found.pairs
