"""The most similar items of very many queries, by cosine: exact, with cells of items skipped by their angles.

Equal vectors are one class, on either side. Classes of items are dealt to the nearest of some centres (by angle) and, around
it, to rings of equal width: such a cell is known by its centre and its least and largest angle to it. By the triangle
inequality on the sphere no item of a cell is nearer to a query than the query's angle to the centre lies outside of that
range. A query goes to its most promising cells first, and in each further round to some more of those that may still hold
something as good as its worst result so far; it ends when there are none. What cells and queries meet is split into blocks
of bounded size. A query that would have to visit much of the whole is spared the cells, as it would be copied to each of them: it meets
all items, in large blocks, where a product in 32-bit floats leaves few to be scored. The centres come from a bounded sample: they decide how much is skipped, not what is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from mediasift.operators.blocks import tiles
from mediasift.operators.joins import with_one
from mediasift.operators.kmeans import best_centres
from mediasift.operators.labels import dot
from mediasift.sources.shared import discard, stored

#: Centres at most, and vectors for each of them that the sample holds.
PARTS, SAMPLED = 256, 50
#: Rings of a half turn.
RINGS = 32
#: Items and queries of a block.
ITEMS, QUERIES = 1 << 14, 1 << 13
#: A round visits this many times as many cells of a query as the one before.
GROWTH = 16
#: A query that would have to look at more than such a part of all items after its first cells meets all of them, in blocks of so many items and queries.
WIDE = 4
WIDE_ITEMS, WIDE_QUERIES = 1 << 15, 1 << 14
#: Tasks for each core that these blocks are cut for, and queries of a block at least; and what is compared at once in a core's cache.
TASKS_A_CORE, LEAST_QUERIES = 3, 512
ROWS, COLUMNS = 256, 2048
#: Angles and scores are trusted to so much.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9


@dataclass(frozen=True)
class Index:
    """``items`` (cell, emb, ids): classes of equal vectors with their smallest ids. The cells' number is bounded by parts and rings."""

    items: DataFrame
    k: int
    centres: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray


@dataclass(frozen=True)
class Found:
    """``hits`` (query, id, score, rank), and how many pairs of classes were looked at, of how many there are."""

    hits: DataFrame
    looked: int
    pairs: int
    rounds: int


def _usable(rows: DataFrame, id: str) -> DataFrame:
    v = F.col("emb").cast("array<double>")
    size = dot(F.col("emb"), F.col("emb"))
    found = rows.select(F.col(id).alias("id"), v.alias("emb")).where("id is not null")
    return found.where((size > 0) & (size < float("inf")))  # a null component makes a null size, NaN is above infinity


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0).astype(float)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_units(x) @ centres.T, -1, 1))


def fit(items: DataFrame, k: int, parts: int = PARTS, seed: int = 5) -> Index | None:
    """An index of ``items`` (id, emb) for the ``k`` best; None if no item is usable.

    Ids are unique and vectors equally long. Items with a null id, or whose vector is null, has no length, or holds
    nulls or non-finite numbers, are left out.
    """
    w = Window.partitionBy("emb").orderBy("id")
    first = _usable(items, "id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)  # Spark limits each class before the shuffle
    classes = stored(first.groupBy("emb").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vector-classes")
    n = classes.count()
    if not n:
        return None
    parts = max(1, min(parts, int(n**0.5)))
    length = F.sqrt(dot(F.col("emb"), F.col("emb")))
    sample = classes.select(F.xxhash64("emb").alias("id"), "emb").orderBy("id").limit(parts * SAMPLED)
    centres = best_centres(stored(sample.select("id", F.transform("emb", lambda x: x / length).alias("emb")), "sample"), parts, tries=1, seed=seed, rounds=5)
    centres = centres[(centres * centres).sum(1) > 1e-12]  # opposite vectors may have a mean without direction
    centres = _units(centres) if len(centres) else np.eye(1, centres.shape[1])

    def deal(batches):
        for batch in batches:
            x = _matrix(batch["emb"])
            part, angle = np.zeros(len(x), np.int64), np.zeros(len(x))
            for rows in tiles(len(x), len(centres)):
                a = _angles(x[rows], centres)
                part[rows], angle[rows] = a.argmin(1), a.min(1)
            cell = part * (RINGS + 1) + (angle * (RINGS / np.pi)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle), batch["emb"], batch["ids"]], names=["cell", "angle", "emb", "ids"])

    kind = items.schema["id"].dataType.simpleString()
    dealt = stored(classes.mapInArrow(deal, f"cell int, angle double, emb array<double>, ids array<{kind}>"), "cells")
    seen = dealt.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("cell").toPandas()  # bounded by parts and rings
    discard(classes)
    return Index(dealt.select("cell", "emb", "ids"), k, centres, seen["cell"].to_numpy(), seen["low"].to_numpy(), seen["high"].to_numpy(), seen["n"].to_numpy())


def _planned(state: DataFrame, index: Index, turn: int) -> DataFrame:
    """``state`` (query, emb, worst, done) with the ``cells`` that each query visits next, and ``done`` moved on. A query that is to meet all
    items instead has none, and as ``rest`` the number of those that it has not met."""
    need, part, centres, cell, low, high, n = index.k + 1, index.cell // (RINGS + 1), index.centres, index.cell, index.low, index.high, index.n

    def run(batches):
        for batch in batches:
            x, worst, done = _matrix(batch["emb"]), batch["worst"].to_numpy(zero_copy_only=False), batch["done"].to_numpy()
            moved, visits, rest = [], [], []
            for rows in tiles(len(x), len(cell)):
                there = _angles(x[rows], centres)[:, part]
                gap = np.maximum(0, np.maximum(there - high, low - there) - ANGLE_SLACK)
                for g, least, at in zip(gap, worst[rows], done[rows], strict=True):
                    order = np.argsort(g, kind="stable")
                    end = int(np.searchsorted(-np.cos(g[order]), -(least - SCORE_SLACK), "right"))  # of those that may hold something as good
                    if turn == 0:
                        take = int(np.searchsorted(np.cumsum(n[order]), need)) + 1
                    else:
                        take = GROWTH**turn
                    wide = turn > 0 and WIDE * n[order[at:end]].sum() > n.sum()
                    rest.append(n[order[at:]].sum() if wide else 0)
                    end = at if wide else max(at, min(end, at + take))
                    visits.append(cell[order[at:end]].astype(np.int32))
                    moved.append(end)
            cells = pa.array(visits, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["query"], batch["emb"], batch["worst"], pa.array(moved, pa.int32()), cells, pa.array(rest, pa.int64())], names=["query", "emb", "worst", "done", "cells", "rest"])

    kind = state.schema["query"].dataType.simpleString()
    return state.select("query", "emb", "worst", "done").mapInArrow(run, f"query {kind}, emb array<double>, worst double, done int, cells array<int>, rest long")


def row_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first component to the last, so that equal vectors give equal sums wherever they stand."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def _best(k: int):
    """The best ids of a block of items for every query of a block."""

    def run(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(items) and len(queries):
            x, q = np.stack(items["emb"].to_list()), np.stack(queries["emb"].to_list())
            sx, sq = np.sqrt(row_dots(x, x)), np.sqrt(row_dots(q, q))
            ids, count = items["ids"].to_numpy(), np.array([len(i) for i in items["ids"]])
            flat, start, names = np.concatenate(ids), np.cumsum(count) - count, queries["query"].to_numpy()
            most = min(k, len(x))
            for rows in tiles(len(q), len(x)):
                near = (q[rows] @ x.T) / (sq[rows][:, None] * sx)
                least = np.maximum(np.partition(near, len(x) - most, axis=1)[:, len(x) - most], queries["worst"].to_numpy()[rows]) - SCORE_SLACK
                a, b = np.nonzero(near >= least[:, None])
                a = a + rows.start
                score = row_dots(x[b], q[a]) / (sx[b] * sq[a])
                each = count[b]
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[b], each)
                hit = pd.DataFrame({"query": np.repeat(names[a], each), "id": flat[at], "score": np.repeat(score, each)})
                out.append(hit.sort_values(["score", "id"], ascending=[False, True]).groupby("query", sort=False).head(k))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "score": []})

    return run


def _leading(row: np.ndarray, near: np.ndarray, least: np.ndarray, most: int, slack: float) -> np.ndarray:
    """Places of the hits (``row``, ``near``) that may be among the ``most`` best of their row; ``least`` is raised to what that takes."""
    order = np.lexsort((-near, row))
    first, end = np.searchsorted(row[order], np.arange(len(least))), np.searchsorted(row[order], np.arange(len(least)), "right")
    full = np.flatnonzero(end - first >= most)
    least[full] = np.maximum(least[full], near[order[first[full] + most - 1]] - 2 * slack)
    return np.flatnonzero(near >= least[row])


def _screened(x: np.ndarray, q: np.ndarray, worst: np.ndarray, most: int):
    """(rows of ``q``, rows of ``x``) that may be among the ``most`` best and as good as ``worst``, for some rows of ``q`` at a time: all that are,
    and hardly any others, by cosines in 32-bit floats."""
    slack = (x.shape[1] + 8) * 2.0**-23  # twice what these are off by at most
    units, asked = np.ascontiguousarray(_units(x).T, np.float32), _units(q).astype(np.float32)
    for at in range(0, len(q), ROWS):
        some = asked[at : at + ROWS]
        least = worst[at : at + ROWS] - SCORE_SLACK - slack
        row, item, near, done = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        for k, cut in enumerate(range(0, len(x), COLUMNS)):
            found = some @ units[:, cut : cut + COLUMNS]
            if k == 0 and most < found.shape[1]:
                place = found.shape[1] - most
                least = np.maximum(least, np.partition(found, place, axis=1)[:, place] - 2 * slack)
            bound = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
            a, b = np.divmod(np.flatnonzero(found >= bound[:, None]), found.shape[1])
            row, item, near = np.append(row, a), np.append(item, b + cut), np.append(near, found[a, b])
            if k + 1 >= 2 * done or cut + COLUMNS >= len(x):  # after 1, 2, 4, ... parts
                done = k + 1
                keep = _leading(row, near, least, most, slack)
                row, item, near = row[keep], item[keep], near[keep]
        yield row + at, item


def _best_of_all(k: int, schema: pa.Schema):
    """As :func:`_best`, for large blocks."""

    def run(items: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if len(items) and len(queries):
            x, q = (_matrix(t["emb"].combine_chunks()) for t in (items, queries))
            sx, sq = np.sqrt(row_dots(x, x)), np.sqrt(row_dots(q, q))
            lists, names = items["ids"].combine_chunks(), queries["query"].to_numpy()
            flat, count = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy().astype(np.int64)
            start = np.cumsum(count) - count
            for a, b in _screened(x, q, queries["worst"].to_numpy(), min(k, len(x))):
                score, each = row_dots(x[b], q[a]) / (sx[b] * sq[a]), count[b]
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[b], each)
                hit = pd.DataFrame({"query": np.repeat(names[a], each), "id": flat[at], "score": np.repeat(score, each)})
                out.append(hit.sort_values(["score", "id"], ascending=[False, True]).groupby("query", sort=False).head(k))
        return pa.Table.from_pandas(pd.concat(out), schema, preserve_index=False) if out else schema.empty_table()

    return run


def _met_by_all(index: Index, wide: DataFrame, m: int) -> DataFrame:
    """(query, id, score): the best of all items for each of ``m`` queries (query, emb, worst), from every block."""
    s = -(-int(index.n.sum()) // WIDE_ITEMS)
    least = -(-TASKS_A_CORE * wide.sparkSession.sparkContext.defaultParallelism // s)
    t = max(-(-m // WIDE_QUERIES), min(least, -(-m // LEAST_QUERIES)))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    there = index.items.select(F.pmod(F.xxhash64("emb"), F.lit(s)).cast("int").alias("a"), every(t).alias("b"), "emb", "ids")
    here = wide.select(every(s).alias("a"), F.pmod(F.xxhash64("query"), F.lit(t)).cast("int").alias("b"), "query", "emb", "worst")
    blocks = there.repartition(s * t, "a", "b").groupBy("a", "b").cogroup(here.repartition(s * t, "a", "b").groupBy("a", "b"))  # not fewer tasks for few bytes
    found = StructType([StructField("query", wide.schema["query"].dataType), StructField("id", index.items.schema["ids"].dataType.elementType), StructField("score", DoubleType())])
    return blocks.applyInArrow(_best_of_all(index.k + 1, to_arrow_schema(found)), found)


def search(index: Index, queries: DataFrame) -> Found:
    """The ``k`` items with the highest cosine for each of ``queries`` (query, emb), the item with the query's own id left out; ties
    go to the smaller id.

    Query ids are unique and vectors as long as the items'. Queries with a null id or without a usable vector, as in :func:`fit`, find nothing.
    """
    spark, need = queries.sparkSession, index.k + 1
    asked = stored(_usable(queries, "query"), "queries")
    classes = stored(asked.groupBy("emb").agg(F.min("id").alias("query"), F.count(F.lit(1)).alias("n")), "query-classes")
    kind, id_kind = queries.schema["query"].dataType.simpleString(), index.items.schema["ids"].dataType.elementType.simpleString()
    best = spark.createDataFrame([], f"query {kind}, id {id_kind}, score double")
    state = classes.select("query", "emb", F.lit(float("-inf")).alias("worst"), F.lit(0).alias("done"))
    size, looked, turn = dict(zip(index.cell.tolist(), index.n.tolist(), strict=True)), 0, 0
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    while True:
        plan = stored(_planned(state, index, turn), "plan")
        visits = plan.select("query", "emb", "worst", F.explode("cells").alias("cell"))
        met = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}  # one row a cell
        wide = plan.where("rest > 0").select("query", "emb", "worst", "rest")
        many = wide.agg(F.count(F.lit(1)).alias("n"), F.sum("rest").alias("rest")).first()
        if not met and not many["n"]:
            break
        looked += sum(m * size[c] for c, m in met.items()) + (many["rest"] or 0)
        hits = best
        if many["n"]:  # these find all that they had again
            hits = best.join(wide.select("query").hint("merge"), "query", "left_anti").unionByName(_met_by_all(index, wide.drop("rest"), many["n"]))
        if met:
            splits = spark.createDataFrame([(c, -(-size[c] // ITEMS), -(-m // QUERIES)) for c, m in met.items()], "cell int, s long, t long")
            there = index.items.join(F.broadcast(splits), "cell").select("cell", F.pmod(F.xxhash64("emb"), "s").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)).alias("b"), "emb", "ids")
            here = visits.join(F.broadcast(splits), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("a"), F.pmod(F.xxhash64("query"), "t").alias("b"), "query", "emb", "worst")
            cell = ["cell", "a", "b"]
            hits = hits.unionByName(there.groupBy(*cell).cogroup(here.groupBy(*cell)).applyInPandas(_best(need), f"query {kind}, id {id_kind}, score double"))
        found = stored(hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= need).drop("r"), "best")
        worst = found.groupBy("query").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("least"))
        state = plan.where("rest = 0").select("query", "emb", "done").join(worst.hint("merge"), "query", "left").select("query", "emb", F.when(F.col("held") >= need, F.col("least")).otherwise(float("-inf")).alias("worst"), "done")
        discard(best)
        best, turn = found, turn + 1
    listed = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "score"))).alias("found"))
    one = stored(classes.join(listed.hint("merge"), "query").select("emb", "n", "found"), "found")
    every = with_one(asked, one, ["emb"]).select(F.col("id").alias("query"), F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, index.k).alias("found"))
    hits = every.select("query", F.posexplode("found").alias("r", "f")).select("query", "f.id", "f.score", (F.col("r") + 1).alias("rank"))
    pairs = classes.count() * int(index.n.sum())
    return Found(hits, looked, pairs, turn)
