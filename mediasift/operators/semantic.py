"""Tags, purposes, clusters and search over embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.operators import blocks as B
from mediasift.operators.joins import against
from mediasift.operators.labels import cosine, dot
from mediasift.operators.kmeans import assigned, best_centres
from mediasift.operators.nearest import ITEMS, QUERIES, SCORE_SLACK, row_dots
from mediasift.sources.shared import stored

UNKNOWN = "unknown"
#: Fixed values.
SCENE, OBJECT, ACTION = 3, 2, 1
READY_QUALITY, READY_CONFIDENCE = 0.4, 0.25


def normalised(v: Column) -> Column:
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def pooled(frames: DataFrame) -> DataFrame:
    """(id, emb): mean of the normalised frame vectors of each item, normalised again."""
    flat = frames.select("id", F.posexplode(normalised(F.col("emb"))).alias("k", "v")).groupBy("id", "k").agg(F.avg("v").alias("v"))
    mean = flat.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("m"))
    return mean.select("id", normalised(F.col("m")).alias("emb"))


def zero_shot_tags(items: DataFrame, prompts: DataFrame, top: int = 3) -> DataFrame:
    """(id, kind, rank, label, score): the best labels of each kind by mean similarity to their prompts.

    ``prompts`` (kind, label, emb) is a list.
    """
    scores = against(items.select("id", F.col("emb").alias("_e")), prompts).select("id", "kind", "label", dot(F.col("_e"), F.col("emb")).alias("s"))
    mean = scores.groupBy("id", "kind", "label").agg(F.avg("s").alias("score"))
    w = Window.partitionBy("id", "kind").orderBy(F.desc("score"), "label")
    return mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def purposes(tags: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, purpose, votes) by the number of a purpose's keywords among an item's tags (id, label); the first rule wins
    ties; items without a hit are not listed. ``rules`` (purpose, keyword, ord) is a short hand-written list."""
    hits = tags.join(F.broadcast(rules), tags["label"] == rules["keyword"]).groupBy("id", "purpose").agg(F.countDistinct("keyword").alias("votes"), F.min("ord").alias("ord"))
    best = hits.groupBy("id").agg(F.max(F.struct("votes", (-F.col("ord")).alias("o"), "purpose")).alias("b"))
    return best.select("id", F.col("b.purpose").alias("purpose"), F.col("b.votes").alias("votes"))


def training_ready(confidence: Column, quality: Column, purpose: Column, least: float = READY_CONFIDENCE) -> Column:
    return F.coalesce((confidence >= least) & (quality >= READY_QUALITY) & (purpose != UNKNOWN), F.lit(False))


def _best(k: int):
    """The ``k`` best ids of a block of items for every query of a block, its own id left out."""

    def run(items: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(items) and len(queries):
            x, q = np.stack(items["emb"].to_list()), np.stack(queries["emb"].to_list())
            sx, sq = np.sqrt(row_dots(x, x)), np.sqrt(row_dots(q, q))
            ids, names, most = items["id"].to_numpy(), queries["query"].to_numpy(), min(k, len(x))
            for rows in B.tiles(len(q), len(x)):
                near = (q[rows] @ x.T) / (sq[rows][:, None] * sx)
                near[(names[rows][:, None] == ids[None]).astype(bool)] = -np.inf
                least = np.partition(near, len(x) - most, axis=1)[:, len(x) - most] - SCORE_SLACK
                a, b = np.nonzero((near >= least[:, None]) & (near > -np.inf))
                a = a + rows.start
                hit = pd.DataFrame({"query": names[a], "id": ids[b], "score": row_dots(x[b], q[a]) / (sx[b] * sq[a])})
                out.append(hit.sort_values(["score", "id"], ascending=[False, True]).groupby("query", sort=False).head(k))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "score": []})

    return run


def search(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank): the ``k`` most similar items of each of a stated set of queries (query, emb), itself
    left out. Blocks of items meet blocks of queries, and each keeps its own best before the shuffle. Query ids are unique.

    A vector without a length or with a null is as similar as 0 to all. Such vectors, and those of other lengths or with numbers that aren't
    finite, are compared one pair at a time, as they are expected to be few.
    """
    width = queries.agg(F.max(F.size("emb")).alias("n")).first()["n"]
    size = dot(F.col("emb"), F.col("emb"))
    plain = F.coalesce((F.size("emb") == F.lit(width)) & (size > 0) & (size < float("inf")), F.lit(False)).alias("plain")
    x = stored(items.select("id", F.col("emb").cast("array<double>").alias("emb"), plain).where("id is not null"), "items")
    q = stored(queries.select("query", F.col("emb").cast("array<double>").alias("emb"), plain).where("query is not null"), "queries")
    (n, odd), (m, strange) = ((r[0], r[1]) for t in (x, q) for r in [t.agg(F.count_if("plain"), F.count_if(~F.col("plain"))).first()])
    s, t = max(1, -(-n // ITEMS)), max(1, -(-m // QUERIES))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    there = x.where("plain").select("id", "emb", F.pmod(F.xxhash64("id"), F.lit(s)).cast("int").alias("a"), every(t).alias("b"))
    here = q.where("plain").select("query", "emb", every(s).alias("a"), F.pmod(F.xxhash64("query"), F.lit(t)).cast("int").alias("b"))
    blocks = (there.repartition(s * t, "a", "b").groupBy("a", "b")).cogroup(here.repartition(s * t, "a", "b").groupBy("a", "b"))  # not fewer tasks for few bytes
    hits = blocks.applyInPandas(_best(k), f"query {q.schema['query'].dataType.simpleString()}, id {x.schema['id'].dataType.simpleString()}, score double")
    for some, asked in ((x.where("not plain"), q), (x.where("plain"), q.where("not plain"))) if odd or strange else ():
        pairs = some.select("id", F.col("emb").alias("_e")).join(asked.hint("shuffle_replicate_nl"), F.col("id") != F.col("query"))
        hits = hits.unionByName(pairs.select("query", "id", cosine(F.col("_e"), F.col("emb")).alias("score")))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)  # Spark limits each group before the shuffle


def keyword_search(items: DataFrame, text: str, query: str) -> DataFrame:
    """(id, score) of the items that hold any of the query's words: the share of words held."""
    words = sorted({w for w in query.lower().split() if w})
    held = F.aggregate(F.array(*[F.contains(F.lower(text), F.lit(w)).cast("int") for w in words]), F.lit(0), lambda s, x: s + x)
    return items.select("id", (held / len(words)).alias("score")).where("score > 0")


def auto_cluster_count(n: int) -> int:
    return max(1, min(n, int((n / 2) ** 0.5)))


def classify_cluster_count(n: int) -> int:
    return min(20, max(2, n // 5))


def kmeans(items: DataFrame, k: int, tries: int = 10, seed: int = 42, rounds: int = 300) -> DataFrame:
    """(id, cluster): k-means on the vectors, the best of some starts by cost (:mod:`mediasift.operators.kmeans`)."""
    vectors = stored(items.where("emb is not null").select("id", F.col("emb").cast("array<double>").alias("emb")), "vectors")  # read in every round
    return assigned(vectors, best_centres(vectors, k, tries, seed, rounds))


def cluster_names(clusters: DataFrame, tags: DataFrame, most: int = 60) -> DataFrame:
    """(cluster, name): the three heaviest tags of its items, joined; ``class_<n>`` without tags. ``tags`` (id, kind, label)
    weigh by kind."""
    weight = F.when(F.col("kind") == "scene", SCENE).when(F.col("kind") == "object", OBJECT).otherwise(ACTION)
    sums = clusters.join(tags.hint("merge"), "id").groupBy("cluster", "label").agg(F.sum(weight).alias("w"))
    w = Window.partitionBy("cluster").orderBy(F.desc("w"), "label")
    top = sums.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda s: s["label"]), "_").alias("name"))
    every = clusters.select("cluster").distinct()
    return every.join(top.hint("merge"), "cluster", "left").select("cluster", F.substring(F.coalesce("name", F.concat(F.lit("class_"), F.col("cluster").cast("string"))), 1, most).alias("name"))
