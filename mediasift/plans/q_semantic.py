"""Registered queries: tags, purposes, clusters, search, segments, and features over event rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.operators import nearest as N
from mediasift.operators import segments as G
from mediasift.operators import semantic as M
from mediasift.plans import fixtures as X
from mediasift.plans import q_pairs
from mediasift.plans.q_labels import dot
from mediasift.plans.q_pairs import PAIRS
from mediasift.plans.registry import query
from mediasift.sources.tables import table

NORM = "[x / sqrt(" + dot("emb", "emb") + ") FOR x IN CAST(emb AS DOUBLE[])]"
PROMPT = f"prompts AS (SELECT CASE WHEN CAST(substr(label, 2) AS INT) % 2 = 0 THEN 'scene' ELSE 'object' END AS kind, label, emb FROM (SELECT label, arg_min(emb, id) AS emb FROM label_signature GROUP BY label)),"


def items(spark, sf_dir):
    return X.label_signature(spark, sf_dir).select("id", "label", "emb")


def prompts(spark, sf_dir):
    kind = F.when(F.expr("cast(substr(label, 2) as int) % 2 = 0"), "scene").otherwise("object")
    return items(spark, sf_dir).groupBy("label").agg(F.min_by("emb", "id").alias("emb")).select(kind.alias("kind"), "label", "emb")


@query("c13_embedding_pooling", "SELECT id, round(sum(v * v), 6) AS size, round(sum(v), 6) AS total FROM (SELECT id, k, m / sqrt(sum(m * m) OVER (PARTITION BY id)) AS v FROM (SELECT label AS id, k, avg(n[k]) AS m FROM (SELECT label, n, unnest(range(1, 65)) AS k FROM (SELECT label, " + NORM + " AS n FROM label_signature)) GROUP BY ALL)) GROUP BY id")
def _(spark, sf_dir):
    p = M.pooled(items(spark, sf_dir).select(F.col("label").alias("id"), "emb"))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return p.select("id", F.round(add(F.transform("emb", lambda x: x * x)), 6).alias("size"), F.round(add(F.col("emb")), 6).alias("total"))


@query("d14_zero_shot_tags", f"SELECT id, kind, rank, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY score DESC, label) AS rank FROM (SELECT l.id, kind, p.label, {dot('l.emb', 'p.emb')} AS score FROM label_signature l, prompts p)) WHERE rank <= 3", PROMPT)
def _(spark, sf_dir):
    t = M.zero_shot_tags(items(spark, sf_dir), prompts(spark, sf_dir))
    return t.select("id", "kind", F.col("rank").cast("long").alias("rank"), "label", F.round("score", 6).alias("score"))


@query("d17_search", f"SELECT query, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query, l.id, {dot('l.emb', 'q.emb')} / (sqrt({dot('l.emb', 'l.emb')}) * sqrt({dot('q.emb', 'q.emb')})) AS score FROM label_signature l, label_signature q WHERE q.id % 100 = 0 AND l.id <> q.id)) WHERE rank <= 10")
def _(spark, sf_dir):
    e = items(spark, sf_dir)
    found = M.search(e.select("id", "emb"), e.where("id % 100 = 0").select(F.col("id").alias("query"), "emb"), 10)
    return found.select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("d17_search_all", f"SELECT query, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query, l.id, {dot('l.emb', 'q.emb')} / (sqrt({dot('l.emb', 'l.emb')}) * sqrt({dot('q.emb', 'q.emb')})) AS score FROM label_signature l, label_signature q WHERE l.id <> q.id)) WHERE rank <= 10")
def _(spark, sf_dir):
    e = items(spark, sf_dir).select("id", "emb")
    index = N.fit(e, 10)
    if index is None:
        return e.select(F.col("id").alias("query"), "id", F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("score")).where("false")
    found = N.search(index, e.select(F.col("id").alias("query"), "emb")).hits
    return found.select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("d18_keyword_search", "SELECT id, round(s / 3.0::DOUBLE, 6) AS score FROM (SELECT id, contains(t, 'street')::INT + contains(t, 'car')::INT + contains(t, 'moving')::INT AS s FROM (SELECT id, lower(concat_ws(' ', scene, object, action)) AS t FROM semantic)) WHERE s > 0")
def _(spark, sf_dir):
    found = M.keyword_search(X.semantic(spark, sf_dir).withColumn("t", F.concat_ws(" ", "scene", "object", "action")), "t", "Street CAR moving")
    return found.select("id", F.round("score", 6).alias("score"))


RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{k}', {i})" for i, (p, k) in enumerate(X.RULES)) + ") AS v(purpose, keyword, ord)),"


@query("e20_purpose_vote", "SELECT id, purpose, votes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, ord) AS k FROM (SELECT id, purpose, count(DISTINCT keyword) AS votes, min(ord) AS ord FROM (SELECT id, unnest([scene, object, action]) AS label FROM semantic) JOIN rules ON label = keyword GROUP BY id, purpose)) WHERE k = 1", RULES)
def _(spark, sf_dir):
    rules = spark.createDataFrame([(p, k, i) for i, (p, k) in enumerate(X.RULES)], "purpose string, keyword string, ord int")
    tags = X.semantic(spark, sf_dir).select("id", F.explode(F.array("scene", "object", "action")).alias("label"))
    return M.purposes(tags, rules)


@query("c15_semantic_assembly", "SELECT id, coalesce(purpose, 'unknown') AS purpose, semantic_conf >= 0.25 AND quality_score >= 0.4 AND purpose IS NOT NULL AS ready FROM semantic LEFT JOIN (SELECT id, purpose FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, ord) AS k FROM (SELECT id, purpose, count(DISTINCT keyword) AS votes, min(ord) AS ord FROM (SELECT id, unnest([scene, object, action]) AS label FROM semantic) JOIN rules ON label = keyword GROUP BY id, purpose)) WHERE k = 1) USING (id)", RULES)
def _(spark, sf_dir):
    rules = spark.createDataFrame([(p, k, i) for i, (p, k) in enumerate(X.RULES)], "purpose string, keyword string, ord int")
    s = X.semantic(spark, sf_dir)
    votes = M.purposes(s.select("id", F.explode(F.array("scene", "object", "action")).alias("label")), rules)
    s = s.join(votes.hint("merge"), "id", "left").withColumn("purpose", F.coalesce("purpose", F.lit(M.UNKNOWN)))
    return s.select("id", "purpose", M.training_ready(F.col("semantic_conf"), F.col("quality_score"), F.col("purpose")).alias("ready"))


@query("e21_kmeans")
def _(spark, sf_dir):
    e = items(spark, sf_dir)
    return M.kmeans(e, M.auto_cluster_count(e.count()))


@query("e22_cluster_names", "SELECT cluster, substr(coalesce(string_agg(label, '_' ORDER BY r), 'class_' || cluster), 1, 60) AS name FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, label) AS r FROM (SELECT cluster, label, sum(w) AS w FROM (SELECT id % 5 AS cluster, scene AS label, 3 AS w FROM semantic UNION ALL SELECT id % 5, object, 2 FROM semantic UNION ALL SELECT id % 5, action, 1 FROM semantic WHERE action IS NOT NULL) GROUP BY ALL)) WHERE r <= 3 GROUP BY cluster")
def _(spark, sf_dir):
    s = X.semantic(spark, sf_dir)
    tags = s.select("id", F.explode(F.create_map(F.lit("scene"), "scene", F.lit("object"), "object", F.lit("action"), "action")).alias("kind", "label")).where("label is not null")
    return M.cluster_names(s.select("id", (F.col("id") % 5).alias("cluster")), tags)


SECONDS = (
    PAIRS
    + """
sec AS (SELECT doc_id AS id, t, [unicode(x) FOR x IN string_split(rpad(substr(text, 64 * t + 1, 72), 72, ' '), '')] AS c FROM (SELECT doc_id, text, unnest(range(0, greatest(1, length(text) // 64))) AS t FROM documents WHERE doc_id IN (SELECT a FROM pairs UNION SELECT b FROM pairs))),
secs AS MATERIALIZED (SELECT id, t, """
    + X._sql_hash("((q // 8) * 9 + q % 8)", "((q // 8) * 9 + q % 8 + 1)")
    + """ AS h FROM sec),
best AS MATERIALIZED (SELECT a, b, t1, t2, 1 - d / 64.0::DOUBLE AS sim FROM (SELECT p.a, p.b, x.t AS t1, y.t AS t2, bit_count(xor(x.h, y.h)) AS d, row_number() OVER (PARTITION BY p.a, p.b, x.t ORDER BY bit_count(xor(x.h, y.h)), y.t) AS k FROM pairs p JOIN secs x ON x.id = p.a JOIN secs y ON y.id = p.b) WHERE k = 1),
"""
)


def samples(spark, sf_dir, pairs):
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    d = X.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
    return d.select("id", F.posexplode(X.second_hashes(F.col("text"), "phash")).alias("t", "h")).select("id", F.col("t").cast("long").alias("t"), "h")


def sampled(spark, sf_dir):
    """Pairs, and the seconds of their items."""
    from mediasift.sources.shared import stored

    pairs = q_pairs.pairs(spark, sf_dir).select("a", "b")
    return pairs, stored(samples(spark, sf_dir, pairs), "seconds")


@query("c14_second_hashes", "SELECT id, t, h FROM secs", SECONDS)
def _(spark, sf_dir):
    return samples(spark, sf_dir, q_pairs.pairs(spark, sf_dir))


@query("d19_best_matches", "SELECT a, b, t1, t2, sim FROM best", SECONDS)
def _(spark, sf_dir):
    return G.best_matches(*sampled(spark, sf_dir))


@query("f2_similar_intervals", "SELECT a, b, min(t1) AS start_t1, max(t1) AS end_t1, arg_min(t2, t1) AS start_t2, arg_max(t2, t1) AS end_t2, min(sim) AS min_sim, max(sim) AS max_sim, count(*) AS n FROM (SELECT *, sum((sim < 0.85::DOUBLE)::INT) OVER (PARTITION BY a, b ORDER BY t1) AS island FROM best) WHERE sim >= 0.85::DOUBLE GROUP BY a, b, island", SECONDS)
def _(spark, sf_dir):
    return G.intervals(*sampled(spark, sf_dir), 0.85)


EV = "ev AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before, count(*) OVER (PARTITION BY user_id) AS total FROM events),"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("c6_audio_chunks", "SELECT user_id, CAST(least(4, pos // greatest(1, total // 5)) AS BIGINT) AS chunk, CAST(floor(avg(abs(CAST(trunc(value * 100) AS BIGINT)))) AS BIGINT) AS h FROM ev WHERE total >= 5 GROUP BY ALL", EV)
def _(spark, sf_dir):
    from mediasift.operators.frames import audio_chunks

    rows = events(spark, sf_dir).selectExpr("user_id as id", "row_number() over (partition by user_id order by ts, event_id) - 1 as pos", "cast(value * 100 as bigint) as sample")
    return audio_chunks(rows, 5, 5).select(F.col("id").alias("user_id"), "chunk", "h")


@query("f1_motion", "SELECT user_id, round(avg(m), 6) AS motion_mean, round(coalesce(CASE WHEN count(*) > 1 THEN stddev_pop(m) END, 0), 6) AS motion_std FROM (SELECT user_id, event_type, avg(abs(value - before)) AS m FROM ev WHERE before IS NOT NULL GROUP BY ALL) GROUP BY user_id", EV)
def _(spark, sf_dir):
    from mediasift.operators.frames import scalar_motion

    rows = events(spark, sf_dir).selectExpr("user_id as id", "event_type as burst", "struct(ts, event_id) as at", "value")
    out = scalar_motion(rows)
    return out.select(F.col("id").alias("user_id"), F.round("motion_mean", 6).alias("motion_mean"), F.round("motion_std", 6).alias("motion_std"))
