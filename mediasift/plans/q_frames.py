"""Registered queries over pixels: runs of 72 characters of the documents as 8 x 9 grays. Not for SQL; see the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.functions.samplers import check_places
from mediasift.operators import frames as P
from mediasift.plans import fixtures as X
from mediasift.plans import pipelines
from mediasift.plans.q_labels import LABELS, SUSPECTED, THRESHOLD
from mediasift.plans.q_pairs import groups_sql, kept
from mediasift.plans.registry import query
from mediasift.sources.shared import stored


def pixels(spark, sf_dir):
    f = X.frames(spark, sf_dir)
    gray = F.unhex(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c % 256), 2, "0")), ""))
    return f.select(F.col("doc_id").alias("id"), F.lit(0).alias("burst"), F.col("i").alias("frame_no"), F.lit(8).alias("h"), F.lit(9).alias("w"), gray.alias("pixels"))


@query("c2_check_sampler", "SELECT id, k AS i, greatest(0, len // 2 - 12) + 4 * k AS place FROM (SELECT doc_id AS id, length(text) AS len, unnest(range(0, 5)) AS k FROM documents) WHERE greatest(0, len // 2 - 12) + 4 * k < len")
def _(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    places = check_places(F.length("text"), F.lit(24.0), F.lit(10.0))
    return d.select(F.col("doc_id").alias("id"), F.posexplode(places).alias("i", "place")).select("id", F.col("i").cast("long").alias("i"), F.col("place").cast("long").alias("place"))


@query("c3_pixel_hashes")
def _(spark, sf_dir):
    return P.hashed(pixels(spark, sf_dir)).select("id", "frame_no", "phash", "dhash")


@query("c5_keyframes")
def _(spark, sf_dir):
    return P.keyframes(pixels(spark, sf_dir))


@query("c7_motion")
def _(spark, sf_dir):
    return P.motion(pixels(spark, sf_dir)).select("id", F.round("motion_mean", 6).alias("motion_mean"), F.round("motion_std", 6).alias("motion_std"))


@query("c8_foreground")
def _(spark, sf_dir):
    f = P.foreground(pixels(spark, sf_dir))
    return f.select("id", F.array_join(F.col("fg_phash").cast("array<string>"), ",").alias("fg_phash"), F.round("motion_ratio", 6).alias("motion_ratio"), ((F.size("fg_phash") >= 3) & (F.col("motion_ratio") < 0.015)).alias("static_camera"))


@query("c10_frame_quality")
def _(spark, sf_dir):
    return P.frame_quality(pixels(spark, sf_dir))


@query("a25_dataset_catalog", "SELECT id, round(size / 1048576.0::DOUBLE, 2) AS mb, purpose, coalesce(scene, '-') AS scene, quality_score >= 0.6 AS ready FROM store_new")
def _(spark, sf_dir):
    s = X.store(spark, sf_dir, new=True)
    return s.select("id", F.round(F.col("size") / 1048576.0, 2).alias("mb"), "purpose", F.coalesce("scene", F.lit("-")).alias("scene"), (F.col("quality_score") >= 0.6).alias("ready"))


@query("b28_label_fallback", "SELECT id, CASE WHEN id % 2 = 0 THEN source ELSE lang END AS label FROM media_file")
def _(spark, sf_dir):
    from mediasift.operators.catalog import label_of

    m = X.media_file(spark, sf_dir).withColumn("path", F.when(F.col("id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("/"), "name")))
    return m.select("id", F.coalesce(label_of("folder"), label_of("prefix")).alias("label"))


FRESH = "NOT coalesce(n.size = o.size AND abs(n.mtime - o.mtime) < 1, false)"


@query("l1_dedup_scan", f"SELECT m.group_id, m.id, m.retained, {FRESH} AS computed FROM marked m JOIN store_new n USING (id) LEFT JOIN store_old o ON o.path = n.path", kept("size", groups_sql("store_new", "store_new")))
def _(spark, sf_dir):
    """Members of the groups after a scan, and whether their signature had to be worked out."""
    new, old = stored(X.store(spark, sf_dir, new=True), "new"), stored(X.store(spark, sf_dir, new=False), "old")
    out = pipelines.dedup_scan(new.select("id", "path", "size", "mtime"), old, lambda files: new.join(files.select("path").hint("merge"), "path", "left_semi"))
    fresh = pipelines.T.to_compute(new.select("id", "path", "size", "mtime"), old).select("id", F.lit(True).alias("computed"))
    return out["members"].join(fresh.hint("merge"), "id", "left").select("group_id", "id", "retained", F.coalesce("computed", F.lit(False)).alias("computed"))


@query("l1_scan_summary", "SELECT (SELECT count(*) FROM store_new) AS files, (SELECT count(DISTINCT group_id) FROM members) AS groups, (SELECT count(*) FROM marked WHERE NOT retained) AS redundant, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM marked WHERE NOT retained) AS reclaimable_bytes, CASE WHEN (SELECT count(*) FROM members) > 0 THEN 1 ELSE 0 END AS exit_code", kept("size", groups_sql("store_new", "store_new")))
def _(spark, sf_dir):
    new, old = stored(X.store(spark, sf_dir, new=True), "new"), stored(X.store(spark, sf_dir, new=False), "old")
    return pipelines.dedup_scan(new.select("id", "path", "size", "mtime"), old, lambda files: new.join(files.select("path").hint("merge"), "path", "left_semi"))["summary"]


@query("l2_groups_from_store", "SELECT group_id, id, retained, row_number() OVER (PARTITION BY group_id ORDER BY retained DESC, size DESC, id) AS rank FROM marked", kept("size", groups_sql("store_new", "store_new", 0.85)))
def _(spark, sf_dir):
    return pipelines.groups_from_store(stored(X.store(spark, sf_dir, new=True), "new"))["members"].select("group_id", "id", "retained", "rank")


@query("l3_verify_labels", SUSPECTED, LABELS)
def _(spark, sf_dir):
    return pipelines.verify_labels(stored(X.label_signature(spark, sf_dir), "label-signature"), THRESHOLD)["suspects"].withColumn("score", F.round("score", 6))


@query("l4_auto_classify")
def _(spark, sf_dir):
    s = X.semantic(spark, sf_dir)
    files = X.label_signature(spark, sf_dir).select("id", F.concat(F.lit("file_"), "id", F.lit(".mp4")).alias("name"), "emb")
    tags = s.select("id", F.explode(F.create_map(F.lit("scene"), "scene", F.lit("object"), "object")).alias("kind", "label")).where("label is not null")
    return pipelines.auto_classify(files, tags, "/out", k=8)
