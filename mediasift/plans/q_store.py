"""Registered queries: signature store, differences between scans, reports, cleanup tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.operators import cleanup as K
from mediasift.operators import groups as G
from mediasift.operators import reports as R
from mediasift.operators import store as T
from mediasift.plans import fixtures as X
from mediasift.plans import q_pairs
from mediasift.plans.q_pairs import GROUPS, MARKED
from mediasift.plans.registry import query

NOW = 1.7e9 + 30 * 86400 + 2500


def old(spark, sf_dir):
    return X.store(spark, sf_dir, new=False)


def new(spark, sf_dir):
    return X.store(spark, sf_dir, new=True)


VALID = "coalesce(n.size = o.size AND abs(n.mtime - o.mtime) < 1, false)"


@query("a7_entry_validity", f"SELECT n.id, {VALID} AS valid FROM store_new n LEFT JOIN store_old o USING (path)")
def _(spark, sf_dir):
    return T.validity(new(spark, sf_dir).select("id", "path", "size", "mtime"), old(spark, sf_dir)).select("id", "valid")


@query("a8_incremental_work", f"SELECT n.id FROM store_new n LEFT JOIN store_old o USING (path) WHERE NOT {VALID}")
def _(spark, sf_dir):
    return T.to_compute(new(spark, sf_dir).select("id", "path", "size", "mtime"), old(spark, sf_dir)).select("id")


@query("a9_drop_invalid", f"SELECT o.id FROM store_old o JOIN store_new n USING (path) WHERE {VALID}")
def _(spark, sf_dir):
    return T.without_invalid(old(spark, sf_dir), new(spark, sf_dir)).select("id")


@query("a10_drop_expired", f"SELECT o.id FROM store_old o JOIN store_new n USING (path) WHERE n.mtime >= {NOW} - 30 * 86400")
def _(spark, sf_dir):
    return T.without_expired(old(spark, sf_dir), new(spark, sf_dir), NOW, 30).select("id")


@query("a11_merge_stores", "SELECT id, size, purpose FROM store_old UNION ALL SELECT id, size, purpose FROM store_new WHERE path NOT IN (SELECT path FROM store_old)")
def _(spark, sf_dir):
    return T.merged([old(spark, sf_dir), new(spark, sf_dir)]).select("id", "size", "purpose")


@query("a5_legacy_store", "SELECT path, size, mtime, phash, dhash, audio, duration, width, height FROM store_old")
def _(spark, sf_dir):
    """The older store as JSON parts, read back."""
    from uuid import uuid4

    from mediasift.sources import media
    from mediasift.sources.shared import shared_dir

    path = f"{shared_dir(spark)}/json-{uuid4().hex}"
    media.write_legacy_store(old(spark, sf_dir), path)
    return media.legacy_store(spark, path).select("path", "size", "mtime", "phash", "dhash", "audio", "duration", "width", "height")


@query("a6_store_in_place", f"SELECT o.id, o.path, o.size, o.purpose, o.phash FROM store_old o JOIN store_new n USING (path) WHERE {VALID} UNION ALL SELECT id, path, size, purpose, phash FROM store_new WHERE path NOT IN (SELECT path FROM store_old)")
def _(spark, sf_dir):
    """A store that is written, rid of invalid entries where it lies, and merged with a newer one, again where it lies."""
    from uuid import uuid4

    from mediasift.sources.shared import shared_dir

    path = f"{shared_dir(spark)}/store-{uuid4().hex}"
    T.save(old(spark, sf_dir), path)
    T.save(T.without_invalid(T.load(spark, path), new(spark, sf_dir)), path)
    fresh = new(spark, sf_dir).join(old(spark, sf_dir).select("path").hint("merge"), "path", "left_anti")
    T.save(T.merged([T.load(spark, path), fresh]), path)
    return T.load(spark, path).select("id", "path", "size", "purpose", "phash")


LOST = " + ".join(f"(o.{c} IS NOT NULL)::INT" for c in T.SEMANTIC)


@query("a9_invalid_counts", f"SELECT count(*) FILTER (NOT {VALID}) AS removed, count(*) FILTER ({VALID}) AS kept, CAST(coalesce(sum(CASE WHEN NOT {VALID} THEN {LOST} END), 0) AS BIGINT) AS lost_fields FROM store_old o LEFT JOIN store_new n USING (path)")
def _(spark, sf_dir):
    return T.invalid_counts(old(spark, sf_dir), new(spark, sf_dir))


@query("a11_merge_counts", "SELECT store, added, CAST(sum(added) OVER () AS BIGINT) AS total FROM (SELECT 0 AS store, count(*) AS added FROM store_old UNION ALL SELECT 1, count(*) FROM store_new WHERE path NOT IN (SELECT path FROM store_old))")
def _(spark, sf_dir):
    return T.merge_counts([old(spark, sf_dir), new(spark, sf_dir)])


@query("a12_clear_semantic", "SELECT count(*) AS entries, count(purpose) AS cleared, count(*) FILTER (len(phash) > 0) AS hashed FROM store_old")
def _(spark, sf_dir):
    s = old(spark, sf_dir)
    kept = T.cleared(s).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.size("phash") > 0).alias("hashed"), F.count("purpose").alias("left"))
    return s.agg(F.count("purpose").alias("cleared")).crossJoin(kept).select("entries", (F.col("cleared") - F.col("left")).alias("cleared"), "hashed")


HEX = "array_to_string([printf('%016x', x) FOR x IN {}], ',')"


@query("a13_hash_backup", f"SELECT path, name, size, {HEX.format('phash')} AS phash, {HEX.format('dhash')} AS dhash FROM store_old")
def _(spark, sf_dir):
    return T.hash_backup(old(spark, sf_dir)).select("path", "name", "size", "phash", "dhash")


@query("a16_pair_export", "SELECT m.path AS path_a, n.path AS path_b, round(1 - similarity, 6) AS distance, similarity >= 0.85::DOUBLE AS duplicate FROM pairs JOIN media_file m ON m.id = a JOIN media_file n ON n.id = b", GROUPS)
def _(spark, sf_dir):
    names = X.media_file(spark, sf_dir).select("id", "path")
    p = q_pairs.pairs(spark, sf_dir)
    p = p.join(names.selectExpr("id as a", "path as path_a").hint("merge"), "a").join(names.selectExpr("id as b", "path as path_b").hint("merge"), "b")
    return p.select("path_a", "path_b", F.round("distance", 6).alias("distance"), (F.col("similarity") >= 0.85).alias("duplicate"))


@query("a17_group_report", "SELECT group_id, path, CASE WHEN retained THEN 'keep' ELSE 'clean' END AS mark, size FROM marked", MARKED)
def _(spark, sf_dir):
    return q_pairs.marked(spark, sf_dir).select("group_id", "path", F.when(F.col("retained"), "keep").otherwise("clean").alias("mark"), "size")


@query("a18_clean_list", "SELECT path FROM marked WHERE NOT retained", MARKED)
def _(spark, sf_dir):
    return q_pairs.marked(spark, sf_dir).where("not retained").select("path")


BAD = "CASE WHEN id % 31 = 0 THEN 'zero_frames' WHEN id % 41 = 0 THEN 'decode_error' END"


@query("a19_bad_media", f"SELECT error_type, count(*) AS n FROM (SELECT {BAD} AS error_type FROM media_file) WHERE error_type IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    kinds = F.when(F.col("id") % 31 == 0, "zero_frames").when(F.col("id") % 41 == 0, "decode_error")
    return R.bad_media(X.media_file(spark, sf_dir).withColumn("error_type", kinds))


@query("a23_tags", "SELECT id, CASE WHEN id % 3 = 0 THEN source ELSE lang || '|' || source END AS tags FROM media_file")
def _(spark, sf_dir):
    from mediasift.operators import review

    m = X.media_file(spark, sf_dir)
    tags = review.add_tags(m.select("id", F.col("lang").alias("tag")), m.select("id", F.col("source").alias("tag")))
    return review.tag_lists(review.remove_tags(tags, m.where("id % 3 = 0").select("id", F.col("lang").alias("tag"))))


@query("b18_backup_manifest", "SELECT id, '/backup/' || group_id || '/' || name AS target FROM marked WHERE NOT retained", MARKED)
def _(spark, sf_dir):
    from mediasift.operators.catalog import target_manifest

    gone = q_pairs.marked(spark, sf_dir).where("not retained").dropDuplicates(["path"])
    return target_manifest(gone, "/backup", F.col("group_id").cast("string")).select("id", "target")


@query("b19_link_manifest", "SELECT m.path AS source, r.path AS target FROM marked m JOIN marked r USING (group_id) WHERE r.retained AND NOT m.retained AND m.path <> r.path", MARKED)
def _(spark, sf_dir):
    return K.links(q_pairs.marked(spark, sf_dir))


@query("e9_scan_summary", "SELECT (SELECT count(*) FROM media_file) AS files, (SELECT count(DISTINCT group_id) FROM members) AS groups, (SELECT count(*) FROM marked WHERE NOT retained) AS redundant, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM marked WHERE NOT retained) AS reclaimable_bytes, CASE WHEN (SELECT count(*) FROM members) > 0 THEN 1 ELSE 0 END AS exit_code", MARKED)
def _(spark, sf_dir):
    return R.scan_summary(X.media_file(spark, sf_dir), q_pairs.marked(spark, sf_dir))


@query("e9_quality_levels", "SELECT level, count(s) AS n FROM (SELECT unnest(['exact_or_reencoded', 'highly_similar', 'possibly_similar', 'weak_match']) AS level) LEFT JOIN (SELECT s, CASE WHEN s >= 0.98 THEN 'exact_or_reencoded' WHEN s >= 0.85 THEN 'highly_similar' WHEN s >= 0.70 THEN 'possibly_similar' ELSE 'weak_match' END AS level FROM (SELECT coalesce(max(similarity), 1.0::DOUBLE) AS s FROM members m LEFT JOIN links ON links.a = m.id GROUP BY group_id)) USING (level) GROUP BY level", GROUPS)
def _(spark, sf_dir):
    edges = q_pairs.links(spark, sf_dir)
    return R.level_counts(G.group_similarity(edges, G.group_members(edges)))


@query("e10_totals", "SELECT purpose, count(*) AS n, count(*) FILTER (semantic_conf >= 0.25 AND quality_score >= 0.4) AS ready FROM store_new GROUP BY purpose")
def _(spark, sf_dir):
    return R.totals(new(spark, sf_dir), (F.col("semantic_conf") >= 0.25) & (F.col("quality_score") >= 0.4))


@query("e11_value_distribution", "SELECT v AS value, count(*) AS n FROM (SELECT unnest([scene, object, action]) AS v FROM semantic) WHERE trim(v) <> '' GROUP BY v")
def _(spark, sf_dir):
    return R.distribution(X.semantic(spark, sf_dir), F.array("scene", "object", "action"))


FULL = "SELECT count(*) AS items, count(*) FILTER (action IS NOT NULL) AS tagged, count(*) FILTER (quality_score >= 0.6) AS ready, count(*) FILTER (quality_score < 0.5) AS low_quality FROM semantic"


@query("e12_full_report", FULL)
def _(spark, sf_dir):
    return R.full_report(X.semantic(spark, sf_dir))


@query("e13_quality_report", "SELECT round(100.0::DOUBLE * ready / n, 6) AS ready_rate, CASE WHEN 100.0 * ready / n >= 80 THEN 'good' WHEN 100.0 * ready / n >= 60 THEN 'fair' ELSE 'poor' END AS grade, round(balance, 6) AS balance, round(top, 6) AS max_share FROM (SELECT count(*) AS n, count(*) FILTER (quality_score >= 0.6) AS ready FROM store_new), (SELECT 1 - sum(abs(p - 1.0::DOUBLE / k)) / 2 AS balance, max(p) AS top FROM (SELECT count(*) / (sum(count(*)) OVER ())::DOUBLE AS p, count(*) OVER () AS k FROM store_new GROUP BY purpose))")
def _(spark, sf_dir):
    return R.quality_report(new(spark, sf_dir))


@query("e23_dataset_stats", "SELECT count(*) AS n, round(avg(quality_score), 6) AS quality, round(avg(semantic_conf), 6) AS confidence, round(100.0::DOUBLE * count(*) FILTER (quality_score >= 0.6) / count(*), 6) AS ready_percent FROM store_new")
def _(spark, sf_dir):
    return R.dataset_stats(new(spark, sf_dir))


@query("e25_store_health", "SELECT count(*) AS entries, round(100.0::DOUBLE * count(*) FILTER (len(phash) > 0) / count(*), 6) AS hash, round(100.0::DOUBLE * count(*) FILTER (duration > 0) / count(*), 6) AS duration, round(100.0::DOUBLE * count(audio) / count(*), 6) AS audio, count(*) FILTER (coalesce(len(phash), 0) = 0) AS corrupted, count(purpose) AS classified FROM store_new")
def _(spark, sf_dir):
    return T.health(new(spark, sf_dir))


@query("e26_score_counters", "SELECT count(*) FILTER (q >= 0.7) AS good, count(*) FILTER (q < 0.4) AS poor, round(100.0::DOUBLE * count(q) / count(*), 6) AS scored_percent FROM (SELECT CASE WHEN id % 9 <> 0 THEN quality_score END AS q FROM semantic)")
def _(spark, sf_dir):
    return R.score_counters(X.semantic(spark, sf_dir), F.when(F.col("id") % 9 != 0, F.col("quality_score")))


@query("e31_root_statistics", "SELECT source AS root, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM media_file GROUP BY source")
def _(spark, sf_dir):
    return X.media_file(spark, sf_dir).groupBy(F.col("source").alias("root")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("g1_worst_quality", "SELECT id, quality_score FROM semantic ORDER BY quality_score, id LIMIT 15")
def _(spark, sf_dir):
    return X.semantic(spark, sf_dir).select("id", "quality_score").orderBy("quality_score", "id").limit(15)


@query("h1_added_paths", "SELECT path FROM store_new EXCEPT SELECT path FROM store_old")
def _(spark, sf_dir):
    return T.added(new(spark, sf_dir), old(spark, sf_dir))


@query("h2_removed_paths", "SELECT path FROM store_old EXCEPT SELECT path FROM store_new")
def _(spark, sf_dir):
    return T.added(old(spark, sf_dir), new(spark, sf_dir))


@query("h3_changed_semantic", "SELECT path FROM store_new n JOIN store_old o USING (path) WHERE n.scene IS DISTINCT FROM o.scene OR n.purpose IS DISTINCT FROM o.purpose")
def _(spark, sf_dir):
    return T.changed_semantic(new(spark, sf_dir), old(spark, sf_dir))


SETS = "(SELECT array_to_string(phash, '|') AS signature, count(*) AS n FROM {} GROUP BY phash HAVING count(*) > 1)"


@query("h4_new_hash_groups", f"SELECT * FROM {SETS.format('store_new')} WHERE signature NOT IN (SELECT signature FROM {SETS.format('store_old')})")
def _(spark, sf_dir):
    return T.new_hash_groups(new(spark, sf_dir), old(spark, sf_dir))


@query("h5_changed_physical", "SELECT path FROM store_new n JOIN store_old o USING (path) WHERE n.size <> o.size OR abs(n.mtime - o.mtime) >= 1")
def _(spark, sf_dir):
    return T.changed_physical(new(spark, sf_dir), old(spark, sf_dir))


OLD_GROUPS = GROUPS + "og AS (SELECT id, group_id FROM members WHERE id % 7 <> 0), held AS (SELECT m.group_id, og.group_id AS o, count(*) AS k FROM members m JOIN og USING (id) GROUP BY ALL), sz AS (SELECT group_id, count(*) AS n FROM members GROUP BY group_id),"


@query("h6_new_group_sets", "SELECT group_id FROM sz WHERE group_id NOT IN (SELECT group_id FROM held JOIN sz USING (group_id) WHERE k = n)", OLD_GROUPS)
def _(spark, sf_dir):
    from mediasift.sources.shared import stored

    now = stored(G.group_members(q_pairs.links(spark, sf_dir)), "members")
    return T.new_group_sets(now, now.where("id % 7 <> 0"))


PLAN = MARKED + "plan AS (SELECT * FROM marked WHERE NOT retained AND NOT starts_with(lower(path), '/src3/')), cat AS (SELECT path, CASE WHEN id % 37 = 0 THEN size + 1 ELSE size END AS size, mtime FROM media_file WHERE id % 31 <> 0), val AS (SELECT p.*, CASE WHEN c.size IS NULL THEN 'missing' WHEN c.size = p.size AND abs(c.mtime - p.mtime) < 1 THEN 'ready' ELSE 'changed' END AS status FROM plan p LEFT JOIN cat c USING (path)),"


def _plan(spark, sf_dir):
    return K.plan(q_pairs.marked(spark, sf_dir), spark.createDataFrame([("/src3",)], "folder string"))


def _catalog(spark, sf_dir):
    m = X.media_file(spark, sf_dir).where("id % 31 <> 0")
    return m.withColumn("size", F.when(F.col("id") % 37 == 0, F.col("size") + 1).otherwise(F.col("size")))


@query("i1_cleanup_plan", "SELECT group_id, path, size, 'move' AS action FROM plan", PLAN)
def _(spark, sf_dir):
    return _plan(spark, sf_dir).select("group_id", "path", "size", "action")


@query("i2_validate_plan", "SELECT status, count(*) AS n FROM val GROUP BY status", PLAN)
def _(spark, sf_dir):
    return K.validated(_plan(spark, sf_dir), _catalog(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


LEDGER = PLAN + "ledger AS (SELECT id, path, size, 'op' || group_id % 4 AS operation_id, 1700000000.0::DOUBLE + group_id % 60 * 86400 AS created_at, 'trash/op/' || printf('%05d', row_number() OVER (ORDER BY group_id, id) - 1) || '_' || name AS target FROM val WHERE status = 'ready'),"


def _ledger(spark, sf_dir):
    ready = K.execution(K.validated(_plan(spark, sf_dir), _catalog(spark, sf_dir)), "op")
    return ready.withColumn("operation_id", F.concat(F.lit("op"), (F.col("group_id") % 4).cast("string"))).withColumn("created_at", F.lit(1.7e9) + F.col("group_id") % 60 * 86400)


@query("i3_execution_preview", "SELECT path, target FROM ledger", LEDGER)
def _(spark, sf_dir):
    return _ledger(spark, sf_dir).select("path", "target")


@query("i4_restore_eligibility", "SELECT id, CASE WHEN id % 41 <> 0 AND id % 43 <> 0 THEN 'ready' ELSE 'conflict' END AS restore FROM ledger", LEDGER)
def _(spark, sf_dir):
    digests = X.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    ledger = _ledger(spark, sf_dir).join(digests.hint("merge"), "id").withColumnRenamed("path", "source")
    moved = ledger.select(F.col("target").alias("path"), "size", F.when(F.col("id") % 41 == 0, "tampered").otherwise(F.col("sha256")).alias("sha256"))
    back = ledger.where("id % 43 = 0").select(F.col("source").alias("path"), "size", "sha256")
    return K.restorable(ledger, moved.unionByName(back)).select("id", "restore")


@query("i5_operations", "SELECT operation_id, max(created_at) AS created_at, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM ledger GROUP BY operation_id", LEDGER)
def _(spark, sf_dir):
    return K.operations(_ledger(spark, sf_dir))


@query("i6_purge_candidates", "SELECT * FROM (SELECT operation_id, max(created_at) AS created_at, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes FROM ledger GROUP BY operation_id) WHERE created_at < 1700000000 + 58 * 86400", LEDGER)
def _(spark, sf_dir):
    return K.purgeable(_ledger(spark, sf_dir), 1.7e9 + 88 * 86400, 30)


@query("i7_audit", "SELECT group_id, CASE WHEN retained THEN 'retained' ELSE 'cleaned' END AS status, 'p' || id % 4 AS purpose, path FROM marked", MARKED)
def _(spark, sf_dir):
    return K.audit(q_pairs.marked(spark, sf_dir), F.concat(F.lit("p"), (F.col("id") % 4).cast("string"))).select("group_id", "status", "purpose", "path")


@query("c11_fingerprints", "SELECT doc_id AS id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    return X.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))
