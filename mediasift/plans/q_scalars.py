"""Registered queries: projections, filters and scalar rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediasift.functions import scalars as S
from mediasift.operators import catalog as C
from mediasift.plans import fixtures as X
from mediasift.plans.registry import query

FILES = "SELECT * FROM media_file JOIN (SELECT id, duration, width, height, fps FROM signature) USING (id)"


def files(spark, sf_dir):
    return X.media_file(spark, sf_dir).join(X.signature(spark, sf_dir).select("id", "duration", "width", "height", "fps").hint("merge"), "id")


RULES = ("/src3/*", "*_1?.mp4", "# a comment", "/src1*/fr_*")


@query("a3_ignore_rules", "SELECT id FROM media_file WHERE NOT (path GLOB '/src3/*' OR name GLOB '/src3/*' OR path GLOB '*_1?.mp4' OR name GLOB '*_1?.mp4' OR path GLOB '/src1*/fr_*' OR name GLOB '/src1*/fr_*')")
def _(spark, sf_dir):
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    return C.without_ignored(X.media_file(spark, sf_dir), rules).select("id")


@query("a4_size_literals", "SELECT id, size AS bytes FROM media_file")
def _(spark, sf_dir):
    m = X.media_file(spark, sf_dir)
    return m.select("id", S.parse_size(F.concat((F.col("size") / 1024).cast("long").cast("string"), F.lit("KB"))).alias("bytes"))


@query("a21_metadata_table", f"SELECT id, duration, fps, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height, CASE WHEN duration > 0 THEN CAST(floor(size * 8 / duration / 1000) AS BIGINT) ELSE 0 END AS kbps, printf('%02d:%02d:%02d', CAST(floor(duration) AS BIGINT) // 3600, CAST(floor(duration) AS BIGINT) % 3600 // 60, CAST(floor(duration) AS BIGINT) % 60) AS length FROM ({FILES})")
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("id", "duration", "fps", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.when(F.col("duration") > 0, F.floor(F.col("size") * 8 / F.col("duration") / 1000)).otherwise(0).alias("kbps"), S.format_duration(F.col("duration")).alias("length"))


@query("b1_duration_rule", "SELECT id, duration FROM signature WHERE duration > 120 AND duration <= 3600 AND abs(duration - 500) > 0.01::DOUBLE")
def _(spark, sf_dir):
    s = X.signature(spark, sf_dir)
    return s.where(S.duration_filter(">120&<=3600&!=500&nonsense", F.col("duration"))).select("id", "duration")


@query("b2_duration_and_width", "SELECT count(*) AS total, count(*) FILTER (NOT (duration >= 600)) AS removed_by_duration, count(*) FILTER (duration >= 600 AND NOT (width >= 1280)) AS removed_by_width, count(*) FILTER (duration >= 600 AND width >= 1280) AS kept FROM signature")
def _(spark, sf_dir):
    return C.filter_report(X.signature(spark, sf_dir), ">=600", 1280)


@query("b3_skip_low_quality", "SELECT id, quality_score FROM semantic WHERE coalesce(CASE WHEN id % 9 <> 0 THEN quality_score END, 1.0) >= 0.3")
def _(spark, sf_dir):
    s = X.semantic(spark, sf_dir)
    return s.where(F.coalesce(F.when(F.col("id") % 9 != 0, F.col("quality_score")), F.lit(1.0)) >= 0.3).select("id", "quality_score")


@query("b4_purpose_filter", "SELECT id, purpose FROM store_new WHERE purpose IN ('p1', 'p3')")
def _(spark, sf_dir):
    return X.store(spark, sf_dir, new=True).where(F.col("purpose").isin("p1", "p3")).select("id", "purpose")


@query("b5_duration_statistics", "SELECT count(*) AS total, count(*) FILTER (duration >= 1000) AS matched, round(100.0::DOUBLE * count(*) FILTER (duration >= 1000) / count(*), 6) AS percent, sum(duration) AS seconds, coalesce(sum(duration) FILTER (duration >= 1000), 0) AS matched_seconds FROM signature")
def _(spark, sf_dir):
    return C.duration_statistics(X.signature(spark, sf_dir), ">=1000")


@query("b6_path_search", "SELECT id FROM media_file WHERE contains(lower(path), 'src1/en_')")
def _(spark, sf_dir):
    return X.media_file(spark, sf_dir).where(F.contains(F.lower("path"), F.lower(F.trim(F.lit("  SRC1/en_ "))))).select("id")


@query("b7_range_filter", "SELECT id FROM signature WHERE duration BETWEEN 500 AND 3000 AND least(width, height) BETWEEN 480 AND 1080")
def _(spark, sf_dir):
    return X.signature(spark, sf_dir).where(F.col("duration").between(500, 3000) & F.least("width", "height").between(480, 1080)).select("id")


PART = "string_split(path, '/')"


@query("b8_mask_path", f"SELECT id, CASE WHEN len({PART}) <= 4 THEN path ELSE {PART}[1] || '//.../' || {PART}[-2] || '/' || {PART}[-1] END AS masked FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'home/media' || path ELSE path END AS path FROM media_file)")
def _(spark, sf_dir):
    p = F.when(F.col("id") % 2 == 0, F.concat(F.lit("home/media"), "path")).otherwise(F.col("path"))
    return X.media_file(spark, sf_dir).select("id", S.mask_path(p).alias("masked"))


@query("b9_mask_path_ends", "SELECT id, CASE WHEN id % 2 = 0 THEN 'c:\\...\\' || name ELSE source || '/' || name END AS masked FROM media_file")
def _(spark, sf_dir):
    p = F.when(F.col("id") % 2 == 0, F.concat(F.lit("\\\\?\\c:\\media"), F.replace("path", F.lit("/"), F.lit("\\")))).otherwise(F.concat_ws("/", "source", "name"))
    return X.media_file(spark, sf_dir).select("id", S.mask_path_ends(p).alias("masked"))


@query("b10_protected_paths", "SELECT id FROM media_file WHERE NOT (lower(path) = '/src3' OR starts_with(lower(path), '/src3/') OR starts_with(lower(path), '/src7/'))")
def _(spark, sf_dir):
    folders = spark.createDataFrame([("/SRC3",), ("/src7/",)], "folder string")
    return C.without_protected(X.media_file(spark, sf_dir), folders).select("id")


@query("b11_size_text", "SELECT id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.2f KB', size / 1024) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576) ELSE printf('%.2f GB', size / 1073741824) END AS text FROM (SELECT id, size // (1 + id % 2 * 99999) AS size FROM media_file)")
def _(spark, sf_dir):
    return X.media_file(spark, sf_dir).select("id", S.format_size(F.expr("size div (1 + id % 2 * 99999)")).alias("text"))


BUCKET = "CASE WHEN duration <= 0 THEN 'unknown' WHEN duration < 30 THEN '<30s' WHEN duration < 60 THEN '30-60s' WHEN duration < 180 THEN '1-3min' WHEN duration < 600 THEN '3-10min' ELSE '>10min' END"
TIER = "CASE WHEN least(width, height) <= 0 THEN 'unknown' WHEN least(width, height) >= 2160 THEN '4K+' WHEN least(width, height) >= 1440 THEN '2K' WHEN least(width, height) >= 1080 THEN '1080p' WHEN least(width, height) >= 720 THEN '720p' ELSE 'SD' END"


@query("b13_duration_buckets", f"SELECT {BUCKET} AS bucket, count(*) AS n FROM signature GROUP BY 1")
def _(spark, sf_dir):
    return X.signature(spark, sf_dir).groupBy(S.duration_bucket(F.col("duration")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("b14_resolution_tiers", f"SELECT {TIER} AS tier, count(*) AS n FROM signature GROUP BY 1")
def _(spark, sf_dir):
    return X.signature(spark, sf_dir).groupBy(S.resolution_tier(F.col("width"), F.col("height")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


BY_DURATION = "CASE WHEN duration <= 0 THEN 'unknown' WHEN duration < 60 THEN '<1min' WHEN duration < 300 THEN '1-5min' WHEN duration < 1800 THEN '5-30min' ELSE '>30min' END"


@query("b15_organise_class", f"SELECT id, {BY_DURATION} AS by_duration, CASE WHEN height <= 0 THEN 'unknown' WHEN height < 720 THEN '<720p' WHEN height < 1080 THEN '720p' WHEN height < 2160 THEN '1080p' ELSE '4K' END AS by_resolution FROM signature")
def _(spark, sf_dir):
    s = X.signature(spark, sf_dir)
    return s.select("id", S.organise_class("duration", F.col("duration"), F.col("height")).alias("by_duration"), S.organise_class("resolution", F.col("duration"), F.col("height")).alias("by_resolution"))


@query("b16_safe_names", "SELECT id, CASE WHEN id % 3 = 0 THEN 'other' ELSE lang || id END AS safe FROM media_file")
def _(spark, sf_dir):
    raw = F.when(F.col("id") % 3 == 0, ' <>:"/\\|?* ').otherwise(F.concat(F.lit(" ?"), "lang", F.lit("|"), F.col("id").cast("string"), F.lit("* ")))
    return X.media_file(spark, sf_dir).select("id", S.safe_dir_name(raw).alias("safe"))


MANIFEST = "SELECT id, dir || '/' || stem || CASE WHEN k > 1 THEN '_dup' || (k - 1) ELSE '' END || '.' || ext AS target FROM (SELECT id, ext, {dir} AS dir, {stem} AS stem, row_number() OVER (PARTITION BY {dir}, {stem}, ext ORDER BY id) AS k FROM ({src}))"


@query("b17_target_manifest", MANIFEST.format(dir=f"'/out/' || CASE WHEN {BY_DURATION} IN ('<1min') THEN '1min' WHEN {BY_DURATION} = '>30min' THEN '30min' ELSE {BY_DURATION} END", stem="lang", src=FILES))
def _(spark, sf_dir):
    f = files(spark, sf_dir)
    category = S.safe_dir_name(S.organise_class("duration", F.col("duration"), F.col("height")))
    return C.target_manifest(f.withColumn("file", F.concat("lang", F.lit("."), "ext")), "/out", category, "file").select("id", "target")


@query("b20_size_buckets", "SELECT CASE WHEN size < 10485760 THEN '<10MB' WHEN size < 104857600 THEN '10-100MB' WHEN size < 1073741824 THEN '100MB-1GB' ELSE '>1GB' END AS bucket, count(*) AS n FROM media_file GROUP BY 1")
def _(spark, sf_dir):
    return X.media_file(spark, sf_dir).groupBy(S.size_bucket(F.col("size")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("b21_quality_buckets", "SELECT CASE WHEN q IS NULL THEN 'unscored' WHEN q < 0.3 THEN '<0.3' WHEN q < 0.5 THEN '0.3-0.5' WHEN q < 0.7 THEN '0.5-0.7' WHEN q < 0.9 THEN '0.7-0.9' ELSE '>=0.9' END AS bucket, count(*) AS n FROM (SELECT CASE WHEN id % 9 <> 0 THEN quality_score END AS q FROM semantic) GROUP BY 1")
def _(spark, sf_dir):
    q = F.when(F.col("id") % 9 != 0, F.col("quality_score"))
    return X.semantic(spark, sf_dir).groupBy(S.quality_bucket(q).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("b23_metadata_quality", f"SELECT id, CASE WHEN px <= 0 AND rate <= 0 THEN 50.0::DOUBLE ELSE round(least(1.0::DOUBLE, px / 2073600.0::DOUBLE) * 65 + least(1.0::DOUBLE, rate / 8388608.0::DOUBLE) * 35, 2) END AS score FROM (SELECT id, CAST(width * height AS DOUBLE) AS px, CASE WHEN duration > 0 THEN size / duration ELSE 0.0::DOUBLE END AS rate FROM ({FILES}))")
def _(spark, sf_dir):
    return files(spark, sf_dir).select("id", S.metadata_quality(F.col("size"), F.col("duration"), F.col("width"), F.col("height")).alias("score"))


@query("b24_bitrate", f"SELECT id, CASE WHEN duration > 0 THEN round(size / duration, 6) ELSE 0.0::DOUBLE END AS bitrate FROM ({FILES})")
def _(spark, sf_dir):
    from mediasift.operators.groups import bitrate

    return files(spark, sf_dir).select("id", F.round(bitrate(F.col("size"), F.col("duration")), 6).alias("bitrate"))


@query("b25_valid_labels", "SELECT id, id % 3 <> 0 AS valid FROM media_file")
def _(spark, sf_dir):
    label = F.when(F.col("id") % 3 == 0, F.lit(" 1 ")).when(F.col("id") % 3 == 1, F.lit("é1")).otherwise(F.col("lang"))
    return X.media_file(spark, sf_dir).select("id", S.valid_label(label).alias("valid"))


@query("b26_label_assignment", "SELECT id, source AS folder, lang AS prefix, regexp_extract(name, '^([a-z]+)_', 1) AS regex FROM media_file")
def _(spark, sf_dir):
    m = X.media_file(spark, sf_dir)
    return m.select("id", C.label_of("folder").alias("folder"), C.label_of("prefix").alias("prefix"), C.label_of("regex", pattern="^([a-z]+)_").alias("regex"))


@query("b27_auto_labels", "SELECT id, source AS label FROM media_file")
def _(spark, sf_dir):
    return C.auto_labels(X.media_file(spark, sf_dir)).select("id", "label")


@query("b29_extensions", "SELECT '.' || ext AS ext, count(*) AS n FROM media_file GROUP BY ext")
def _(spark, sf_dir):
    return X.media_file(spark, sf_dir).groupBy(S.extension(F.col("name")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query("b30_tag_names", "SELECT id, CASE WHEN action IS NULL THEN '-' ELSE scene || ', ' || object END AS names FROM semantic")
def _(spark, sf_dir):
    tag = lambda c: F.struct(F.col(c).alias("label"), F.lit(0.5).alias("score"))
    tags = F.when(F.col("action").isNotNull(), F.array(tag("scene"), tag("object")))
    return X.semantic(spark, sf_dir).select("id", S.tag_names(tags).alias("names"))


@query("b31_behaviour_tokens", "SELECT DISTINCT token FROM (SELECT unnest(string_split(lower(replace(source || '+' || lang || '-pos-daytime', '+', '-')), '-')) AS token FROM media_file) WHERE length(token) >= 3 AND token NOT IN ('pos', 'neg', 'daytime', 'night') AND NOT regexp_full_match(token, '[0-9]+')")
def _(spark, sf_dir):
    m = X.media_file(spark, sf_dir).select(F.concat("source", F.lit("+"), "lang", F.lit("-pos-daytime")).alias("label"))
    return C.behaviour_tokens(m, ("pos", "neg", "daytime", "night"))


@query("b32_negative_marker", "SELECT id, id % 2 = 1 AS negative FROM media_file")
def _(spark, sf_dir):
    label = F.concat("source", F.when(F.col("id") % 2 == 1, "+NEG-night").otherwise("-pos-negative"))
    return X.media_file(spark, sf_dir).select("id", F.array_contains(S.label_tokens(label), "neg").alias("negative"))


@query("e24_directory_usage", "SELECT source AS dir, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM media_file GROUP BY source ORDER BY bytes DESC, dir LIMIT 15")
def _(spark, sf_dir):
    m = X.media_file(spark, sf_dir).groupBy(F.col("source").alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return m.orderBy(F.desc("bytes"), "dir").limit(15)


@query("e24_histograms", "SELECT least(19, CAST(floor((duration - lo) / ((hi - lo) / 20)) AS BIGINT)) AS bin, count(*) AS n FROM signature, (SELECT min(duration) AS lo, max(duration) AS hi FROM signature) GROUP BY 1")
def _(spark, sf_dir):
    return C.histogram(X.signature(spark, sf_dir).select("duration"), "duration", 20)


@query("f4_share_of_total", "SELECT lang, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM media_file GROUP BY lang")
def _(spark, sf_dir):
    g = X.media_file(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
