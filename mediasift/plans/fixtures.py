"""Media tables derived from the given ones, once in Spark and once in DuckDB SQL.

Documents stand for media items: runs of 72 characters are frames, their bits fingerprints, the length a duration.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.samplers import uniform_places
from mediasift.sources.tables import table

FRAME = 72
FRAMES = 4
#: Characters from a second to the next.
SECOND = 64
SHAPES = ((0, 0), (640, 480), (1280, 720), (1920, 1080), (2560, 1440), (3840, 2160))
#: Tags by language and by source, and purposes by keyword.
SCENES = {"en": "indoor", "fr": "street", "de": "factory", "es": "beach"}
OBJECTS = ("person", "car", "dog", "machine")
RULES = (("surveillance", "street"), ("surveillance", "person"), ("surveillance", "car"), ("industrial", "factory"), ("industrial", "machine"), ("leisure", "beach"), ("leisure", "dog"))


def _codes(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda x: F.ascii(x))


#: Frame places whose codes are compared, for each of 64 bits: set if the code at the second is above that at the first.
_AT = np.arange(64) // 8 * 9 + np.arange(64) % 8
LEFT = {"phash": _AT, "dhash": np.arange(64)}
RIGHT = {"phash": _AT + 1, "dhash": np.arange(64) + 8}


def _hashes(frames: list[str], kind: str) -> np.ndarray:
    """64-bit fingerprints of frames of FRAME characters, all at once."""
    return _fingerprints(np.frombuffer("".join(frames).encode("utf-32-le"), np.uint32).reshape(-1, FRAME), kind)


def _fingerprints(codes: np.ndarray, kind: str) -> np.ndarray:
    bits = (codes[:, RIGHT[kind]] > codes[:, LEFT[kind]]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def hash_of(frame: Column, kind: str) -> Column:
    """Fingerprint of a frame (a text of FRAME characters)."""
    return F.pandas_udf(lambda s: pd.Series(_hashes(s.to_list(), kind), index=s.index), "long")(frame)


def hashes_of(frames: Column, kind: str) -> Column:
    """Fingerprints of an array of frames."""

    def run(lists):
        sizes = [len(x) for x in lists]
        parts = np.split(_hashes([f for x in lists for f in x], kind), np.cumsum(sizes)[:-1])
        return pd.Series(parts if len(sizes) else [], index=lists.index, dtype=object)

    return F.pandas_udf(run, "array<long>")(frames)


def second_hashes(text: Column, kind: str) -> Column:
    """Fingerprints of the frames at every 64th character of a text, as :func:`frame_at` cuts them, in one pass over it."""

    def run(texts):
        out = []
        for x in texts:
            n = max(1, len(x) // SECOND)
            codes = np.frombuffer(x[: n * SECOND + FRAME].ljust(n * SECOND + FRAME).encode("utf-32-le"), np.uint32)
            out.append(_fingerprints(np.lib.stride_tricks.sliding_window_view(codes, FRAME)[: n * SECOND : SECOND], kind))
        return pd.Series(out, index=texts.index, dtype=object)

    return F.pandas_udf(run, "array<long>")(text)


def frame_at(text: Column, at: Column) -> Column:
    return F.rpad(F.substr(text, at + 1, F.lit(FRAME)), FRAME, " ")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, frame, codes) of at most four frames of each document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.posexplode(uniform_places(F.length("text"), FRAMES)).alias("i", "at"))
    cut = docs.select("doc_id", "i", frame_at(F.col("text"), F.col("at")).alias("frame"))
    return cut.withColumn("codes", _codes(F.col("frame")))


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, phash, dhash, audio, duration, width, height, fps), arrays in frame order, worked out row by row."""
    docs = documents(spark, sf_dir)
    cut = F.transform(uniform_places(F.length("text"), FRAMES), lambda at: frame_at(F.col("text"), at))
    d = docs.select(F.col("doc_id").alias("id"), "n_chars", cut.alias("frames"))
    d = d.select("id", "n_chars", hashes_of(F.col("frames"), "phash").alias("phash"), hashes_of(F.col("frames"), "dhash").alias("dhash"))
    first = F.get("phash", 0)
    audio = F.when(F.col("id") % 3 == 0, F.array(first)).when(F.col("id") % 3 == 1, F.array(F.bitwise_not(first)))
    shape = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in SHAPES]), (F.col("id") % 6 + 1).cast("int"))
    return d.select("id", "phash", "dhash", audio.alias("audio"), F.when(F.col("id") % 23 == 0, 0.0).otherwise(F.col("n_chars").cast("double")).alias("duration"), shape(0).alias("width"), shape(1).alias("height"), (24 + F.col("id") % 3 * 6).cast("double").alias("fps"))


def media_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, name, ext, size, mtime, source, lang)."""
    ext = F.when(F.col("doc_id") % 5 == 0, "mov").when(F.col("doc_id") % 7 == 0, "mkv").otherwise("mp4")
    name = F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat(F.lit("/"), "source", F.lit("/"), name).alias("path"), name.alias("name"), ext.alias("ext"), (F.col("n_chars") * 1024).alias("size"), (1.7e9 + (F.col("doc_id") * 37) % 5000).alias("mtime"), "source", "lang")


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, quality_score, semantic_conf, scene, object, action): tags as (label, score), action null without a label."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang", "source")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    scene = F.element_at(F.create_map(*[F.lit(x) for kv in SCENES.items() for x in kv]), F.col("lang"))
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 4
    obj = F.element_at(F.array(*map(F.lit, OBJECTS)), number + 1)
    action = F.when(F.col("quality") == 1, "moving").when(F.col("quality") == 0, "static")
    return docs.join(labels.hint("merge"), "id", "left").select("id", ((F.col("id") * 7919) % 1000 / 1000.0).alias("quality_score"), ((F.col("id") * 31) % 100 / 100.0).alias("semantic_conf"), scene.alias("scene"), obj.alias("object"), action.alias("action"))


def store(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Signature store of an older or a newer scan."""
    rows = media_file(spark, sf_dir).join(signature(spark, sf_dir).hint("merge"), "id").join(semantic(spark, sf_dir).hint("merge"), "id")
    if not new:
        return rows.where("id % 10 <> 0").withColumn("purpose", F.concat(F.lit("p"), (F.col("id") % 4).cast("string")))
    size = F.when(F.col("id") % 17 == 0, F.col("size") + 1).otherwise(F.col("size"))
    mtime = F.when(F.col("id") % 29 == 0, F.col("mtime") + 5).when(F.col("id") % 19 == 0, F.col("mtime") + 0.5).otherwise(F.col("mtime"))
    purpose = F.concat(F.lit("p"), F.when(F.col("id") % 13 == 0, F.col("id") % 4 + 1).otherwise(F.col("id") % 4).cast("string"))
    return rows.where("id % 10 <> 1").withColumns({"size": size, "mtime": mtime, "purpose": purpose})


def label_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, phash, dhash, motion_mean, motion_std, motion_ratio, emb) from embeddings."""
    e = F.col("embedding")

    def bits(test) -> Column:
        """Bit q is set where ``test`` of a vector matrix holds in column q."""

        def run(vectors):
            held = test(np.stack(vectors.to_list())) if len(vectors) else np.zeros((0, 64), bool)
            return pd.Series((held.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64), index=vectors.index)

        return F.array(F.pandas_udf(run, "long")(e))

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        bits(lambda v: v[:, :64] > 0).alias("phash"),
        bits(lambda v: np.roll(v[:, :64], -1, axis=1) > v[:, :64]).alias("dhash"),
        (F.abs(F.get(e, 0).cast("double")) * 10).alias("motion_mean"),
        F.abs(F.get(e, 1).cast("double")).alias("motion_std"),
        (F.abs(F.get(e, 2).cast("double")) / 5).alias("motion_ratio"),
        e.alias("emb"),
    )


def _sql_hash(left: str, right: str, codes: str = "c") -> str:
    """Bits as a HUGEINT sum, bit 63 negative, like a signed BIGINT."""
    return f"CAST(list_sum([CASE WHEN {codes}[{right} + 1] > {codes}[{left} + 1] THEN (CASE WHEN q = 63 THEN -9223372036854775808::HUGEINT ELSE (2::HUGEINT ** q)::HUGEINT END) ELSE 0::HUGEINT END FOR q IN range(0, 64)]) AS BIGINT)"


def _case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in pairs) + " END"


#: The same tables as common table expressions of DuckDB.
SQL = f"""
cut0 AS (SELECT doc_id AS id, text, n_chars, CAST(floor(0.1::DOUBLE * length(text)) AS BIGINT) AS st, CAST(least(length(text), floor(0.9::DOUBLE * length(text))) AS BIGINT) AS en FROM documents),
cut1 AS (SELECT *, greatest(1, en - st) AS span FROM cut0),
cut2 AS (SELECT id, text, n_chars, i, st + (span * i) // least({FRAMES}, span) AS place FROM (SELECT *, unnest(range(0, least({FRAMES}, span))) AS i FROM cut1)),
frames AS (SELECT id, i, place, [unicode(x) FOR x IN string_split(rpad(substr(text, place + 1, {FRAME}), {FRAME}, ' '), '')] AS c FROM cut2),
hashed AS (SELECT id, i, {_sql_hash("((q // 8) * 9 + q % 8)", "((q // 8) * 9 + q % 8 + 1)")} AS p, {_sql_hash("q", "q + 8")} AS d FROM frames),
lists AS (SELECT id, list(p ORDER BY i) AS phash, list(d ORDER BY i) AS dhash FROM hashed GROUP BY id),
signature AS MATERIALIZED (SELECT id, phash, dhash, CASE id % 3 WHEN 0 THEN [phash[1]] WHEN 1 THEN [~phash[1]] END AS audio,
  CASE WHEN id % 23 = 0 THEN 0.0::DOUBLE ELSE CAST(n_chars AS DOUBLE) END AS duration,
  [{", ".join(str(w) for w, _ in SHAPES)}][id % 6 + 1] AS width, [{", ".join(str(h) for _, h in SHAPES)}][id % 6 + 1] AS height, CAST(24 + id % 3 * 6 AS DOUBLE) AS fps
  FROM lists JOIN (SELECT doc_id AS id, n_chars FROM documents) USING (id)),
media0 AS (SELECT doc_id AS id, source, lang, n_chars, CASE WHEN doc_id % 5 = 0 THEN 'mov' WHEN doc_id % 7 = 0 THEN 'mkv' ELSE 'mp4' END AS ext FROM documents),
media_file AS (SELECT id, '/' || source || '/' || lang || '_' || id || '.' || ext AS path, lang || '_' || id || '.' || ext AS name, ext, n_chars * 1024 AS size, CAST(1700000000 + (id * 37) % 5000 AS DOUBLE) AS mtime, source, lang FROM media0),
semantic AS (SELECT doc_id AS id, (doc_id * 7919) % 1000 / 1000.0::DOUBLE AS quality_score, (doc_id * 31) % 100 / 100.0::DOUBLE AS semantic_conf,
  {_case("lang", SCENES.items())} AS scene, [{", ".join(repr(o) for o in OBJECTS)}][CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 + 1] AS object,
  CASE quality WHEN 1 THEN 'moving' WHEN 0 THEN 'static' END AS action FROM documents LEFT JOIN labels USING (doc_id)),
store_all AS (SELECT * FROM media_file JOIN signature USING (id) JOIN semantic USING (id)),
store_old AS (SELECT *, 'p' || id % 4 AS purpose FROM store_all WHERE id % 10 <> 0),
store_new AS (SELECT * REPLACE (CASE WHEN id % 17 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN id % 29 = 0 THEN mtime + 5 WHEN id % 19 = 0 THEN mtime + 0.5 ELSE mtime END AS mtime),
  'p' || CASE WHEN id % 13 = 0 THEN id % 4 + 1 ELSE id % 4 END AS purpose FROM store_all WHERE id % 10 <> 1),
label_signature AS (SELECT vec_id AS id, 'c' || label AS label, [{_sql_hash("q", "q", "embedding").replace("embedding[q + 1] > embedding[q + 1]", "embedding[q + 1] > 0")}] AS phash,
  [{_sql_hash("q", "((q + 1) % 64)", "embedding")}] AS dhash, abs(embedding[1]::DOUBLE) * 10 AS motion_mean, abs(embedding[2]::DOUBLE) AS motion_std, abs(embedding[3]::DOUBLE) / 5 AS motion_ratio, embedding AS emb FROM embeddings)
"""
