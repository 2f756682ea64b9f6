"""Reading catalogs, stores and lists; writing tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.hashes import from_hex, to_hex
from mediasift.operators.joins import with_one
from mediasift.sources import listing as L
from mediasift.sources.listing import reachable
from mediasift.sources.shared import stored

#: Fixed values.
EXTENSIONS = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "flv")
SKIPPED_FOLDERS = ("__pycache__",)
VERSIONS = ("2.0", "2.1", "2.2", "2.3", "2.4.0", "2.5", "2.6")


def _listed(spark: SparkSession, roots: list[str], recursive: bool, extensions: tuple[str, ...], exclude: tuple[str, ...], least: int, most: int | None) -> DataFrame:
    """Files under each root, with that ``root``, listed by the executors."""
    spark.dataSource.register(L.MediaListing)
    options = {"roots": json.dumps(roots), "recursive": str(recursive).lower(), "extensions": json.dumps(extensions), "exclude": json.dumps(exclude), "least": str(least), "prefixes": str(L.PREFIXES)}
    return spark.read.format("media_listing").options(**options, **({} if most is None else {"most": str(most)})).load()


def _listed_by_spark(spark: SparkSession, roots: list[str], recursive: bool, extensions: tuple[str, ...], exclude: tuple[str, ...], least: int, most: int | None) -> DataFrame:
    """The same by Spark's own reader of binary files, which holds the whole listing on the driver: for file systems that only Spark reaches."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(roots).drop("content")
    path = F.regexp_replace("path", "^file:/+", "/")
    rows = listing.select(path.alias("path"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("us"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.select("path", name.alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "size", (F.col("us") / 1e6).alias("mtime"))
    root = F.coalesce(*[F.when(F.startswith("path", F.lit(f"{re.sub('^file:/+', '/', r)}/")), F.lit(r)) for r in sorted(roots, key=len, reverse=True)])
    bad = F.arrays_overlap(F.split(F.lower("dir"), "/"), F.array(*map(F.lit, exclude))) if exclude else F.lit(False)
    return rows.withColumn("root", root).where(F.col("ext").isin(*extensions) & ~bad & (F.col("size") >= least) & (F.lit(True) if most is None else F.col("size") <= most))


def scan(spark: SparkSession, roots: list[str], recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = (), least: int = 1, most: int | None = None) -> DataFrame:
    """(path, name, dir, ext, size, mtime) of the media files under some roots, once each; contents are not read.

    Hidden and ``~$`` names, skipped and excluded folders (any part of the path, case does not count), empty files and
    sizes outside the bounds are left out. Executors list the trees (:mod:`mediasift.sources.listing`) where Python reaches
    the file system.
    """
    roots = list(dict.fromkeys(r.rstrip("/") or "/" for r in roots))
    apart = [r for r in roots if not (recursive and any(o != r and r.startswith(f"{o.rstrip('/')}/") for o in roots))]
    return _scan(spark, apart, recursive, extensions, exclude, least, most).drop("root")


def _scan(spark, roots, recursive, extensions, exclude, least, most) -> DataFrame:
    left_out = tuple(x.lower() for x in (*SKIPPED_FOLDERS, *exclude))
    listed = _listed if all(map(reachable, roots)) else _listed_by_spark
    rows = listed(spark, roots, recursive, tuple(x.lower() for x in extensions), left_out, max(1, least), most)
    return rows.where(~F.col("name").startswith(".") & ~F.col("name").startswith("~$"))


def simple_scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name) of the media files under a root, ordered by path."""
    return scan(spark, [root], extensions=extensions).select("path", "name").orderBy("path")


def _there(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


def batch_scan(spark: SparkSession, listing: str) -> tuple[DataFrame, DataFrame]:
    """(files with their ``root``, (root, status, files, bytes)) of the directories in a text file; ``#`` starts a comment.

    A directory that isn't there has the status ``missing`` and no files; the others (``ok``) are scanned all the same, each by
    itself: a file in a directory that lies in another one counts for both.
    """
    roots = [r["value"].strip() for r in spark.read.text(listing).collect()]  # a hand-written list
    roots = list(dict.fromkeys(r.rstrip("/") for r in roots if r and not r.startswith("#")))
    found = {r: _there(spark, r) for r in roots}
    good = [r for r in roots if found[r]]
    files = _scan(spark, good, True, EXTENSIONS, (), 1, None) if good else spark.createDataFrame([], L.SCHEMA)
    counted = files.groupBy("root").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    every = spark.createDataFrame([(r, "ok" if found[r] else "missing") for r in roots], "root string, status string")
    return files, every.join(F.broadcast(counted), "root", "left").select("root", "status", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def write_legacy_store(store: DataFrame, path: str, part_entries: int = 500, version: str = VERSIONS[-1]) -> None:
    """Export as such a JSON store: parts of about ``part_entries`` entries (by a hash of the path), each in a folder of its own under ``path``."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    hexes = lambda c: F.transform(c, lambda h: to_hex(h)).alias(c)
    plain = [c for c in ("size", "mtime", "md5", "duration", "width", "height", "fps") if c in store.columns]
    entry = F.to_json(F.struct(*plain, *[hexes(c) for c in ("phash", "dhash", "audio") if c in store.columns]))
    entry = F.concat(F.lit("  "), quoted(F.col("path")), F.lit(": {\n    "), F.regexp_extract(entry, r"(?s)^\{(.*)\}$", 1), F.lit("\n  }"))
    rows = stored(store.select("path", entry.alias("entry")), "json-entries")
    parts = -(-rows.count() // part_entries) or 1
    listed = rows.groupBy(F.pmod(F.xxhash64("path"), F.lit(parts)).alias("part")).agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    whole = F.concat(F.lit(f'{{\n  "_version": "{version}",\n'), F.array_join("entries", ",\n"), F.lit("\n}"))
    listed.select("part", whole.alias("value")).repartition("part").write.partitionBy("part").text(path)


#: What stands between two entries of a store that is written with an indent of two: no text in it can hold a line break.
BETWEEN = '\n  },\n  "'


def legacy_store(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Import of a JSON store (one or several parts, also gzipped): hex hashes become lists of BIGINT.

    Keys that begin with ``_`` are no entries. A part of an unknown version, or one that can't be read to its end, gives no rows.
    Parts with an indent of two, as such stores are written, are cut between entries and may be read by many tasks, wherever Spark
    splits the file; a part in any other layout is one row. A gzipped part is one task.
    """
    entry = "struct<size:bigint,mtime:double,md5:string,phash:array<string>,dhash:array<string>,audio:array<string>,duration:double,width:int,height:int,fps:double>"
    cut = spark.read.option("lineSep", BETWEEN).text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    cut = cut.select("file", "value", F.rtrim("value", F.lit(" \t\r\n")).alias("bare"))
    first, last = F.startswith(F.ltrim("bare", F.lit(" \t\r\n\ufeff")), F.lit("{")), F.endswith("bare", F.lit("}"))
    whole = F.concat(F.when(first, "").otherwise('{"'), "bare", F.when(last, "").otherwise("}}"))
    read = cut.select("file", first.cast("int").alias("first"), last.cast("int").alias("last"), F.from_json(whole, "map<string,string>").alias("entries"))
    read = stored(read, "store-entries")
    version = F.try_element_at("entries", F.lit("_version"))
    parts = read.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entries").isNull()).alias("unread"), F.sum("first").alias("firsts"), F.sum("last").alias("lasts"), F.max(version).alias("version"))
    good = parts.where((F.col("unread") == 0) & (F.col("firsts") == 1) & (F.col("lasts") == 1) & (F.col("version").isNull() | F.col("version").isin(*VERSIONS)))
    rows = with_one(read, stored(good.select("file", "n"), "good-parts"), ["file"])
    entries = rows.select(F.explode("entries").alias("path", "json")).where("not startswith(path, '_')")
    e = entries.select("path", F.from_json("json", entry).alias("e")).where("e is not null").select("path", "e.*")
    hexes = lambda c: F.transform(c, lambda x: from_hex(x))
    return e.withColumns({c: hexes(c) for c in ("phash", "dhash", "audio")})


def groups_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(group_no, path) of a groups file in either layout: ``{groups: [[...]]}`` or a plain list of lists of paths."""
    text = spark.read.text(path, wholetext=True)
    lists = F.coalesce(F.from_json(F.get_json_object("value", "$.groups"), "array<array<string>>"), F.from_json("value", "array<array<string>>"))
    groups = text.select(F.posexplode(lists).alias("group_no", "paths"))
    return groups.select("group_no", F.explode("paths").alias("path"))


def write_suspects(suspects: DataFrame, path: str) -> None:
    """A list for review, ordered by score, three places."""
    suspects.withColumn("score", F.round("score", 3)).orderBy("score", "id").write.mode("overwrite").option("header", True).csv(path)


def read_suspects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("id string, label string, score double, reasons string, suggested string").csv(path)
