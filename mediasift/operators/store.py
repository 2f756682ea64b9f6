"""The incremental signature store: one row for each path.

A store on disk is a folder of snapshots and a pointer file that names the current one. A write makes a new snapshot beside
the others and moves the pointer when it is complete, so a store can be read, changed and saved to where it was read from, a
failed write leaves it as it was, and readers that began before go on with what they had.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediasift.functions.hashes import to_hex

TOLERANCE = 1.0
SEMANTIC = ("scene", "object", "action", "purpose", "quality_score", "semantic_conf")


def unchanged(size: Column, mtime: Column, old_size: Column, old_mtime: Column) -> Column:
    return F.coalesce((size == old_size) & (F.abs(mtime - old_mtime) < TOLERANCE), F.lit(False))


def validity(catalog: DataFrame, store: DataFrame, key: str = "path", use_md5: bool = False) -> DataFrame:
    """``catalog`` with ``valid``: whether the store's entry still stands for the file. With ``use_md5`` a missing digest is invalid."""
    columns = [key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime")] + ([F.col("md5").alias("_md5")] if use_md5 else [])
    joined = catalog.join(store.select(*columns).hint("merge"), key, "left")
    good = unchanged(F.col("size"), F.col("mtime"), F.col("_size"), F.col("_mtime"))
    good = good & F.coalesce(F.col("md5") == F.col("_md5"), F.lit(False)) if use_md5 else good
    return joined.withColumn("valid", good).drop("_size", "_mtime", "_md5")


def to_compute(catalog: DataFrame, store: DataFrame, key: str = "path") -> DataFrame:
    """The files whose signature has to be computed."""
    return validity(catalog, store, key).where("not valid").drop("valid")


def without_invalid(store: DataFrame, catalog: DataFrame, key: str = "path") -> DataFrame:
    """The entries whose file is still there and unchanged."""
    now = catalog.select(key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    joined = store.join(now.hint("merge"), key)
    return joined.where(unchanged(F.col("_size"), F.col("_mtime"), F.col("size"), F.col("mtime"))).drop("_size", "_mtime")


def without_expired(store: DataFrame, catalog: DataFrame, now: float, days: int, key: str = "path") -> DataFrame:
    """The entries whose file is there and not older than so many days."""
    there = catalog.select(key, F.col("mtime").alias("_mtime"))
    return store.join(there.hint("merge"), key).where(F.col("_mtime") >= now - days * 86400).drop("_mtime")


def merged(stores: list[DataFrame], key: str = "path") -> DataFrame:
    """All entries; of a key that several stores have, the first store's."""
    every = reduce(DataFrame.unionByName, [s.withColumn("_store", F.lit(k)) for k, s in enumerate(stores)])
    packed = every.groupBy(key).agg(F.min_by(F.struct(*[c for c in every.columns if c not in (key, "_store")]), "_store").alias("_e"))
    return packed.select(key, "_e.*")


def cleared(store: DataFrame, columns: tuple[str, ...] = SEMANTIC) -> DataFrame:
    """The store without its semantic fields; signatures stay."""
    return store.withColumns({c: F.lit(None).cast(store.schema[c].dataType) for c in columns if c in store.columns})


def hash_backup(store: DataFrame) -> DataFrame:
    """Signatures as hex text, for export."""
    hexes = lambda c: F.array_join(F.transform(c, lambda h: to_hex(h)), ",")
    return store.select("path", "name", "size", hexes("phash").alias("phash"), hexes("dhash").alias("dhash"), "duration", "width", "height")


def merge_counts(stores: list[DataFrame], key: str = "path") -> DataFrame:
    """(store, added, total): what each store (by its place in the list) brings to :func:`merged`, and how many entries there are in all."""
    every = reduce(DataFrame.unionByName, [s.select(key, F.lit(k).alias("store")) for k, s in enumerate(stores)])
    first = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("store").alias("store")).groupBy("store").agg(F.count(F.lit(1)).alias("n"))
    listed = stores[0].sparkSession.range(len(stores)).select(F.col("id").cast("int").alias("store"))
    counted = listed.join(F.broadcast(first), "store", "left").select("store", F.coalesce("n", F.lit(0)).alias("added"))
    return counted.select("store", "added", F.sum("added").over(Window.partitionBy()).alias("total"))  # one row a store


def invalid_counts(store: DataFrame, catalog: DataFrame, columns: tuple[str, ...] = SEMANTIC, key: str = "path") -> DataFrame:
    """One row: entries that :func:`without_invalid` removes and keeps, and the semantic fields that are lost with the former."""
    now = catalog.select(key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    good = unchanged(F.col("_size"), F.col("_mtime"), F.col("size"), F.col("mtime"))
    fields = sum((F.col(c).isNotNull().cast("long") for c in columns if c in store.columns), F.lit(0).cast("long"))
    marked = store.join(now.hint("merge"), key, "left").select(good.alias("good"), fields.alias("fields"))
    return marked.agg(F.count_if(~F.col("good")).alias("removed"), F.count_if("good").alias("kept"), F.coalesce(F.sum(F.when(~F.col("good"), F.col("fields"))), F.lit(0)).alias("lost_fields"))


POINTER = "CURRENT"


class _Folder:
    """A folder in any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.gateway, self.jvm, self.path = spark.sparkContext._gateway, spark._jvm, path.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at())) if self.fs.exists(self.at()) else []

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Give a file a new content, all at once."""
        beside = f".{name}-{uuid4().hex}"
        stream = self.fs.create(self.at(beside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.conf).rename(self.at(beside), self.at(name), how)


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the snapshot that a store's readers get now; None if nothing has been saved."""
    return _Folder(spark, path).read(POINTER)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot of a store. It stays what it is while the store is saved anew (see ``keep`` of :func:`save`)."""
    name = current(spark, path)
    if name is None:
        raise FileNotFoundError(f"no store at {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")


def save(store: DataFrame, path: str, keep: int = 2) -> str:
    """Write the store, without transient pixels, as a new snapshot, and make it the current one; returns its name.

    ``store`` may have been read from there. Of older snapshots the newest stay, ``keep`` with the current one; others, and
    what failed writes have left, are deleted. One writer at a time.
    """
    folder = _Folder(store.sparkSession, path)
    numbers = [int(n.split("-")[1]) for n in folder.names() if n.startswith("snapshot-")]
    name = f"snapshot-{max(numbers, default=0) + 1:08d}-{uuid4().hex}"
    store.drop("frames", "pixels").write.parquet(f"{folder.path}/{name}")
    before = folder.read(POINTER)
    folder.replace(POINTER, name)
    whole = [n for n in folder.names() if n.startswith("snapshot-") and folder.fs.exists(folder.at(f"{n}/_SUCCESS"))]
    stay = {name, before, *sorted(whole)[-keep:]} if keep > 1 else {name}
    for n in folder.names():
        if n.startswith("snapshot-") and n not in stay:
            folder.fs.delete(folder.at(n), True)
    return name


def health(store: DataFrame) -> DataFrame:
    """One row: entries and percentages that have hashes, a duration, sound and a purpose; entries without a hash."""
    n = F.count(F.lit(1))
    share = lambda c: F.round(F.lit(100.0) * F.count_if(c) / n, 6)
    has = F.coalesce(F.size("phash") > 0, F.lit(False))
    return store.agg(
        n.alias("entries"),
        share(has).alias("hash"),
        share(F.col("duration") > 0).alias("duration"),
        share(F.col("audio").isNotNull()).alias("audio"),
        F.count_if(~has).alias("corrupted"),
        F.count_if(F.col("purpose").isNotNull()).alias("classified"),
    )


def added(new: DataFrame, old: DataFrame, key: str = "path") -> DataFrame:
    return new.select(key).join(old.select(key).hint("merge"), key, "left_anti")


def changed_semantic(new: DataFrame, old: DataFrame, key: str = "path") -> DataFrame:
    was = old.select(key, F.col("scene").alias("_scene"), F.col("purpose").alias("_purpose"))
    return new.join(was.hint("merge"), key).where(~(F.col("scene").eqNullSafe(F.col("_scene")) & F.col("purpose").eqNullSafe(F.col("_purpose")))).select(key)


def changed_physical(new: DataFrame, old: DataFrame, key: str = "path") -> DataFrame:
    was = old.select(key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    return new.join(was.hint("merge"), key).where((F.col("size") != F.col("_size")) | (F.abs(F.col("mtime") - F.col("_mtime")) >= TOLERANCE)).select(key)


def new_hash_groups(new: DataFrame, old: DataFrame) -> DataFrame:
    """(signature, n): hash lists that more than one path has now, and at most one had before."""
    count = lambda df, name: df.groupBy(F.array_join(F.col("phash").cast("array<string>"), "|").alias("signature")).agg(F.count(F.lit(1)).alias(name))
    now, before = count(new, "n").where("n > 1"), count(old, "was").where("was > 1")
    return now.join(before.hint("merge"), "signature", "left_anti")


def new_group_sets(new: DataFrame, old: DataFrame) -> DataFrame:
    """(group_id) of the new groups (group_id, id) whose members are not all in one old group."""
    was = old.select("id", F.col("group_id").alias("old_group"))
    sizes = new.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    held = new.join(was.hint("merge"), "id").groupBy("group_id", "old_group").agg(F.count(F.lit(1)).alias("m"))
    full = held.join(sizes.hint("merge"), "group_id").where("m = n").select("group_id").distinct()
    return sizes.select("group_id").join(full.hint("merge"), "group_id", "left_anti")
