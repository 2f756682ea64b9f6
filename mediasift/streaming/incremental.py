"""Signatures that arrive as a stream: exact repeats are dropped, and new items are compared with the store.

What is compared is not items but classes: distinct signatures, named by a digest of theirs. A class is compared once, when
its first item arrives, with all classes before it, and both directions of the similarity are kept. Items come, change and
go without undoing any of that: which item stands for a class (its smallest id), and so which links there are, follows from
the items that are there now. Thus the links are those that a full scan of the same items gives, whatever the order in which
they came to be.

All three tables (items, classes, pairs of classes) are logs of batches. A batch that is run again reads only the batches
before it and writes its own folders anew, so it leaves the same rows however often it runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from mediasift.operators.joins import with_one
from mediasift.operators.pairs import pairs_above
from mediasift.operators.store import to_compute
from mediasift.sources.shared import stored

SIGNATURE = "id bigint, path string, size bigint, mtime double, phash array<bigint>, dhash array<bigint>, audio array<bigint>, duration double"
PARTS = ("phash", "dhash", "audio", "duration")
#: Kept by Spark on the executors and written to the query's checkpoint.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def signature_stream(spark: SparkSession, folder: str, schema: str = SIGNATURE) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def class_key() -> Column:
    """128 bits of an item's whole signature: hash lists, sound and duration; null for an item without a hash."""
    whole = F.md5(F.to_json(F.struct("phash", "dhash", "audio", (F.col("duration") + F.lit(0.0)).alias("duration")), {"ignoreNullFields": "false"}))
    return F.when(F.coalesce(F.size("phash"), F.lit(0)) + F.coalesce(F.size("dhash"), F.lit(0)) > 0, whole)


class _First(StatefulProcessor):
    """Of each key the first row, until the watermark has passed it by ``lateness`` milliseconds. The state is the time of that row;
    a timer clears it."""

    def __init__(self, time: str, columns: list[str], lateness: int):
        self.time, self.columns, self.lateness = time, columns, lateness

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:  # nothing to compare: each row is an item of its own
            for part in rows:
                yield part[self.columns]
            return
        first = None
        for part in rows:
            head = part.loc[[part[self.time].idxmin()]]
            first = head if first is None or head[self.time].iloc[0] < first[self.time].iloc[0] else first
        if first is not None and not self.seen.exists():
            at = int(first[self.time].iloc[0].timestamp() * 1000)
            self.seen.update((at,))
            self.handle.registerTimer(at + self.lateness)
            yield first[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def distinct_signatures(stream: DataFrame, time: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each signature, as long as the watermark is not ``lateness`` past that row; then it counts as new.

    Signatures are equal if all hashes, the sound and the duration are. Rows without a hash all pass. Rows whose time the
    watermark has passed, or that have none, are left out (:func:`late_rows` counts the former). The session has to keep its state in RocksDB;
    this is set here. State is spread by signature; of rows without a hash, which are spread by a hash of the row, there is none.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ms = int(pd.Timedelta(lateness).total_seconds() * 1000)
    keyed = stream.where(F.col(time).isNotNull()).withWatermark(time, lateness).withColumn("_class", class_key())
    keyed = keyed.withColumn("_spread", F.when(F.col("_class").isNull(), F.xxhash64(*[c for c in stream.columns]) % 1024))
    return keyed.groupBy("_class", "_spread").transformWithStateInPandas(_First(time, stream.columns, ms), stream.schema, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """How many rows a query has left out so far because the watermark had passed them."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def class_pairs(known: DataFrame, fresh: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(x, y, there, back): the classes at or above the threshold from either side, of which one at least is ``fresh``, with
    the similarities from x to y and from y to x. Both tables hold (class, signature) once for each class."""
    both = known.select("class", *PARTS, F.lit(False).alias("fresh")).unionByName(fresh.select("class", *PARTS, F.lit(True).alias("fresh")))
    both = stored(both.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers for this comparison alone
    found = pairs_above(both, threshold, fresh=F.col("fresh"), both=True)
    for side, name in (("a", "x"), ("b", "y")):
        found = found.join(both.select(F.col("id").alias(side), F.col("class").alias(name)).hint("merge"), side)
    return found.select("x", "y", F.col("similarity").alias("there"), "back")


def _batches(spark: SparkSession, path: str, schema: StructType | str, before: int | None = None) -> DataFrame:
    """The rows of a log with their ``batch``, of the batches before that number (default: of all); none if nothing has been written."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = StructType([*schema.fields]).add("batch", "long")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not fs.listStatus(hadoop):
        return spark.createDataFrame([], wide)
    rows = spark.read.schema(wide).parquet(path)
    return rows if before is None else rows.where(F.col("batch") < before)


CLASSES = "class string, phash array<bigint>, dhash array<bigint>, audio array<bigint>, duration double"
PAIRS = "x string, y string, there double, back double"


def _classes_path(pairs_path: str) -> str:
    return f"{pairs_path.rstrip('/')}-classes"


def current_store(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The newest row of every path that is still there, with its ``class`` (null without a hash) and ``batch``, of the batches
    before that number (default: of all)."""
    wide = StructType([f for f in schema.fields if f.name != "class"]).add("class", "string")
    rows = _batches(spark, path, wide, before)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest.hint("merge"), ["path", "batch"]).where("size is not null").select(*rows.columns)


def current_pairs(spark: SparkSession, pairs_path: str, store: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity), a < b: the links of the items that are there now, as a full scan gives them. ``store`` as :func:`current_store`.

    A class is represented by its smallest id, which is linked with the other items of the class (a star) and with those of
    similar classes; the similarity is the one from a to b.
    """
    signed = stored(store.where("class is not null").select("id", "class"), "signed")
    heads = stored(signed.groupBy("class").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    pairs = _batches(spark, pairs_path, PAIRS).select("x", "y", "there", "back")
    for side, name in (("x", "p"), ("y", "q")):
        pairs = pairs.join(heads.select(F.col("class").alias(side), F.col("head").alias(name)).hint("merge"), side)
    similarity = F.when(F.col("p") < F.col("q"), F.col("there")).otherwise(F.col("back"))
    linked = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    copies = with_one(signed, heads.where("n > 1"), ["class"]).where("head < id")
    return linked.unionByName(copies.select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity")))


def incremental_scan(stream: DataFrame, store_path: str, pairs_path: str, checkpoint: str, threshold: float = 0.7) -> StreamingQuery:
    """Start a query that, for every batch, keeps what the store lacks or has outdated, and compares the classes that are new.

    A row without a size says that its path is gone. Of a path that comes twice in a batch, the row with the latest time
    counts (of equal times, one with a size). Ids are distinct among the items that are there at a time. Items, classes and pairs of classes
    go to the batch's own folders (``batch=<number>``) under ``store_path``, ``<pairs_path>-classes`` and ``pairs_path``; read
    the results with :func:`current_store` and :func:`current_pairs`.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"batch={number}"
        known = stored(current_store(spark, store_path, batch.schema, number).select("path", "size", "mtime"), "known")
        latest = batch.groupBy("path").agg(F.max_by(F.struct(*batch.columns), F.struct("mtime", "size", "id")).alias("r")).select("r.*")
        new = stored(to_compute(latest, known).withColumn("class", class_key()), "new")
        before = _batches(spark, _classes_path(pairs_path), CLASSES, number).drop("batch")
        come = new.where("class is not null and size is not null").groupBy("class").agg(F.any_value(F.struct(*PARTS)).alias("s")).select("class", "s.*")
        fresh = stored(come.join(before.select("class").hint("merge"), "class", "left_anti"), "new-classes")
        class_pairs(before, fresh, threshold).write.mode("overwrite").parquet(f"{pairs_path}/{folder}")
        fresh.write.mode("overwrite").parquet(f"{_classes_path(pairs_path)}/{folder}")
        new.write.mode("overwrite").parquet(f"{store_path}/{folder}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
