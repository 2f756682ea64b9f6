"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Tables that this process has written.
_written: list[str] = []
#: Where the tables that are still at hand lie.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where a local session (as in tests) names none a temporary folder is made and set; on a cluster that is an error.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="mediasift-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage without tying the rows to an executor, gives the planner true sizes,
    and keeps work that several consumers share from being done twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Delete the files of a table from :func:`stored` that nothing reads any more: the round before the last, say."""
    if path := _places.pop(table, None):
        _written.remove(path)
        _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process. For after a job's results are written: DataFrames that still read the
    tables are of no use afterwards."""
    _places.clear()
    while _written:
        _delete(spark, _written.pop())


def stored_and_seen(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`stored`, and aggregates of the rows."""
    out = stored(df, name)
    return out, out.agg(*metrics).first().asDict()
