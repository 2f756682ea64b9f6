"""Stores that are changed where they lie."""

import pytest
from pyspark.sql import functions as F

from mediasift.operators import store as T

SCHEMA = "path string, size long, mtime double, scene string, purpose string"


def made(spark, n, purpose="p"):
    return spark.createDataFrame([(f"/{k}", k, 1.0, None if k % 2 else "s", purpose) for k in range(n)], SCHEMA)


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_a_store_is_saved_to_where_it_was_read_from(spark, tmp_path):
    at = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        T.load(spark, at)
    T.save(made(spark, 5).withColumn("pixels", F.lit(b"x")), at)
    first = T.load(spark, at)
    assert "pixels" not in first.columns
    T.save(first.where("size > 2"), at)
    assert paths(T.load(spark, at)) == ["/3", "/4"] and len(paths(first)) == 5  # who began before goes on
    T.save(T.load(spark, at).where("size > 3"), at)
    assert paths(T.load(spark, at)) == ["/4"]
    assert len(list((tmp_path / "store").glob("snapshot-*"))) == 2


def test_a_failed_write_leaves_the_store_as_it_was(spark, tmp_path):
    at = str(tmp_path / "store")
    T.save(made(spark, 5), at)
    name = T.current(spark, at)
    broken = T.load(spark, at).withColumn("size", F.when(F.col("size") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("size")))
    with pytest.raises(Exception, match="no"):
        T.save(broken, at)
    assert T.current(spark, at) == name and len(paths(T.load(spark, at))) == 5
    (tmp_path / "store" / "snapshot-00000009-left-over").mkdir()
    T.save(made(spark, 3), at, keep=1)
    assert paths(T.load(spark, at)) == ["/0", "/1", "/2"] and len(list((tmp_path / "store").glob("snapshot-*"))) == 1


def test_counts(spark):
    old, new = made(spark, 6), made(spark, 8).withColumn("size", F.when(F.col("path") == "/3", 99).otherwise(F.col("size"))).where("path <> '/4'")
    assert tuple(T.invalid_counts(old, new).first()) == (2, 4, 3)  # /3 loses its purpose, /4 both fields
    assert sorted(map(tuple, T.merge_counts([old, new, old]).collect())) == [(0, 6, 8), (1, 2, 8), (2, 0, 8)]
    assert tuple(T.invalid_counts(old.where("false"), new).first()) == (0, 0, 0)
