"""Cleanup as tables: a plan, its validation, a ledger of operations, and what can be restored or purged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.scalars import mask_path
from mediasift.operators.catalog import without_protected
from mediasift.operators.groups import ranked
from mediasift.operators.joins import with_one
from mediasift.operators.store import unchanged
from mediasift.sources.shared import stored


def plan(marked: DataFrame, folders: DataFrame, action: str = "move") -> DataFrame:
    """(group_id, id, path, size, mtime, action) of the members that go: not kept, not protected."""
    gone = without_protected(marked.where("not retained"), folders)
    return gone.select("group_id", "id", "path", "size", "mtime", F.lit(action).alias("action"))


def links(marked: DataFrame) -> DataFrame:
    """(source, target): each member that goes, and the retained one of its group that a link would lead to; groups may be of any size."""
    members = stored(marked.select("group_id", "path", "retained"), "linked-members")
    kept = members.groupBy("group_id").agg(F.max(F.when(F.col("retained"), F.col("path"))).alias("target"), F.count(F.lit(1)).alias("n"))
    gone = with_one(members, stored(kept, "link-targets"), ["group_id"]).where("not retained and path <> target")
    return gone.select(F.col("path").alias("source"), "target")


def validated(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """``items`` with ``status``: ready, changed or missing in the catalog of now."""
    now = catalog.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    joined = items.join(now.hint("merge"), "path", "left")
    same = unchanged(F.col("_size"), F.col("_mtime"), F.col("size"), F.col("mtime"))
    status = F.when(F.col("_size").isNull(), "missing").when(same, "ready").otherwise("changed")
    return joined.withColumn("status", status).drop("_size", "_mtime")


def execution(valid: DataFrame, operation: str, trash: str = "trash") -> DataFrame:
    """Ledger rows of the ready items: target trash/operation/00000_name, numbered over the whole plan by group and id; each task
    numbers a range of it."""
    ready = valid.where("status = 'ready'").withColumn("_plan", F.lit(0))
    numbered = ranked(ready, "_plan", [F.asc("group_id"), F.asc("id")])
    name = F.element_at(F.split("path", "/"), -1)
    target = F.concat(F.lit(f"{trash}/{operation}/"), F.format_string("%05d", F.col("rank") - 1), F.lit("_"), name)
    return numbered.withColumn("operation_id", F.lit(operation)).withColumn("target", target).drop("_plan", "rank")


def restorable(ledger: DataFrame, catalog: DataFrame) -> DataFrame:
    """``ledger`` with ``restore``: ready if the target is there with its size and digest and the source is not; else conflict."""
    at = catalog.select(F.col("path").alias("target"), F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    back = catalog.select(F.col("path").alias("source"), F.lit(True).alias("_there"))
    joined = ledger.join(at.hint("merge"), "target", "left").join(back.hint("merge"), "source", "left")
    good = F.coalesce((F.col("size") == F.col("_size")) & (F.col("sha256") == F.col("_sha")), F.lit(False)) & F.col("_there").isNull()
    return joined.withColumn("restore", F.when(good, "ready").otherwise("conflict")).drop("_size", "_sha", "_there")


def operations(ledger: DataFrame) -> DataFrame:
    """(operation_id, created_at, items, bytes), the newest first when ordered by created_at."""
    return ledger.groupBy("operation_id").agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("items"), F.sum("size").alias("bytes"))


def purgeable(ledger: DataFrame, now: float, days: int) -> DataFrame:
    return operations(ledger).where(F.col("created_at") < now - days * 86400)


def audit(marked: DataFrame, purpose: Column) -> DataFrame:
    """(group_id, rank, status, purpose, path): the path masked."""
    return marked.select("group_id", "rank", F.when(F.col("retained"), "retained").otherwise("cleaned").alias("status"), purpose.alias("purpose"), mask_path(F.col("path")).alias("path"))
