"""Duplicate groups: components, complete-linkage split, retention, reports on space."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.operators.components import components
from mediasift.operators.joins import with_one
from mediasift.sources.shared import stored

STRATEGIES = ("max_size", "latest", "max_res", "max_bitrate")


def group_members(links: DataFrame) -> DataFrame:
    """(group_id, id) of the groups that links (a, b) make; a group is named by its smallest id."""
    return components(links).select(F.col("component").alias("group_id"), F.col("node").alias("id"))


#: Similarities are summed in whole numbers of this part, so that sums don't depend on their order; means that differ by less
#: than TIE of them are equal.
_UNIT, TIE = 10**9, 1000


#: Bytes of links that a task holds before it puts them on its scratch disk, and members of which the least is kept at hand.
HELD_BYTES, SPAN = 1 << 26, 512
_LINK = np.dtype([("y", np.int64), ("near", np.int32)])


def ejected(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
    """The members that stay of one component: as long as any two members are linked with less than the floor, or not at all, the one with
    the lowest mean similarity goes (the smallest id on ties).

    Links come both ways as (x, y, near, more_x, more_y), in order of ``x``; ``near`` is twice the similarity in whole units, and one more if it
    reaches the floor. ``more`` is the number of further equal items that a member stands for. They have the same mean and are next in turn as
    soon as one of them is (each that goes takes a similarity of 1 from the others of its kind, and less from all else), so they go together.

    A few numbers a member are held; the links, of which each member's are read once, when it goes, lie on the task's scratch disk if they are
    many. The lowest is found by the lowest of each span of members, and a step costs what the member is linked with.
    """
    members, counts, more, sums, fits = [], [], [], [], []
    scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.SpooledTemporaryFile(HELD_BYTES, dir=scratch) as links:
        for batch in batches:
            x, y, near, m, n = (batch.column(c).to_numpy() for c in ("x", "y", "near", "more_x", "more_y"))
            rows = np.empty(len(x), _LINK)
            rows["y"], rows["near"] = y, near
            links.write(rows.tobytes())
            first = np.flatnonzero(np.diff(x, prepend=x[:1] - 1))
            for out, part in zip((members, counts, more, sums, fits), (x[first], np.diff(np.append(first, len(x))), m[first], np.add.reduceat((near >> 1) * (1 + n.astype(np.int64)), first), np.add.reduceat(near & 1, first)), strict=True):
                out.append(part.astype(np.int64))
        members, counts, more, sums, fits = map(np.concatenate, (members, counts, more, sums, fits))
        first = np.flatnonzero(np.diff(members, prepend=members[:1] - 1))  # a member's links may come in several batches
        members, more = members[first], more[first]
        counts, sums, fits = (np.add.reduceat(v, first) for v in (counts, sums, fits))
        if (np.diff(members) <= 0).any():
            raise ValueError("links are not in order")
        sums += more * _UNIT
        return members[_standing(members, np.cumsum(counts) - counts, counts, more, sums, fits, links)]


def _standing(members: np.ndarray, start: np.ndarray, counts: np.ndarray, more: np.ndarray, sums: np.ndarray, fits: np.ndarray, links: IO[bytes]) -> np.ndarray:
    """Whether each member stays; ``counts`` of the ``links`` from ``start`` on are a member's."""
    left = len(members)
    bad = int((left - 1 - fits).sum()) // 2
    stays = np.ones(left, bool)
    key = np.full(-(-left // SPAN) * SPAN, np.inf)
    key[:left] = np.rint(sums / TIE)
    spans = key.reshape(-1, SPAN)
    lowest = spans.min(axis=1)
    while bad:
        span = int(lowest.argmin())
        worst = span * SPAN + int(spans[span].argmin())
        bad -= left - 1 - int(fits[worst])
        left -= 1
        stays[worst], key[worst] = False, np.inf
        links.seek(int(start[worst]) * _LINK.itemsize)
        rows = np.frombuffer(links.read(int(counts[worst]) * _LINK.itemsize), _LINK)
        other = np.searchsorted(members, rows["y"])
        there = stays[other]
        other, near = other[there], rows["near"][there].astype(np.int64)
        sums[other] -= (near >> 1) * (1 + more[worst])
        fits[other] -= near & 1
        key[other] = np.rint(sums[other] / TIE)
        np.minimum.at(lowest, other // SPAN, key[other])
        lowest[span] = spans[span].min()
    return stays


def split_groups(links: DataFrame, floor: float, copies: DataFrame | None = None) -> DataFrame:
    """(group_id, id) so that every pair of a group is linked with at least ``floor`` (absent pairs count as 0). Ids are whole numbers, and a
    pair is linked once.

    Links below the floor don't join components, but count at their value inside one. Components in which all pairs reach
    the floor stay as they are; the others are split by :func:`ejected`, which is sequential by definition, so the links of
    one component come to one task. Groups of one go.

    ``copies`` (a, b) are the equal items b of a representative a (a star). They are left out of the links, weigh in its mean
    similarity, and follow it into its group; if it is in none, it makes one with them.
    """
    copies = links.where("false").select("a", "b") if copies is None else copies.select("a", "b")
    counts = stored(copies.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "copy-counts")
    weighed = links.select("a", "b", "similarity").join(counts.select("a", F.col("n").alias("more_a")).hint("merge"), "a", "left").join(counts.select(F.col("a").alias("b"), F.col("n").alias("more_b")).hint("merge"), "b", "left")
    weighed = stored(weighed.na.fill(0, ["more_a", "more_b"]), "weighed-links")
    members = stored(group_members(weighed.where(F.col("similarity") >= floor)), "members")
    of = lambda side: members.select(F.col("group_id").alias(f"group_{side}"), F.col("id").alias(side)).hint("merge")
    inside = stored(weighed.join(of("a"), "a").join(of("b"), "b").where("group_a = group_b").select(F.col("group_a").alias("group_id"), *weighed.columns), "inside-links")
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    edges = inside.where(F.col("similarity") >= floor).groupBy("group_id").agg(F.count(F.lit(1)).alias("m"))
    whole = stored(sizes.join(edges.hint("merge"), "group_id").where("2 * m = n * (n - 1)").select("group_id"), "whole")

    kind = members.schema["id"].dataType.simpleString()

    def eject(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ejected(batches)
        if len(kept) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(kept[:1], len(kept))), pa.array(kept)], names=["group_id", "id"])

    near = (F.rint(F.col("similarity") * _UNIT).cast("int") * 2 + (F.col("similarity") >= floor).cast("int")).alias("near")
    ways = [inside.select("group_id", F.col(x).alias("x"), F.col(y).alias("y"), near, F.col(f"more_{x}").alias("more_x"), F.col(f"more_{y}").alias("more_y")) for x, y in ("ab", "ba")]
    both = ways[0].unionByName(ways[1]).join(whole.hint("merge"), "group_id", "left_anti").repartition("group_id").sortWithinPartitions("group_id", "x")
    others = both.groupBy("group_id").applyInArrow(eject, "group_id long, id long").select(*[F.col(c).cast(kind) for c in ("group_id", "id")])
    kept = stored(members.join(whole.hint("merge"), "group_id", "left_semi").select("group_id", "id").unionByName(others), "split")
    lone = counts.select(F.col("a").alias("id")).join(kept.select("id").hint("merge"), "id", "left_anti")
    heads = stored(kept.unionByName(lone.select(F.col("id").alias("group_id"), "id")), "heads")
    follow = with_one(stored(copies, "copies"), heads.withColumnRenamed("id", "a").join(counts.hint("merge"), "a"), ["a"])
    return heads.unionByName(follow.select("group_id", F.col("b").alias("id")))


def bitrate(size: Column, duration: Column) -> Column:
    return F.when(duration > 0, size / duration).otherwise(0.0)


def retention(members: DataFrame, strategy: str = "max_size") -> DataFrame:
    """``members`` (with size, mtime, width, height, duration) with ``retained`` and ``rank``: the kept one first, then by
    size, then by id. A group's best is found by a partial maximum, so no group is gathered for it."""
    metric = {
        "max_size": F.col("size").cast("double"),
        "latest": F.col("mtime"),
        "max_res": (F.col("width") * F.col("height")).cast("double"),
        "max_bitrate": bitrate(F.col("size"), F.col("duration")),
    }[strategy]
    members = stored(members, "members")
    best = members.groupBy("group_id").agg(F.max(F.struct(metric.alias("metric"), (-F.col("id")).alias("id"))).alias("best"), F.count(F.lit(1)).alias("n")).select("group_id", (-F.col("best.id")).alias("_kept"), "n")
    marked = with_one(members, stored(best, "kept"), ["group_id"]).withColumn("retained", F.col("id") == F.col("_kept")).drop("_kept")
    return ranked(marked, "group_id", [F.desc("retained"), F.desc("size"), F.asc("id")])


def ranked(rows: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their rank as ``name``, from 1 within each group in that order, however many rows a group has.

    Rows are dealt to ranges of (group, order), so a large group lies in several tasks; each ranks its own part, and the
    parts' sizes, one row a task and group, give where it begins.
    """
    dealt = stored(rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select(group, "_part", before.alias("_before"))
    inside = dealt.withColumn("_inside", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    return inside.join(begins.hint("merge"), [group, "_part"]).withColumn(name, (F.col("_inside") + F.col("_before")).cast("long")).drop("_part", "_inside", "_before")


def group_similarity(links: DataFrame, members: DataFrame, min_sim: float = 0.0) -> DataFrame:
    """(group_id, max_similarity) of the groups that reach ``min_sim``; 1.0 for a group without a stored pair. Links are reduced to one for each
    first item before they meet the members, however many a star has."""
    most = links.groupBy("a").agg(F.max("similarity").alias("s"))
    of = most.join(members.select(F.col("id").alias("a"), "group_id").hint("merge"), "a").groupBy("group_id").agg(F.max("s").alias("s"))
    every = members.select("group_id").distinct().join(of.hint("merge"), "group_id", "left").select("group_id", F.coalesce("s", F.lit(1.0)).alias("max_similarity"))
    return every if min_sim <= 0 else every.where(F.col("max_similarity") >= min_sim)


def similarity_level(s: Column) -> Column:
    return F.when(s >= 0.98, "exact_or_reencoded").when(s >= 0.85, "highly_similar").when(s >= 0.70, "possibly_similar").otherwise("weak_match")


def mixed_labels(members: DataFrame, pattern: str) -> DataFrame:
    """(group_id, labels, mixed): labels by a regular expression on names, group 1."""
    label = F.regexp_extract("name", pattern, 1)
    labels = F.array_sort(F.collect_set(F.when(label != "", label)))
    return members.groupBy("group_id").agg(labels.alias("labels")).withColumn("mixed", F.size("labels") > 1)


def space_report(members: DataFrame) -> DataFrame:
    """(group_id, n, total, keep, wasted, priority): what stays is the largest of each group."""
    gib, mib100 = 1 << 30, 100 << 20
    g = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("size").alias("keep"))
    wasted = F.col("total") - F.col("keep")
    return g.withColumn("wasted", wasted).withColumn("priority", F.when(wasted >= gib, "high").when(wasted >= mib100, "mid").otherwise("low"))


def reclaimable(marked: DataFrame) -> DataFrame:
    """One row: bytes of the members that are not kept."""
    return marked.agg(F.coalesce(F.sum(F.when(~F.col("retained"), F.col("size"))), F.lit(0)).alias("reclaimable_bytes"))
