"""Alignment of similar segments between two items."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from mediasift.functions.hashes import BITS
from mediasift.operators.blocks import TASKS_A_CORE
from mediasift.operators.groups import ranked
from mediasift.operators.joins import with_one
from mediasift.sources.shared import stored

#: Seconds of a block of an item.
BLOCK_SECONDS = 4096
#: Pairs that a cell holds on average at most and, while there are few cells, at least; seconds of one side of it; distances that are held at once.
CELL_PAIRS, LEAST_PAIRS, CELL_SECONDS, CHUNK = 1 << 19, 1 << 12, 1 << 22, 1 << 18
#: Distances of a pair that is looked at by itself.
ALONE = 1 << 13
#: Bits of a place in a block, behind those of the distance.
PLACE = 40


def _chunks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Places of pairs that are looked at together, or of one that is ``ALONE``."""
    few = np.flatnonzero(sizes < ALONE)
    task = np.cumsum(sizes[few]) // CHUNK
    yield from (part for part in np.split(few, np.flatnonzero(np.diff(task)) + 1) if len(part))
    yield from np.flatnonzero(sizes >= ALONE)[:, None]


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1``, ... of each, ``n`` of them."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _least(x: dict, y: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which pair, place of the second of a, distance, place of the second of b), one row for each second of the items ``i`` of ``x``: the
    first of the most similar seconds of the items ``j`` of ``y``."""
    na, nb = x["n"][i], y["n"][j]
    mine, pair = _spread(x["start"][i], na), np.repeat(np.arange(len(i)), na)
    if len(i) == 1:
        h, its = x["h"][mine], y["h"][y["start"][j[0]] : y["start"][j[0]] + nb[0]]
        step = max(1, CHUNK // len(its))
        parts = [np.bitwise_count(h[k : k + step, None] ^ its) for k in range(0, len(h), step)]
        place = np.concatenate([d.argmin(axis=1) for d in parts])
        return pair, mine, np.concatenate([d.min(axis=1) for d in parts]).astype(np.int64), place + y["start"][j[0]]
    width = nb[pair]
    its = _spread(y["start"][j][pair], width)
    far = np.bitwise_count(np.repeat(x["h"][mine], width) ^ y["h"][its]).astype(np.int64) << PLACE | its
    best = np.minimum.reduceat(far, np.cumsum(width) - width)
    return pair, mine, best >> PLACE, best & (1 << PLACE) - 1


def _places(ids: np.ndarray, blocks: np.ndarray, id: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Where each (``id``, ``block``) is among (``ids``, ``blocks``); -1 if it is not."""
    if not len(ids):
        return np.full(len(id), -1)
    names, width = np.unique(ids), int(max(blocks.max(), block.max(initial=0))) + 1
    at = np.searchsorted(names, id).clip(max=len(names) - 1)
    key, asked = np.searchsorted(names, ids) * width + blocks, at * width + block
    order = np.argsort(key)
    found = order[np.searchsorted(key[order], asked).clip(max=len(key) - 1)]
    return np.where((names[at] == id) & (key[found] == asked), found, -1)


def _items(rows: pa.Table) -> dict:
    """Items of a block, with their seconds one after the other."""
    t, h = (rows[c].combine_chunks() for c in ("t", "h"))
    n = t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return {"n": n, "start": np.cumsum(n) - n, "t": t.flatten().to_numpy(zero_copy_only=False), "h": h.flatten().to_numpy().view(np.uint64)}


def _matched(rows: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, t1, gap, t2) of the pairs of a cell, some pairs at a time, each whole, in order of its seconds."""
    side = rows["side"].to_numpy()
    x, y, pairs = (rows.filter(pa.array(side == k)) for k in range(3))
    i, j = (_places(*(z[c].to_numpy() for z in (here, pairs) for c in (id, block))) for here, id, block in ((x, "a", "block_a"), (y, "b", "block_b")))
    there = (i >= 0) & (j >= 0)
    i, j, a, b = i[there], j[there], pairs["a"].to_numpy()[there], pairs["b"].to_numpy()[there]
    x, y = _items(x), _items(y)
    sizes = x["n"][i] * y["n"][j]
    for cut in _chunks(sizes):
        pair, mine, gap, its = _least(x, y, i[cut], j[cut])
        t1 = x["t"][mine]
        first = np.flatnonzero(np.append(True, (np.diff(pair) != 0) | (t1[1:] != t1[:-1])))
        if len(first) < len(t1):  # a second with more than one hash
            best = np.minimum.reduceat(gap << PLACE | its, first)
            pair, t1, gap, its = pair[first], t1[first], best >> PLACE, best & (1 << PLACE) - 1
        yield a[cut][pair], b[cut][pair], t1, gap, y["t"][its], pair


def _in_blocks(samples: DataFrame, block: int) -> DataFrame:
    """(id, block, t, h, blocks): the seconds of each item in order, in blocks of at most so many; blocks are counted from 0."""
    samples = samples.where("id is not null").select("id", "t", "h")
    n, seconds = F.count(F.lit(1)), F.array_sort(F.collect_list(F.struct("t", "h"))).alias("l")
    of = stored(samples.groupBy("id").agg(n.alias("n"), F.ceil(n / block).cast("int").alias("blocks")).where("blocks > 1"), "long-items")
    long = not of.isEmpty()
    short = samples.join(of.select("id").hint("merge"), "id", "left_anti") if long else samples
    lists = short.groupBy("id").agg(seconds).select("id", F.lit(0).alias("block"), "l", F.lit(1).alias("blocks"))
    if long:
        numbered = ranked(with_one(samples, of, ["id"]), "id", [F.asc("t"), F.asc("h")], "k")
        parts = numbered.groupBy("id", F.floor((F.col("k") - 1) / block).cast("int").alias("block")).agg(seconds, F.first("blocks").alias("blocks"))
        lists = lists.unionByName(parts.select(*lists.columns))
    return stored(lists.select("id", "block", "l.t", "l.h", "blocks"), "seconds-in-blocks")


def _met(cells: DataFrame, lists: DataFrame, run: Callable[[pa.Table], Iterator[list]], schema: StructType) -> DataFrame:
    """What ``run`` gives for the pairs of blocks ``cells`` (a, block_a, b, block_b), many at once.

    Blocks are dealt to groups, and every two groups are a cell. So a block is copied to the cells of its group and not to its pairs, and
    one in very many pairs is no hot key."""
    n, seconds = cells.count(), lists.agg(F.sum(F.size("t"))).first()[0] or 0
    cores = cells.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(max(n / CELL_PAIRS, min(TASKS_A_CORE * cores, n / LEAST_PAIRS)) ** 0.5), math.ceil(seconds / CELL_SECONDS))
    group = lambda id, block: F.pmod(F.xxhash64(id, block), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    null = lambda like, c: F.lit(None).cast(like.schema[c].dataType).alias(c)
    sides = [cells.select((group("a", "block_a") * groups + group("b", "block_b")).alias("cell"), F.lit(2).alias("side"), "a", "block_a", "b", "block_b", *[F.array().cast(lists.schema[c].dataType).alias(c) for c in "th"])]  # Spark takes long over many null lists
    for side, (mine, other) in enumerate(("ab", "ba")):
        there = lists.select("*", group("id", "block").alias("group"), every.alias("each"))
        cell = F.col("group") * groups + F.col("each") if side == 0 else F.col("each") * groups + F.col("group")
        sides.append(there.select(cell.alias("cell"), F.lit(side).alias("side"), F.col("id").alias(mine), F.col("block").alias(f"block_{mine}"), null(cells, other), null(cells, f"block_{other}"), "t", "h"))
    rows = reduce(DataFrame.unionByName, sides).repartition(groups * groups, "cell")
    arrow = to_arrow_schema(schema)

    def of_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(pa.Table.from_batches(list(batches))):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.groupBy("cell").applyInArrow(of_cell, schema)


def _cells(pairs: DataFrame, lists: DataFrame) -> tuple[DataFrame, bool]:
    """(every block of a with every block of b, for distinct ``pairs``, with how many blocks each has; whether any item has more than one)."""
    wanted = stored(pairs.where("a is not null and b is not null").select("a", "b").distinct(), "pairs")
    if lists.where("blocks > 1").isEmpty():
        one, none = F.lit(1), F.lit(0)
        return wanted.select("a", none.alias("block_a"), "b", none.alias("block_b"), one.alias("blocks_a"), one.alias("blocks_b")), False
    counts, cells = stored(lists.where("block = 0").select("id", "blocks"), "blocks-of-items"), wanted
    for side in "ab":  # how many blocks each item has, around those in very many pairs
        often = wanted.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        one = counts.select(F.col("id").alias(side), F.col("blocks").alias(f"blocks_{side}")).join(often.hint("merge"), side)
        cells = stored(with_one(cells, stored(one, "blocks-of-side"), [side]), "pairs-with-blocks")
    for side in "ab":
        cells = cells.withColumn(f"block_{side}", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{side}") - 1)))
    return stored(cells, "cells"), True


def best_matches(pairs: DataFrame, samples: DataFrame, block: int = BLOCK_SECONDS) -> DataFrame:
    """(a, b, t1, t2, sim): for each second of a, the most similar second of b (the first on ties). ``samples`` (id, t, h).

    Items lie in blocks of at most ``block`` seconds (by rank within the item), and each block of a meets each block of b, so an item may be
    as long as it likes; the best of all blocks is found by a partial minimum, where there is more than one.
    """
    lists = _in_blocks(samples, block)
    return _best(*_cells(pairs, lists), lists)


def _best(cells: DataFrame, long: bool, lists: DataFrame) -> DataFrame:
    time = lists.schema["t"].dataType.elementType
    schema = StructType([*(StructField(c, cells.schema[c].dataType) for c in "ab"), StructField("t1", time), StructField("gap", IntegerType()), StructField("t2", time)])
    run = lambda rows: ([a, b, t1, gap, t2] for a, b, t1, gap, t2, _ in _matched(rows))
    met = lambda cells: _met(cells.select("a", "block_a", "b", "block_b"), lists, run, schema)
    found = met(cells.where("blocks_a = 1 and blocks_b = 1") if long else cells)
    if long:
        parts = met(cells.where("blocks_a > 1 or blocks_b > 1")).groupBy("a", "b", "t1").agg(F.min(F.struct("gap", "t2")).alias("m"))
        found = found.unionByName(parts.select("a", "b", "t1", "m.gap", "m.t2"))
    return found.select("a", "b", "t1", "t2", (1 - F.col("gap") / F.lit(float(BITS))).alias("sim"))


def _runs(rows: pa.Table, threshold: float) -> Iterator[list]:
    """:func:`similar_intervals` of the pairs of a cell."""
    for a, b, t1, gap, t2, pair in _matched(rows):
        sim = 1 - gap / float(BITS)
        at = np.flatnonzero(sim >= threshold)
        if len(at):
            first = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(pair[at]) != 0)))
            last = np.append(first[1:], len(at)) - 1
            i, j, s = at[first], at[last], sim[at]
            yield [a[i], b[i], t1[i], t1[j], t2[i], t2[j], np.minimum.reduceat(s, first), np.maximum.reduceat(s, first), last - first + 1]


def intervals(pairs: DataFrame, samples: DataFrame, threshold: float, block: int = BLOCK_SECONDS) -> DataFrame:
    """:func:`similar_intervals` of :func:`best_matches`, worked out where the items meet; only items of more than one block make a row of each
    second."""
    lists = _in_blocks(samples, block)
    cells, long = _cells(pairs, lists)
    time = lists.schema["t"].dataType.elementType
    schema = StructType([*(StructField(c, cells.schema[c].dataType) for c in "ab"), *(StructField(c, time) for c in ("start_t1", "end_t1", "start_t2", "end_t2")), *(StructField(c, DoubleType()) for c in ("min_sim", "max_sim")), StructField("n", LongType())])
    found = _met((cells.where("blocks_a = 1 and blocks_b = 1") if long else cells).select("a", "block_a", "b", "block_b"), lists, lambda rows: _runs(rows, threshold), schema)
    return found.unionByName(similar_intervals(_best(cells.where("blocks_a > 1 or blocks_b > 1"), True, lists), threshold)) if long else found


def similar_intervals(matches: DataFrame, threshold: float) -> DataFrame:
    """Runs of consecutive samples at or above the threshold: (a, b, start_t1, end_t1, start_t2, end_t2, min_sim, max_sim, n)."""
    w = Window.partitionBy("a", "b").orderBy("t1")
    low = (F.col("sim") < threshold).cast("int")
    runs = matches.withColumn("island", F.sum(low).over(w)).where(F.col("sim") >= threshold)
    return runs.groupBy("a", "b", "island").agg(
        F.min("t1").alias("start_t1"), F.max("t1").alias("end_t1"), F.min_by("t2", "t1").alias("start_t2"), F.max_by("t2", "t1").alias("end_t2"), F.min("sim").alias("min_sim"), F.max("sim").alias("max_sim"), F.count(F.lit(1)).alias("n")
    ).drop("island")
