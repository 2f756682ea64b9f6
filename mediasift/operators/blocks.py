"""All pairs of a table, block against block: work that is defined over every pair and that no index can prune.

Items are dealt into blocks of bounded size, and every two blocks that may hold a pair meet in one task, which looks at the
pairs in numpy and returns what is asked of them. No pair is a row before it is found to count, and no task holds more than
two blocks. The work still grows with the square of what may meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.sources.shared import stored

#: Items of a block: as few as the first while there are few blocks, so that there is work for all tasks; up to the second, so that an item is
#: copied to few cells.
BLOCK_ITEMS, MOST_ITEMS = 2048, 1 << 16
#: Blocks of a band before they grow.
FEW_BLOCKS = 8
#: Pairs that a task looks at on average, as far as there are cells to part, and tasks for each core at least.
TASK_PAIRS, TASKS_A_CORE = 1 << 24, 3
#: Distances held at once.
TILE = 8 << 20
#: Items of a block that are compared at once with so many of the other, so that what is worked on stays in a core's cache.
ROWS, COLUMNS = 256, 768
#: Distances of 64 bits that one 32-bit float holds, as the bytes of its mantissa, and the sum that keeps its exponent the same.
PER, FIXED = 3, 1 << 23


def in_cells(items: DataFrame, band: Column | None = None, fresh: Column | None = None, block_items: int = BLOCK_ITEMS, most_items: int = MOST_ITEMS, *, reach: int = 1) -> DataFrame:
    """``items`` (with ``id``), copied to the cells in which their blocks meet others, with ``cell`` and ``side`` (of the
    cell: 0, 1, or 2 if a block meets itself).

    Items meet whose ``band`` (whole numbers) differ by no more than ``reach``; those without a band meet all. Of the items that are not
    ``fresh`` no two meet. Bands are expected to be few (some thousands), as those of a logarithm are.

    Cells are dealt to as many tasks as their pairs take. Left to itself Spark would deal them by their bytes, which are few
    however long they take, so a handful of tasks would have them all.
    """
    band, fresh = F.lit(None).cast("int") if band is None else band, F.lit(True) if fresh is None else fresh
    dealt = stored(items.select(F.struct(*items.columns).alias("row"), "id", band.alias("band"), fresh.alias("fresh")), "dealt")
    n = F.count(F.lit(1))
    blocks = F.greatest(F.least(F.ceil(n / F.lit(block_items)), F.lit(max(1, FEW_BLOCKS // reach))), F.ceil(n / F.lit(most_items)))
    sizes = stored(dealt.groupBy("band", "fresh").agg(blocks.cast("int").alias("blocks"), n.alias("n")), "block-counts")
    s, t = sizes.alias("s"), sizes.alias("t")
    near = F.col("s.band").isNull() | F.col("t.band").isNull() | (F.abs(F.col("s.band") - F.col("t.band")) <= reach)
    meets = s.join(F.broadcast(t), near & (F.col("s.fresh") | F.col("t.fresh")))  # bands by bands
    meets = stored(meets.select(F.col("s.band").alias("own_band"), F.col("s.fresh").alias("own_fresh"), F.col("s.blocks").alias("own"), (F.col("s.n") * F.col("t.n")).cast("double").alias("pairs"), F.col("t.band").alias("its_band"), F.col("t.fresh").alias("its_fresh"), F.col("t.blocks").alias("its")), "meetings")
    work = meets.agg(F.sum(F.col("own") * F.col("its")).alias("cells"), F.sum("pairs").alias("pairs")).first()  # either way
    least = TASKS_A_CORE * items.sparkSession.sparkContext.defaultParallelism
    tasks = min((work["cells"] or 0) // 2, max(least, int((work["pairs"] or 0) / 2 / TASK_PAIRS))) or 1
    there = dealt.join(F.broadcast(meets.drop("pairs")), F.col("band").eqNullSafe(F.col("own_band")) & (F.col("fresh") == F.col("own_fresh")))
    named = lambda band, fresh, block: F.concat_ws(":", F.coalesce(band.cast("string"), F.lit("any")), fresh.cast("string"), block.cast("string"))
    mine = named(F.col("band"), F.col("fresh"), F.pmod(F.xxhash64("id"), F.col("own")))
    theirs = F.transform(F.sequence(F.lit(0), F.col("its") - 1), lambda k: named(F.col("its_band"), F.col("its_fresh"), k))
    copied = there.select("row", mine.alias("mine"), F.explode(theirs).alias("theirs"))
    side = F.when(F.col("mine") == F.col("theirs"), 2).otherwise((F.col("mine") > F.col("theirs")).cast("int"))
    return copied.select("row.*", F.concat_ws("|", F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("cell"), side.alias("side")).repartition(tasks, "cell")


def sides(rows: pa.Table | pd.DataFrame) -> tuple:
    """(one block, the other, whether they are the same) of a cell."""
    side = np.asarray(rows["side"])
    if (side == 2).any():
        return rows, rows, True
    some = lambda at: rows.filter(pa.array(at)) if isinstance(rows, pa.Table) else rows[at]
    return some(side == 0), some(side == 1), False


def tiles(n: int, width: int):
    """Slices of ``n`` rows of so many distances each."""
    step = max(1, TILE // max(1, width))
    return [slice(k, min(n, k + step)) for k in range(0, n, step)]


def padded(lists: pa.ChunkedArray | pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, one row an item, short lists filled up with their last hash; their sizes), without a step for each item."""
    if isinstance(lists, pd.Series):
        lists = pa.chunked_array([pa.array(lists.to_list(), pa.list_(pa.int64()))])
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(lists).to_numpy()
    width = max(1, size.max(initial=1))
    if (size == width).all():
        return flat.reshape(len(size), width).view(np.uint64), size
    at = (np.cumsum(size) - size)[:, None] + np.minimum(np.arange(width), size[:, None] - 1)
    return np.where(size[:, None] > 0, np.append(flat, 0)[np.where(size[:, None] > 0, at, -1)], 0).view(np.uint64), size


def nearest_sums(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For every two items the sum, over the hashes of the first, of the distance to the nearest of the second; and the reverse."""
    (x, nx), (y, ny) = a, b
    if x.shape[1] == y.shape[1] == 1 and nx.all() and ny.all():  # one hash each
        d = np.bitwise_count(x ^ y.T)
        return d, d
    there, best = np.zeros((len(x), len(y)), np.int64), np.full((len(x), *y.shape), 64, np.uint8)
    for i in range(x.shape[1]):
        d = np.bitwise_count(x[:, i, None, None] ^ y[None])
        there += np.where((i < nx)[:, None], d.min(axis=2), 0)
        np.minimum(best, d, out=best)
    back = np.where(np.arange(y.shape[1]) < ny[:, None], best, 0).sum(axis=2, dtype=np.int64)
    return there, back


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), 8), axis=1).astype(np.float32)


def signs(hashes: np.ndarray) -> np.ndarray:
    """Rows that give, times :func:`packed` columns, distances to them (:func:`distances`)."""
    b = _bits(hashes)
    return np.hstack([1 - 2 * b, b.sum(axis=1, keepdims=True), np.ones((len(b), 1), np.float32)])


def packed(hashes: np.ndarray) -> np.ndarray:
    """Columns of ``PER`` hashes each (zeros at the end), of which each has a byte of a sum to itself."""
    places = np.float32([1 << 8 * k for k in range(PER)])
    b = _bits(np.pad(hashes, (0, -len(hashes) % PER)))
    sums = np.tensordot(b.reshape(-1, PER, b.shape[1]), places, (1, 0))
    return np.ascontiguousarray(np.hstack([sums, np.full((len(sums), 1), places.sum()), np.full((len(sums), 1), FIXED)]).T, np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all :func:`signs` to all :func:`packed` hashes as bytes; behind every ``PER`` of a row is one that means nothing (see
    :func:`unpacked`). All sums are whole numbers below 2^24, so the product is exact."""
    return (a @ b).view(np.uint8)


def unpacked(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the hash, whether there is one) for places in a row of :func:`distances`."""
    return column // (PER + 1) * PER + column % (PER + 1), column % (PER + 1) < PER


def least_sums(x: np.ndarray, nx: np.ndarray, columns: list[np.ndarray], ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`nearest_sums`, but the second comes :func:`packed`, one array for each place of its lists, its items are placed as in
    :func:`distances`, and a distance counts as 63 at most, so these are lower bounds; many times as fast. No list is empty."""
    rows, width = [signs(h) for h in x.T], columns[0].shape[1] * (PER + 1)
    there, back = (np.zeros((len(x), width), np.uint8 if 63 * n < 256 else np.uint32) for n in (len(rows), len(columns)))
    product, mine, best = np.empty((len(x), width // (PER + 1)), np.float32), np.empty((len(x), width), np.uint8), np.full((len(rows), len(x), width), 63, np.uint8)
    d = product.view(np.uint8)
    at = unpacked(np.arange(width))[0].clip(max=len(ny) - 1)
    for j, column in enumerate(columns):
        mine.fill(63)
        for i, row in enumerate(rows):
            np.matmul(row, column, out=product)  # as in distances, without new memory
            np.minimum(best[i], d, out=best[i])
            np.minimum(mine, d, out=mine)
        if ny.min() <= j:
            mine[:, ny[at] <= j] = 0
        back += mine
    for i, least in enumerate(best):
        least[nx <= i] = 0
        there += least
    return there, back


def sums_to(x: np.ndarray, nx: np.ndarray, columns: list[np.ndarray], n: int) -> np.ndarray:
    """The first half of :func:`nearest_sums`, exactly; the second comes :func:`packed`, one array for each place of the lists of its ``n`` items."""
    total = np.zeros((len(x), columns[0].shape[1] * (PER + 1)), np.uint16 if 64 * x.shape[1] < 1 << 16 else np.uint32)
    for i, row in enumerate(map(signs, x.T)):
        least = distances(row, columns[0])
        for column in columns[1:]:
            np.minimum(least, distances(row, column), out=least)
        least[nx <= i] = 0
        total += least
    return total.reshape(len(x), -1, PER + 1)[:, :, :PER].reshape(len(x), -1)[:, :n]


def sums_there(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first half of :func:`pair_sums`, a place of the lists at a time."""
    (x, nx), (y, _) = a, b
    total = np.zeros(len(x), np.int64)
    for i, h in enumerate(x.T):
        least = np.bitwise_count(h ^ y[:, 0])
        for g in y.T[1:]:
            np.minimum(least, np.bitwise_count(h ^ g), out=least)
        total += np.where(i < nx, least, 0)
    return total


def pair_sums(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest_sums` of each item of the first with the one at its place in the second."""
    (x, nx), (y, ny) = a, b
    d = np.bitwise_count(x[:, :, None] ^ y[:, None])
    there = np.where(np.arange(x.shape[1]) < nx[:, None], d.min(axis=2), 0).sum(axis=1, dtype=np.int64)
    return there, np.where(np.arange(y.shape[1]) < ny[:, None], d.min(axis=1), 0).sum(axis=1, dtype=np.int64)
