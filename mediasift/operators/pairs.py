"""Candidate pairs and their similarity (ids a < b throughout)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions import hashes as H
from mediasift.operators import blocks as B
from mediasift.operators.joins import with_one
from mediasift.sources.shared import stored

def _both(left: DataFrame, right: DataFrame, on: Column, strategy: str = "merge") -> DataFrame:
    """Sizes after an explode are guesses, so the strategy is set."""
    return left.alias("a").join(right.alias("b").hint(strategy), on)


def _sides(joined: DataFrame, columns: list[str]) -> DataFrame:
    return joined.select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}" if c != "id" else s) for s in "ab" for c in columns])


def all_pairs(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(a_*, b_*) of each query row with each item of a larger id: for a stated query set, or at most a few items."""
    return _sides(_both(queries, items, F.col("a.id") < F.col("b.id"), "shuffle_replicate_nl"), queries.columns)


def _banded(items: DataFrame, bucket_count: int | None, hash_list: str) -> DataFrame:
    """``items`` with their band keys as ``_keys``, null without a hash."""
    return items.withColumn("_keys", F.when(F.coalesce(F.size(hash_list), F.lit(0)) > 0, H.band_keys(F.get(hash_list, 0), bucket_count)))


def lsh_candidates(items: DataFrame, bucket_count: int | None = None, hash_list: str = "phash") -> DataFrame:
    """(a_*, b_*) of the items whose first hash agrees in a band, once for each pair (in its lowest common band).

    Candidates alone: what is alike beyond a band's bits is not among them (:func:`recall` measures how much), and no
    similarity is worked out. Items without a hash have nothing to be compared by: they are no pairs of each other, but a star, the first of
    them with each of the others. ``bucket_count`` folds bands to so many
    values; None keeps their 16 bits. Ids and bands meet first, the other columns are fetched for the pairs.
    """
    keyed = stored(_banded(items, bucket_count, hash_list).select("id", "_keys"), "band-keys")
    bare = keyed.where("_keys is null").select("id")
    star = bare.crossJoin(F.broadcast(bare.agg(F.min("id").alias("a")))).where("a < id").select("a", F.col("id").alias("b"))  # by one row
    banded = keyed.select("*", F.posexplode("_keys").alias("_band", "_key"))
    same = (F.col("a._band") == F.col("b._band")) & (F.col("a._key") == F.col("b._key")) & (F.col("a.id") < F.col("b.id"))
    lowest = F.array_position(F.zip_with("a._keys", "b._keys", lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(True)) == F.col("a._band") + 1
    found = _both(banded, banded, same & lowest).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).unionByName(star)
    rest = [c for c in items.columns if c != "id"]
    for side in "ab" if rest else "":
        found = found.join(items.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in rest]).hint("merge"), side)
    return found.select("a", *[f"a_{c}" for c in rest], "b", *[f"b_{c}" for c in rest])


#: Items of a block of one key, pairs of small keys that are one cell, and pairs that are looked at at once.
KEY_ITEMS, CELL_PAIRS, CHUNK = 2048, 1 << 22, 1 << 18


def listed(x: dict, y: dict, kind: str) -> np.ndarray:
    """:func:`hashes.list_similarity` of each item with the one at its place in ``y``."""
    n = x[kind][1]
    return np.where((n > 0) & (y[kind][1] > 0), 1 - B.sums_there(x[kind], y[kind]) / (np.maximum(n, 1) * float(H.BITS)), 0.0)


def fitting(x: dict, y: dict, ratio: float = 0.2) -> np.ndarray:
    """:func:`duration_compatible` for each item and the one at its place in ``y``."""
    u, v = x["duration"], y["duration"]
    with np.errstate(all="ignore"):
        return (u <= 0) | (v <= 0) | (np.abs(u - v) / np.maximum(u, v) <= ratio)


def loudly_different(x: dict, y: dict) -> np.ndarray:
    """Whether both have sounds, and these are not alike."""
    return (x["audio"][1] > 0) & (y["audio"][1] > 0) & (listed(x, y, "audio") < H.AUDIO_GATE)


def fused(x: dict, y: dict, weights: tuple[float, float] = (H.P_WEIGHT, H.D_WEIGHT), audio_factor: float = H.AUDIO_FACTOR) -> np.ndarray:
    """:func:`hashes.fused_similarity` of each item with the one at its place in ``y``."""
    (p, d), (has_p, has_d) = ([listed(x, y, c) for c in KINDS], [x[c][1] > 0 for c in KINDS])
    seen = np.where(has_p & has_d, p * weights[0] + d * weights[1], np.where(has_p, p, np.where(has_d, d, 0.0)))
    return np.clip(np.where(loudly_different(x, y), seen * audio_factor, seen), 0.0, 1.0)


def _met(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of a cell that have a key in common, every two of them, some at a time; of a key in blocks, one of each block."""
    side, of = rows["_side"].to_numpy(), rows["_band"].to_numpy().astype(np.int64) << 32 | rows["_key"].to_numpy()
    if (side < 2).any():
        mine, its = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        for part in B.tiles(len(mine), len(its) * B.TILE // CHUNK):
            yield np.repeat(mine[part], len(its)), np.tile(its, part.stop - part.start)
        return
    order = np.argsort(of, kind="stable")
    after = np.searchsorted(of[order], of[order], "right") - np.arange(len(order)) - 1  # of the same key
    task = np.cumsum(after) // CHUNK
    for some in np.split(np.arange(len(order)), np.flatnonzero(np.diff(task)) + 1) if len(order) else ():
        n = after[some]
        i = np.repeat(some, n)
        yield order[i], order[i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]


def lsh_scored(items: DataFrame, score: Callable[[dict, dict], dict[str, np.ndarray]], scores: str, bucket_count: int | None = None) -> DataFrame:
    """(a, b, and what ``score`` gives) of the pairs of :func:`lsh_candidates` of ``items`` (id, phash, dhash, audio, duration).

    Items are dealt out by their keys, and pairs are scored where they meet, many at once; so neither their rows are joined nor a pair
    scored by itself. A key of many items is cut into blocks, and every two of its blocks are a cell; small keys share cells.
    ``score`` takes the items of a and of b, as arrays, and gives the columns of ``scores``.
    """
    names = ("id", "phash", "dhash", "audio", "duration")
    keyed = stored(_banded(items.select(*names), bucket_count, "phash").where("id is not null"), "keyed-items")
    id = keyed.schema["id"].dataType.simpleString()
    banded = keyed.select("*", F.posexplode("_keys").alias("_band", "_key"))
    n = F.count(F.lit(1))
    sizes = stored(banded.groupBy("_band", "_key").agg(n.alias("_n"), F.ceil(n / KEY_ITEMS).cast("int").alias("_blocks")).where("_n > 1"), "key-sizes")
    small = F.when(F.col("_blocks") == 1, F.col("_n"))
    work = sizes.agg(F.sum(F.col("_n").cast("double") ** 2).alias("pairs"), F.sum(small.cast("double") ** 2).alias("few"), F.sum(small).alias("rows")).first()
    shared = int(max((work["few"] or 0) / 2 / CELL_PAIRS, (work["rows"] or 0) / B.MOST_ITEMS)) + 1
    least = B.TASKS_A_CORE * keyed.sparkSession.sparkContext.defaultParallelism
    shared, tasks = max(shared, least), max(least, int((work["pairs"] or 0) / 2 / B.TASK_PAIRS))
    there = banded.join(F.broadcast(sizes), ["_band", "_key"])  # as many as bands have values
    mine = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    copied = there.withColumn("_mine", mine).withColumn("_its", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = F.when(F.col("_mine") == F.col("_its"), 2).otherwise((F.col("_mine") > F.col("_its")).cast("int"))
    own = F.concat_ws(":", "_band", "_key", F.least("_mine", "_its"), F.greatest("_mine", "_its"))
    cell = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("_band", "_key"), F.lit(shared)).cast("string")).otherwise(own)
    cells = copied.select(*names, "_keys", "_band", "_key", side.alias("_side"), cell.alias("_cell")).repartition(tasks, "_cell")

    def columns(rows: pa.Table, prefix: str = "") -> dict:
        return {"id": rows[prefix + "id"].to_numpy(), "duration": rows[prefix + "duration"].to_numpy().astype(float)} | {c: B.padded(rows[prefix + c]) for c in (*KINDS, "audio")}

    def given(x: dict, y: dict, kind: pa.DataType) -> pa.RecordBatch:
        found = score(x, y)
        return pa.RecordBatch.from_arrays([pa.array(x["id"], kind), pa.array(y["id"], kind), *map(pa.array, found.values())], names=["a", "b", *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        all, keys, band = columns(rows), np.stack(rows["_keys"].to_pandas().to_list()), rows["_band"].to_numpy()
        for i, j in _met(rows):
            first = ~((keys[i] == keys[j]) & (np.arange(keys.shape[1]) < band[i][:, None])).any(axis=1)  # in their lowest common band
            i, j = i[first], j[first]
            up, down = (all["id"][i] < all["id"][j]).astype(bool), (all["id"][i] > all["id"][j]).astype(bool)
            a, b = np.where(up, i, j)[up | down], np.where(up, j, i)[up | down]
            if len(a):
                yield given(_taken(all, a), _taken(all, b), rows.schema.field("id").type)

    bare = keyed.where("_keys is null")
    head = bare.orderBy("id").limit(1).select(*[F.col(c).alias(f"a_{c}") for c in names])  # one row
    star = bare.select(*[F.col(c).alias(f"b_{c}") for c in names]).crossJoin(F.broadcast(head)).where("a_id < b_id")

    def run_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            yield given(columns(rows, "a_"), columns(rows, "b_"), rows.schema.field("a_id").type)

    schema = f"a {id}, b {id}, {scores}"
    return cells.groupBy("_cell").applyInArrow(run, schema).unionByName(star.mapInArrow(run_star, schema))


def duration_compatible(pairs: DataFrame, ratio: float = 0.2) -> DataFrame:
    return pairs.where(~H.duration_too_different("a_duration", "b_duration", ratio))


def scored(pairs: DataFrame, weights: tuple[float, float] = (H.P_WEIGHT, H.D_WEIGHT), audio_factor: float = H.AUDIO_FACTOR) -> DataFrame:
    """``pairs`` with ``similarity`` (fused, directional from a to b)."""
    c = F.col
    return pairs.withColumn("similarity", H.fused_similarity(c("a_phash"), c("a_dhash"), c("a_audio"), c("b_phash"), c("b_dhash"), c("b_audio"), weights, audio_factor))


def representatives(items: DataFrame) -> DataFrame:
    """One item (the smallest id) for each distinct signature, with the number of ``copies``."""
    return items.groupBy("phash", "dhash", "audio", "duration").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("id", "phash", "dhash", "audio", "duration", "copies")


KINDS = ("phash", "dhash")
#: Parts that a bit is worth at least, where similarities are screened in 16 bits.
LEAST_PARTS = 32
#: Bands of duration that two items that meet may lie apart: the finer bands are, the fewer pairs meet in vain.
REACH = 2
#: Part of the longer duration that two items may differ by.
RATIO = 0.2


def _similarity(x: dict, y: dict, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Fused similarity without sound of each item with the one at its place in ``y``, from ``x`` to ``y`` and back."""
    sums = {c: B.pair_sums(x[c], y[c]) for c in KINDS}
    out = []
    for side, mine in enumerate((x, y)):  # the hashes of this side look for their nearest on the other
        parts, has = [], []
        for c in KINDS:
            n, full = mine[c][1], (x[c][1] > 0) & (y[c][1] > 0)
            parts.append(np.where(full, 1 - sums[c][side] / (np.maximum(n, 1) * float(H.BITS)), 0.0))
            has.append(n > 0)
        (p, d), (has_p, has_d) = parts, has
        out.append(np.where(has_p & has_d, p * weights[0] + d * weights[1], np.where(has_p, p, np.where(has_d, d, 0.0))))
    return out[0], out[1]


def _quieter(s: np.ndarray, sums: np.ndarray, n: np.ndarray, both: np.ndarray, factor: float) -> np.ndarray:
    """Similarities as the sounds of the items leave them; ``sums`` are the distances of ``n`` hashes, where ``both`` have some."""
    heard = 1 - sums / (np.maximum(n, 1) * float(H.BITS))
    return np.clip(np.where(both & (heard < H.AUDIO_GATE), s * factor, s), 0.0, 1.0)


def _shares(weights: tuple[float, float], has: tuple[bool, bool]) -> list[float]:
    """What each kind of hashes counts for an item that has these kinds."""
    return list(weights) if all(has) else [float(h) for h in has]


def _may_reach(x: dict, y: dict, threshold: float, weights: tuple[float, float], kinds: tuple[tuple[bool, bool], tuple[bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` of the pairs that may reach the threshold from either side: all that do, and hardly any others.
    ``y`` has its hashes ``packed``, too; ``kinds`` tells which kinds of hashes all of ``x``, and all of ``y``, have."""
    both = [p and q for p, q in zip(*kinds, strict=True)]
    sums = [B.least_sums(*x[c], y["packed"][c], y[c][1]) if here else None for c, here in zip(KINDS, both, strict=True)]
    keep = np.zeros((1, 1), bool)
    for side, mine in enumerate((x, y)):
        shares = _shares(weights, kinds[side])
        room = sum(w for w, here in zip(shares, both, strict=True) if here) - threshold + 1e-4
        worth = {c: w / (mine[c][1] * float(H.BITS)) for c, w, here in zip(KINDS, shares, both, strict=True) if here}  # of one bit
        if room < 0 or not worth:
            keep = keep | (room >= 0)
            continue
        # what is lost is summed in whole parts, each a little less than what it stands for
        few = min(w.min() for w in worth.values()) * 60_000 > LEAST_PARTS and all(f[side].dtype == np.uint8 for f in sums if f is not None)
        parts, kind = ((1 << 16) - 1, np.uint16) if few else ((1 << 31) - 1, np.uint32)
        parts = parts / max(1.0, sum(shares))
        lost = None
        for c, found in zip(KINDS, sums, strict=True):
            if found is not None:
                scale = (worth[c] * parts).astype(kind)
                if (scale == scale[0]).all():
                    scale = scale[0]
                else:
                    scale = scale[:, None] if side == 0 else scale[B.unpacked(np.arange(found[side].shape[1]))[0].clip(max=len(scale) - 1)]
                less = np.multiply(found[side], scale, dtype=kind)
                lost = less if lost is None else np.add(lost, less, out=lost)
        keep = keep | (lost <= min(math.ceil(room * parts), np.iinfo(lost.dtype).max))
    width = -(-len(y["id"]) // B.PER) * (B.PER + 1)
    i, j = np.divmod(np.flatnonzero(np.broadcast_to(keep, (len(x["id"]), width))), width)
    j, real = B.unpacked(j)
    real &= j < len(y["id"])
    return i[real], j[real]


def _taken(items: dict, at) -> dict:
    return {c: (v[0][at], v[1][at]) if isinstance(v, tuple) else v[at] for c, v in items.items()}


def _in_order(rows: pa.Table | pd.DataFrame) -> dict:
    """Columns as arrays, in order of duration."""
    seconds = np.nan_to_num(rows["duration"].to_numpy().astype(float))
    items = {"id": rows["id"].to_numpy(), "duration": seconds} | {c: B.padded(rows[c]) for c in (*KINDS, "audio")}
    return _taken(items, np.argsort(seconds, kind="stable"))


def _kinds(items: dict) -> list[tuple[tuple[bool, bool], dict]]:
    """Items by the kinds of hashes that they have."""
    p, d = (items[c][1] > 0 for c in KINDS)
    return [((h, g), _taken(items, at)) for h in (True, False) for g in (True, False) if len(at := np.flatnonzero((p == h) & (d == g)))]


def _within(x: dict, y: dict, ratio: float) -> tuple[int, int]:
    """The part of ``x`` that holds all items whose duration may fit one of ``y``; both in order of duration."""
    u, v = x["duration"], y["duration"]
    if u[0] <= 0 or v[0] <= 0 or not 0 <= ratio < 1:
        return 0, len(u)
    some = 1 + 1e-9
    return int(np.searchsorted(u, v[0] * (1 - ratio) / some)), int(np.searchsorted(u, v[-1] / (1 - ratio) * some, "right"))


def _reaching(threshold: float, weights: tuple[float, float], audio_factor: float, ratio: float, both: bool = False) -> Callable[[pa.Table | pd.DataFrame], Iterator[list[np.ndarray]]]:
    """What gives the pairs of a cell as (a, b, similarity, similarity from b to a), a tile at a time."""

    def exact(x: dict, y: dict) -> list[np.ndarray]:
        a, b, u, v = x["id"], y["id"], x["duration"], y["duration"]
        there, back = _similarity(x, y, weights)
        heard, sound = B.pair_sums(x["audio"], y["audio"]), (x["audio"][1] > 0) & (y["audio"][1] > 0)
        there, back = (_quieter(s, heard[k], z["audio"][1], sound, audio_factor) for k, (s, z) in enumerate(((there, x), (back, y))))
        up = (a < b).astype(bool)
        apart = (u > 0) & (v > 0) & (np.abs(u - v) / np.maximum(np.maximum(u, v), 1e-300) > ratio)
        first, other = np.where(up, there, back), np.where(up, back, there)
        keep = ~apart & ((first >= threshold) | (both & (other >= threshold)))
        return [np.where(up, a, b)[keep], np.where(up, b, a)[keep], first[keep], other[keep]]

    def run(rows: pa.Table | pd.DataFrame) -> Iterator[list[np.ndarray]]:
        x, y, same = B.sides(rows)
        x = _kinds(_in_order(x))
        y = x if same else _kinds(_in_order(y))
        for k, (has, mine) in enumerate(x):
            for its, theirs in y[k:] if same else y:
                for cut in range(0, len(theirs["id"]), B.COLUMNS):
                    some = _taken(theirs, slice(cut, cut + B.COLUMNS))
                    columns = some | {"packed": {c: [B.packed(h) for h in some[c][0].T] for c in KINDS}}
                    first, end = _within(mine, some, ratio)
                    alone = same and mine is theirs
                    for at in range(first, min(end, cut + B.COLUMNS) if alone else end, B.ROWS):
                        part = _taken(mine, slice(at, min(end, at + B.ROWS)))
                        i, j = _may_reach(part, columns, threshold, weights, (has, its))
                        if alone:
                            i, j = i[at + i < cut + j], j[at + i < cut + j]
                        if len(i):
                            yield exact(_taken(part, i), _taken(some, j))

    return run


def _compare(threshold: float, weights: tuple[float, float], audio_factor: float, ratio: float, both: bool = False):
    reaching = _reaching(threshold, weights, audio_factor, ratio, both)

    def run(rows: pa.Table | pd.DataFrame) -> pd.DataFrame:
        names, out = ("a", "b", "similarity", "back"), list(reaching(rows))
        found = pd.DataFrame({c: np.concatenate(v) for c, v in zip(names, zip(*out, strict=True), strict=True)} if out else {c: [] for c in names})
        return found if both else found.drop(columns="back")

    return run


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (of each place the first of those it is joined to) with ``a`` and ``b`` joined, too."""
    while True:
        u, v = label[a], label[b]
        apart = u != v
        if not apart.any():
            return label
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]


def _together(found: Iterator[list[np.ndarray]], n: int) -> Iterator[list[np.ndarray]]:
    """The first three columns of ``found``, about ``n`` rows at a time."""
    held: list = []
    for some in found:
        held.append(some[:3])
        if sum(len(h[0]) for h in held) >= n:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _spanned(ids: np.ndarray, found: Iterator[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity): from the first of each group that pairs (a, b, similarity, _) of ``ids`` make to each other one, with the greatest
    similarity in the group."""
    ids = np.unique(ids)
    label, most = np.arange(len(ids)), np.full(len(ids), -1.0)
    for a, b, s in _together(found, max(len(ids), B.TILE >> 6)):
        i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
        np.maximum.at(most, label[i], s)
        label = _joined(label, i, j)
        np.maximum.at(most, label, most.copy())
    others = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[others]], ids[others], most[label[others]]


def _bands(ratio: float) -> Column:
    """Logarithmic bands of duration: those that fit lie ``REACH`` bands apart at most. None if the duration is unknown."""
    known = (F.col("duration") > 0) & (F.col("duration") < float("inf"))
    return F.when(known, F.floor(F.log("duration") * F.lit(REACH / -math.log(1 - ratio))).cast("int"))


def _all_scores(x: dict, y: dict, weights: tuple[float, float], audio_factor: float, ratio: float) -> Iterator[list[np.ndarray]]:
    """(a, b, similarity) of every ``x`` with every ``y`` of a larger id, a tile at a time."""
    width = max(B.COLUMNS, B.ROWS * B.COLUMNS // max(1, len(x["id"])))
    for cut in range(0, len(y["id"]), width):
        some = _taken(y, slice(cut, cut + width))
        columns = {c: [B.packed(h) for h in some[c][0].T] for c in KINDS}
        for at in range(0, len(x["id"]), B.ROWS):
            part = _taken(x, slice(at, at + B.ROWS))
            u, v = part["duration"][:, None], some["duration"][None]
            with np.errstate(all="ignore"):
                fits = (u <= 0) | (v <= 0) | (np.abs(u - v) / np.maximum(u, v) <= ratio)  # not those without a duration, unless the other's is 0
            fits &= (part["id"][:, None] < some["id"][None]).astype(bool)
            rows = np.flatnonzero(fits.any(axis=1))
            if not len(rows):
                continue
            part, (i, j) = _taken(part, rows), np.nonzero(fits[rows])
            p, d = (1 - B.sums_to(*part[c], columns[c], len(some["id"]))[i, j] / (np.maximum(part[c][1], 1) * float(H.BITS))[i] for c in KINDS)
            (has_p, full_p), (has_d, full_d) = ((part[c][1][i] > 0, some[c][1][j] > 0) for c in KINDS)
            p, d = np.where(has_p & full_p, p, 0.0), np.where(has_d & full_d, d, 0.0)
            seen = np.where(has_p & has_d, p * weights[0] + d * weights[1], np.where(has_p, p, np.where(has_d, d, 0.0)))
            loud = np.flatnonzero((part["audio"][1][i] > 0) & (some["audio"][1][j] > 0))
            mine, its = (tuple(v[at[loud]] for v in z["audio"]) for z, at in ((part, i), (some, j)))
            seen[loud] = _quieter(seen[loud], B.pair_sums(mine, its)[0], mine[1], np.ones(len(loud), bool), audio_factor)
            yield [part["id"][i], some["id"][j], np.clip(seen, 0.0, 1.0)]


def asked_pairs(items: DataFrame, asked: Column, weights: tuple[float, float] = (H.P_WEIGHT, H.D_WEIGHT), audio_factor: float = H.AUDIO_FACTOR, ratio: float = 0.2) -> DataFrame:
    """(a, b, similarity) of each of ``items`` (id, phash, dhash, audio, duration) that is ``asked`` for with each one of a larger id
    whose duration may fit: the rows of :func:`all_pairs`, :func:`duration_compatible` and :func:`scored`, worked out where blocks meet.

    All these pairs are rows of the result. A task gives them a tile at a time, and never holds those of two blocks.
    """
    rows = items.where("id is not null").select("id", "phash", "dhash", "audio", "duration", F.coalesce(asked, F.lit(False)).alias("asked"))
    kind = rows.schema["id"].dataType.simpleString()
    cells = B.in_cells(rows, _bands(ratio), F.col("asked"), reach=REACH)

    def columns(rows: pa.Table) -> dict:
        seconds = rows["duration"].to_numpy().astype(float)
        found = {"id": rows["id"].to_numpy(), "duration": seconds} | {c: B.padded(rows[c]) for c in (*KINDS, "audio")}
        return _taken(found, np.argsort(seconds, kind="stable"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        id = rows.schema.field("id").type
        x, y, same = B.sides(rows)
        for one, other in ((x, y),) if same else ((x, y), (y, x)):
            one = one.filter(one["asked"])
            if len(one) and len(other):
                for a, b, s in _all_scores(columns(one), columns(other), weights, audio_factor, ratio):
                    yield pa.RecordBatch.from_arrays([pa.array(a, id), pa.array(b, id), pa.array(s)], names=["a", "b", "similarity"])

    return cells.groupBy("cell").applyInArrow(run, f"a {kind}, b {kind}, similarity double")


def pairs_above(items: DataFrame, threshold: float = 0.7, fresh: Column | None = None, weights: tuple[float, float] = (H.P_WEIGHT, H.D_WEIGHT), audio_factor: float = H.AUDIO_FACTOR, ratio: float = 0.2, both: bool = False) -> DataFrame:
    """(a, b, similarity) of all pairs of ``items`` (id, phash, dhash, audio, duration) at or above the threshold; with ``both``, those
    that reach it from either side, and ``back``, the similarity from b to a.

    At 0.7 two lists may differ in 19 of 64 bits, which no index of hashes prunes without losing pairs; so all pairs are
    compared, in blocks. Only items whose durations can fit meet (logarithmic bands; unknown durations meet all). With
    ``fresh`` only pairs with such an item. Ids are distinct; a null list is as an empty one.
    """
    rows = items.select("id", "phash", "dhash", "audio", "duration", (F.lit(True) if fresh is None else fresh).alias("fresh"))
    kind = items.schema["id"].dataType.simpleString()
    cells = B.in_cells(rows, _bands(ratio), F.col("fresh"), reach=REACH)
    compare = _compare(threshold, weights, audio_factor, ratio, both)

    def run(rows: pa.Table) -> pa.Table:
        """Items are copied to many cells, so their lists stay in Arrow, without an object for each."""
        found, id = compare(rows), rows.schema.field("id").type
        return pa.Table.from_arrays([pa.array(found[c], t) for c, t in zip(found, (id, id, pa.float64(), pa.float64()), strict=False)], names=list(found))

    return cells.groupBy("cell").applyInArrow(run, f"a {kind}, b {kind}, similarity double" + ", back double" * both)


def group_links(items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity): links that make the same groups as :func:`similar_pairs`, with the same greatest similarity in each, but no more than one
    for each item of a cell. Pairs are compared as there, and joined up where they are found, so the square of a group never leaves its task."""
    rows = representatives(items).drop("copies").select("id", "phash", "dhash", "audio", "duration")
    kind = rows.schema["id"].dataType.simpleString()
    reaching = _reaching(threshold, (H.P_WEIGHT, H.D_WEIGHT), H.AUDIO_FACTOR, RATIO)

    def run(rows: pa.Table) -> pa.Table:
        id = rows.schema.field("id").type
        found = _spanned(rows["id"].to_numpy(), reaching(rows))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(found, (id, id, pa.float64()), strict=True)], names=["a", "b", "similarity"])

    return B.in_cells(rows, _bands(RATIO), reach=REACH).groupBy("cell").applyInArrow(run, f"a {kind}, b {kind}, similarity double")


def similar_pairs(items: DataFrame, threshold: float = 0.7, skip: DataFrame | None = None) -> DataFrame:
    """(a, b, distance, similarity) of the pairs of distinct signatures at or above the threshold, none left out; items
    with equal signatures are represented by their smallest id (see :func:`copy_links` for their links)."""
    found = pairs_above(representatives(items).drop("copies"), threshold)
    found = found if skip is None else unskipped(found, skip)
    return found.select("a", "b", (1 - F.col("similarity")).alias("distance"), "similarity")


def unskipped(found: DataFrame, skip: DataFrame) -> DataFrame:
    """The pairs ``found`` that are not among those to ``skip`` (a, b)."""
    return found.join(skip.select("a", "b").hint("merge"), ["a", "b"], "left_anti")


def recall(items: DataFrame, threshold: float = 0.7, bucket_count: int | None = None, every: int = 100) -> DataFrame:
    """One row (pairs, found): of the pairs at or above the threshold with an item whose id is divisible by ``every``, how
    many there are and how many of them the bands have as candidates."""
    reps = stored(representatives(items).drop("copies"), "representatives")
    asked = (F.col("id") % every == 0).alias("asked")
    true = pairs_above(reps, threshold, fresh=asked).where(f"a % {every} = 0 or b % {every} = 0")
    keys = stored(_banded(reps, bucket_count, "phash").select("id", "_keys"), "band-keys")
    first = keys.where("_keys is null").agg(F.min("id").alias("bare"))  # one row
    found = stored(true.select("a", "b"), "true-pairs")
    for side in "ab":
        often = found.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
        one = keys.select(F.col("id").alias(side), F.col("_keys").alias(f"keys_{side}")).join(often.hint("merge"), side)
        found = with_one(found, stored(one, "keys-of-side"), [side])
        found = stored(found, "pairs-with-keys") if side == "a" else found
    share = F.exists(F.zip_with("keys_a", "keys_b", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same)
    star = F.col("keys_a").isNull() & F.col("keys_b").isNull() & (F.col("a") == F.col("bare"))
    met = F.when(F.coalesce(share, F.lit(False)) | star, 1)
    return found.crossJoin(F.broadcast(first)).agg(F.count(F.lit(1)).alias("pairs"), F.count(met).alias("found"))


def copy_links(items: DataFrame) -> DataFrame:
    """(a, b) from the representative of each signature to every other item that has it: a star, not all pairs."""
    signed = stored(items.where("coalesce(size(phash), 0) + coalesce(size(dhash), 0) > 0").select("id", F.struct("phash", "dhash", "audio", "duration").alias("sig")), "signed")
    heads = stored(signed.groupBy("sig").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    return with_one(signed, heads, ["sig"]).where("a < id").select("a", F.col("id").alias("b"))


def metadata_candidates(files: DataFrame) -> DataFrame:
    """(a, b) from the first file (smallest id) of equal size and whole-second time to each other one: a star for each group."""
    keyed = stored(files.select("id", "size", F.bround("mtime", 0).alias("second")), "sizes-and-times")
    heads = stored(keyed.groupBy("size", "second").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
    return with_one(keyed, heads, ["size", "second"]).where("a < id").select("a", F.col("id").alias("b"))


def candidate_statistics(items: DataFrame, bucket_count: int | None = 32) -> DataFrame:
    """One row: items, all pairs, pairs that share a band (pair counts come from bucket sizes and band patterns alone).

    By inclusion and exclusion over the four bands, so no pair is ever made.
    """
    from itertools import combinations

    keyed = stored(items.where(F.size("phash") > 0).select(H.band_keys(F.get("phash", 0), bucket_count).alias("k")), "band-keys")
    total = keyed.agg(F.count(F.lit(1)).alias("n")).select("n", F.expr("cast(n * (n - 1) / 2 as bigint)").alias("all_pairs"))
    counts = None
    for r in range(1, H.BANDS + 1):
        for bands in combinations(range(H.BANDS), r):
            sizes = keyed.groupBy(*[F.get("k", b).alias(f"k{b}") for b in bands]).agg(F.count(F.lit(1)).alias("c"))
            part = sizes.agg(F.sum(F.expr(f"cast({1 if r % 2 else -1} * (c * (c - 1) / 2) as bigint)")).alias("p"))
            counts = part if counts is None else counts.union(part)
    return total.crossJoin(counts.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("candidate_pairs")))  # one row by one row
