"""k-means from many starts at once: one pass over the vectors moves the centres of all starts that still move.

Starts are seeded by oversampling (Bahmani et al., 2012): from one vector on, each step takes vectors with a chance that grows
with their squared distance to those taken before, and the centres are chosen among the few candidates by how
many vectors are nearest to each. A pass sums up, in each task, the vectors of every centre of every start; what comes to
the driver is one row for each centre. Starts whose centres would take too much memory together are run in groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the centres of all starts that are run at once; as many of sums are held in a task.
CENTRE_BYTES = 64 << 20
#: Distances held at once, in a core's cache.
TILE = 1 << 18
STEPS, TOLERANCE = 2, 1e-4


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(column) else 0).astype(float)


def _nearest(x: np.ndarray, starts: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, nearest centre, squared distance), the latter two with a column for each start, a tile of rows at a time."""
    every = np.concatenate(starts)
    sizes, ends = (every * every).sum(1), np.cumsum([0, *map(len, starts)])
    doubled, step = -2 * every.T, max(1, TILE // len(every))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        d = part @ doubled
        d += sizes
        near = np.stack([d[:, a:b].argmin(1) for a, b in zip(ends, ends[1:], strict=False)], 1)
        least = np.take_along_axis(d, near + ends[:-1], 1) + (part * part).sum(1)[:, None]
        yield slice(at, at + len(part)), near, np.maximum(least, 0.0)


def _add(total: np.ndarray, near: np.ndarray, x: np.ndarray) -> None:
    """Add each vector to the row of its centre; sorted first, as single additions take many times as long."""
    order = np.argsort(near.astype(np.uint16) if len(total) <= 1 << 16 else near, kind="stable")
    begins = np.flatnonzero(np.diff(near[order], prepend=-1))
    total[near[order][begins]] += np.add.reduceat(x[order], begins, axis=0)


def _sums(vectors: DataFrame, starts: list[np.ndarray], with_vectors: bool = True) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each start: vectors nearest to each centre, their sums, and the cost; one job."""

    def run(batches):
        n = [np.zeros(len(c), np.int64) for c in starts]
        total = [np.zeros_like(c) for c in starts]
        cost = np.zeros(len(starts))
        for batch in batches:
            x = _vectors(batch["emb"])
            for rows, near, d in _nearest(x, starts) if len(x) else ():
                cost += d.sum(0)
                for t in range(len(starts)):
                    n[t] += np.bincount(near[:, t], minlength=len(n[t]))
                    if with_vectors:
                        _add(total[t], near[:, t], x[rows])
        rows = [(t, int(c), int(n[t][c]), total[t][c].tolist()) for t in range(len(starts)) for c in np.flatnonzero(n[t])]
        rows += [(t, -1, 0, [c]) for t, c in enumerate(cost.tolist())]  # the cost beside the centres
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["start", "centre", "n", "sums"])

    parts = vectors.select("emb").mapInArrow(run, "start int, centre int, n long, sums array<double>")
    numbered = parts.select("start", "centre", "n", F.posexplode("sums").alias("dim", "v"))
    rows = numbered.groupBy("start", "centre", "dim").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    rows = rows.groupBy("start", "centre").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("s"))
    n, total, cost = [np.zeros(len(c), np.int64) for c in starts], [np.zeros_like(c) for c in starts], np.zeros(len(starts))
    for r in rows.select("start", "centre", "n", F.col("s.v").alias("s")).collect():
        if r["centre"] < 0:
            cost[r["start"]] = r["s"][0]
        else:
            n[r["start"]][r["centre"]], total[r["start"]][r["centre"]] = r["n"], r["s"]
    return n, total, cost


def _chance(h: np.ndarray, salt: int) -> np.ndarray:
    """Even numbers between 0 and 1 from hashes of ids."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) / float(1 << 64)


def _taken(vectors: DataFrame, starts: list[np.ndarray], cost: np.ndarray, most: float, salt: int) -> list[np.ndarray]:
    """``starts`` with the vectors that a step takes for each, ``most`` on average; one job."""

    def run(batches):
        for batch in batches:
            x, h = _vectors(batch["emb"]), batch["h"].to_numpy()
            for rows, _, d in _nearest(x, starts) if len(x) else ():
                for t in range(len(starts)):
                    hit = np.flatnonzero(_chance(h[rows], salt + t) * cost[t] < most * d[:, t])
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array([t] * len(hit), pa.int32()), pa.array(x[rows][hit].tolist(), pa.list_(pa.float64()))], names=["start", "emb"])

    got = vectors.select("emb", F.xxhash64("id").alias("h")).mapInArrow(run, "start int, emb array<double>").collect()
    more = [[r["emb"] for r in got if r["start"] == t] for t in range(len(starts))]
    return [np.unique(np.concatenate([c, np.array(m)]), axis=0) if m else c for c, m in zip(starts, more, strict=True)]


def _chosen(candidates: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """At most k of the candidates, each with a chance by its weight and its squared distance to those chosen before."""
    picked, far = [int(rng.choice(len(candidates), p=weight / weight.sum()))], None
    while len(picked) < k:
        gap = ((candidates - candidates[picked[-1]]) ** 2).sum(1)
        far = gap if far is None else np.minimum(far, gap)
        chance = far * weight
        if chance.sum() <= 0:
            break
        picked.append(int(rng.choice(len(candidates), p=chance / chance.sum())))
    return candidates[picked]


def best_centres(vectors: DataFrame, k: int, tries: int = 10, seed: int = 42, rounds: int = 300) -> np.ndarray | None:
    """The centres of the start with the least cost; None without vectors. ``vectors`` (id, emb) is a stored table of equally long vectors.

    Fewer than ``k`` centres come out if there are fewer distinct vectors. A start rests when none of its centres moves further than the
    tolerance; a centre that has no vector stays where it is.
    """
    first = vectors.select(F.xxhash64("id").alias("h"), "emb").orderBy("h").limit(tries).collect()
    if not first:
        return None
    width = len(first[0]["emb"])
    at_once = max(1, min(tries, CENTRE_BYTES // (8 * width * k * (1 + 2 * STEPS))))
    best: tuple[float, np.ndarray] | None = None
    for group in range(0, tries, at_once):
        rng = np.random.default_rng(seed + group)
        starts = [np.array([first[t % len(first)]["emb"]], float) for t in range(group, min(tries, group + at_once))]
        for step in range(STEPS):
            cost = _sums(vectors, starts, False)[2]
            starts = _taken(vectors, starts, np.maximum(cost, 1e-300), 2.0 * k, (seed << 20) + group * STEPS * tries + step * tries)
        weights = _sums(vectors, starts, False)[0]
        starts = [_chosen(c, np.maximum(w, 1e-9), k, rng) for c, w in zip(starts, weights, strict=True)]
        moving, costs = list(range(len(starts))), np.full(len(starts), np.inf)
        for _ in range(rounds):
            n, total, cost = _sums(vectors, [starts[t] for t in moving])
            still = []
            for t, m, s, c in zip(moving, n, total, cost, strict=True):
                costs[t] = c  # of the centres before they move; those after cost no more
                new = np.where(m[:, None] > 0, s / np.maximum(m, 1)[:, None], starts[t])
                if np.sqrt(((new - starts[t]) ** 2).sum(1)).max() > TOLERANCE:
                    still.append(t)
                starts[t] = new
            moving = still
            if not moving:
                break
        t = int(costs.argmin())
        if best is None or costs[t] < best[0]:
            best = (float(costs[t]), starts[t])
    return best[1]


def assigned(vectors: DataFrame, centres: np.ndarray | None) -> DataFrame:
    """(id, cluster): the nearest centre of each vector, the first on ties."""
    if centres is None:
        return vectors.select("id", F.lit(0).alias("cluster")).where("false")

    def run(batches):
        for batch in batches:
            x, near = _vectors(batch["emb"]), np.zeros(batch.num_rows, np.int32)
            for rows, c, _ in _nearest(x, [centres]) if len(x) else ():
                near[rows] = c[:, 0]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(near)], names=["id", "cluster"])

    return vectors.select("id", "emb").mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int")
