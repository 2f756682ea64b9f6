"""Mixture-controlled packing: every window of the packed stream holds its sources in the target proportions.

Each source is a queue of documents, and queues are served by deficit round-robin: window after window a queue is credited
its share of the window's tokens, gives as many whole tokens as its credit covers, and carries the rest of the credit into
the next window. Documents are cut where a window's credit or a sequence ends, so no window and no sequence but the
last has room left.

What a queue has given after ``w`` windows, its deficits included, is a closed form of ``w`` (the difference of two floors, so
that all queues' parts add up to the whole window). A task that holds some stretch of a queue therefore knows in
which windows it lies and where, and no deficit has to be handed from task to task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.packing import VOCABULARY, Encoder
from mediasift.sources.shared import stored

CAPACITY = 2048
END_ID = 1
#: Sequences of a window.
WINDOW_SEQUENCES = 32
#: A source with a smaller share of all tokens than one in so many has no queue of its own; so there are fewer queues than this.
LEAST_SHARE = 4096
#: Stretches (of a queue in a task) that are broadcast, counted first; more are joined by sorting.
BROADCAST_STRETCHES = 1_000_000


class Schedule:
    """Which tokens of which queue lie where in the stream, from how many tokens each queue holds and how it is weighed.

    Phases of whole windows alternate with single windows in which some queue runs dry; what such a queue lacks is shared out
    among the others by weight, and from then on it takes no part. If weights are the queues' sizes, none runs dry early.
    """

    def __init__(self, sizes: list[int], weights: list[int], window: int = WINDOW_SEQUENCES * CAPACITY):
        self.window = window
        #: One list a queue: (tokens given before, first window, windows, weights before, weights with this queue, all weights);
        #: a single window has its tokens and its place in the window in place of weights.
        self.phases: list[list[tuple]] = [[] for _ in sizes]
        left, given, at = list(sizes), [0] * len(sizes), 0
        while any(left):
            live = [k for k, n in enumerate(left) if n]
            upto = dict(zip(live, accumulate(weights[k] for k in live), strict=True))
            total = upto[live[-1]]

            def taken(k: int, w: int) -> int:
                return w * window * upto[k] // total - w * window * (upto[k] - weights[k]) // total

            low, high = 0, sum(left) // window
            while low < high:  # the most windows for which no queue lacks tokens
                mid = (low + high + 1) // 2
                low, high = (mid, high) if all(taken(k, mid) <= left[k] for k in live) else (low, mid - 1)
            if low:
                for k in live:
                    self.phases[k].append((given[k], at, low, upto[k] - weights[k], upto[k], total))
                    given[k] += (n := taken(k, low))
                    left[k] -= n
                at += low
            part, place = self._last_of(left, weights, window), 0
            for k, n in part.items():
                if n:
                    self.phases[k].append((given[k], at, 1, place, n, None))
                    given[k], left[k], place = given[k] + n, left[k] - n, place + n
            at += 1
        self.ends = [[self._end(k, p) for p in phases] for k, phases in enumerate(self.phases)]

    @staticmethod
    def _last_of(left: list[int], weights: list[int], window: int) -> dict[int, int]:
        """Tokens of each queue in one window in which some run dry: all that those have, and shares of the rest."""
        dry: dict[int, int] = {}
        while True:
            rest, live = window - sum(dry.values()), [k for k, n in enumerate(left) if n and k not in dry]
            if sum(left[k] for k in live) <= rest:
                return dry | {k: left[k] for k in live}
            upto = list(accumulate(weights[k] for k in live))
            parts = {k: rest * u // upto[-1] - rest * (u - weights[k]) // upto[-1] for k, u in zip(live, upto, strict=True)}
            short = {k: left[k] for k, n in parts.items() if n > left[k]}
            if not short:
                return dry | parts
            dry |= short

    def _end(self, queue: int, phase: tuple) -> int:
        """Tokens of the queue up to the end of a phase."""
        given, _, n, before, upto, total = phase
        return given + (upto if total is None else n * self.window * upto // total - n * self.window * before // total)

    def places(self, queue: int, start: int, end: int):
        """(start, end, place in the stream) of the stretches, one a window, in which tokens ``start`` to ``end`` of a queue lie."""
        window = self.window
        while start < end:
            given, first, n, before, upto, total = self.phases[queue][bisect_right(self.ends[queue], start)]
            x = start - given
            if total is None:
                stop, place = given + upto, first * window + before + x
            else:
                w = min(n - 1, x * total // (window * (upto - before)))
                while (had := w * window * upto // total - w * window * before // total) > x:
                    w -= 1
                while (has := (w + 1) * window * upto // total - (w + 1) * window * before // total) <= x:
                    w, had = w + 1, has
                ahead = (w + 1) * window * before // total - w * window * before // total
                stop, place = given + has, (first + w) * window + ahead + x - had
            yield start, min(end, stop), place
            start = min(end, stop)


def encoded(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", files: tuple[str, str | None] | None = None) -> DataFrame:
    """(id, source, ids, doc_tokens, part, before): every document's ids with the end id, as little-endian 16-bit numbers (32-bit,
    if one does not fit), stored; ``before`` counts the tokens of its source that its task met before it."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id, source)}
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        import public_tokenizers

        encode = Encoder(*(files or (public_tokenizers.path(f"{VOCABULARY}.json"), public_tokenizers.path(f"{VOCABULARY}.tiktoken"))))
        part, before = TaskContext.get().partitionId(), {}
        for batch in batches:
            ids, counts, ahead = [], [], []
            for text, source in zip(batch["text"], batch["source"].to_pylist(), strict=True):
                full = np.frombuffer(encode(text.as_py() or "") + end, "<u4")
                ids.append((full.astype("<u2") if full.max() < 1 << 16 else full).tobytes())
                counts.append(len(full))
                ahead.append(before.get(source, 0))
                before[source] = ahead[-1] + len(full)
            columns = [batch["id"], batch["source"], pa.array(ids, pa.binary()), pa.array(counts, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(ahead, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "source", "ids", "doc_tokens", "part", "before"])

    given = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(text).cast("string").alias("text"))
    out = given.mapInArrow(run, f"id {kinds[id]}, source {kinds[source]}, ids binary, doc_tokens long, part int, before long")
    return stored(out, "token-ids")


def _queues(stretches: DataFrame, targets: dict | None) -> tuple[dict, Schedule, int]:
    """(queue of each source that has one, the schedule, the queue of all others)."""
    sums = stored(stretches.groupBy("source").agg(F.sum("n").alias("n")), "source-tokens")
    total = sums.agg(F.sum("n")).first()[0] or 0
    named = F.col("source").isin(*targets) if targets else F.col("n") * LEAST_SHARE >= total
    named = F.coalesce(named, F.lit(False)) if targets else named
    own = sorted(sums.where(named).collect(), key=lambda r: (r["source"] is not None, r["source"]))  # fewer than LEAST_SHARE, or named ones
    queue = {r["source"]: k for k, r in enumerate(own)}
    sizes = [r["n"] for r in own]
    others = total - sum(sizes)
    if targets:
        if min(targets.values()) <= 0 or sum(targets.values()) >= 1 + 1e-9 or min(targets.values()) * LEAST_SHARE < 1:
            raise ValueError(f"shares are at least 1/{LEAST_SHARE} each and 1 at most together")
        unit = 1 << 40
        weights = [round(targets[r["source"]] * unit) for r in own]
        sizes.append(others)
        weights.append(max(unit - sum(round(x * unit) for x in targets.values()), unit // LEAST_SHARE))
        return queue, Schedule(sizes, weights), len(own)
    if others * LEAST_SHARE >= total or not own:
        sizes.append(others)
        return queue, Schedule(sizes, sizes), len(own)
    least = min(range(len(sizes)), key=sizes.__getitem__)  # too few tokens for a queue: behind the smallest
    sizes[least] += others
    return queue, Schedule(sizes, sizes), least


def pack(ids: DataFrame, targets: dict | None = None, id: str = "doc_id") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all pieces of ``ids`` (from :func:`encoded`).

    ``targets`` gives shares of tokens by source, at most 1 together; all other sources share the rest. Without it each source
    has the share that it has of the whole, so that all of them last to the end; sources of less than a 4096th share a
    queue. A null source is a source. Sequences are numbered along the stream; all but the last are full.
    """
    kind = ids.schema["id"].dataType.simpleString()
    stretches = stored(ids.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n")), "stretches")
    queue, schedule, others = _queues(stretches, targets)
    numbers = ids.sparkSession.createDataFrame(list(queue.items()), f"_source {ids.schema['source'].dataType.simpleString()}, _queue int")
    own = stretches.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("_source")), "left")
    own = own.select(F.coalesce("_queue", F.lit(others)).alias("queue"), F.struct("source").alias("of"), "part", "n")
    # a queue holds its sources' stretches by task, those of a task by source; a task's are added up before tasks are
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    tasks = own.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    ahead = tasks.select("queue", "part", F.coalesce(F.sum("n").over(earlier("queue").orderBy("part")), F.lit(0)).alias("ahead"))
    own = own.withColumn("inside", F.coalesce(F.sum("n").over(earlier("queue", "part").orderBy("of")), F.lit(0))).join(ahead.hint("merge"), ["queue", "part"])
    own = stored(own.select("queue", "of", "part", (F.col("ahead") + F.col("inside")).alias("begins")), "stretch-begins")
    few = own.count() <= BROADCAST_STRETCHES
    placed = ids.select("id", "ids", "doc_tokens", "before", "part", F.struct("source").alias("of"))
    placed = placed.join(F.broadcast(own) if few else own.hint("merge"), ["of", "part"])
    placed = placed.select("id", "ids", "doc_tokens", "queue", (F.col("begins") + F.col("before")).alias("at"))

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row, (ids, n, queue, at) in enumerate(zip(batch["ids"], *(batch[c].to_pylist() for c in ("doc_tokens", "queue", "at")), strict=True)):
                ids = ids.as_py()
                full = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                for a, b, place in schedule.places(queue, at, at + n):
                    while a < b:
                        length = min(b - a, CAPACITY - place % CAPACITY)
                        out.append((row, a - at, length, zlib.crc32(full[a - at : a - at + length]), n, place // CAPACITY, place % CAPACITY))
                        a, place = a + length, place + length
            row, *columns = np.array(out, np.int64).reshape(len(out), 7).T
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(row)), *map(pa.array, columns)], names=names)

    return placed.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id)


def packed(docs: DataFrame, targets: dict | None = None, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All documents in sequences. A null or empty text is its end id alone; rows that repeat are packed each; an empty table
    gives an empty one; further columns play no part."""
    return pack(encoded(docs, id, text, source), targets, id)


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    return packed(table(spark, sf_dir, "documents"))
