"""Product-quantised codes of vectors, in whole numbers, with Drake and Hamerly's adaptive bounds.

Every component becomes ``floor(256 x)``; vectors are cut into equal parts, and each part position has a codebook that
rounds of assignment and averaging improve. Codes are exact, ties included; bounds only spare work. Beside a part's code
the table of a round keeps its ``b`` next closest entries with ordered lower bounds on their distances, and one outer
bound below the distances of all others. When the entries have moved, bounds sink by the moves, and

* a part whose code is nearer than all bounds keeps it, without looking at any other entry;
* one whose code is nearer than the outer bound is compared with its ``b`` entries, in whole numbers;
* any other is compared with all entries.

``b`` follows what the last round needed. Bounds are 16-bit floats, rounded down, so a table row stays small; the
distance of a part to its own entry is always worked out anew from whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.operators.joins import with_one
from mediasift.sources.shared import discard, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Closest entries kept in the first round, and at most.
FIRST_B, MOST_B = 4, 16
#: Share of the parts that ``b`` entries should settle.
SETTLED = 0.95
#: Components reach so far either way; beyond, squared distances would not fit 64-bit whole numbers.
REACH = 1 << 18
#: No entry: fills lists of fewer than ``b``.
NONE = 255
_HALF = np.finfo(np.float16)


def _down(x: np.ndarray) -> np.ndarray:
    """16-bit floats that are not above ``x``."""
    y = np.minimum(x, float(_HALF.max)).astype(np.float16)
    return np.where(y > x, np.nextafter(y, np.float16(-np.inf)), y).astype(np.float16)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, whole numbers."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) < 1 << 23:  # then every sum is below 2^53, and so exact
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


class Bounds:
    """The codes and bounds of one part position of many vectors: ``code`` (n), ``near`` and ``low`` (n, b), ``outer`` (n)."""

    def __init__(self, code: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray):
        self.code, self.near, self.low, self.outer = code, near, low, outer

    @classmethod
    def fresh(cls, x: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
        """From the distances to all entries."""
        d = squares(x, entries)
        k = min(b + 2, len(entries))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        far = _down(np.sqrt(np.take_along_axis(d, order, 1).astype(float)) * (1 - 1e-12))
        near, low = np.full((len(x), b), NONE, np.uint8), np.full((len(x), b), np.inf, np.float16)
        got = min(b, k - 1)
        near[:, :got], low[:, :got] = order[:, 1 : 1 + got], far[:, 1 : 1 + got]
        outer = far[:, b + 1] if k == b + 2 else np.full(len(x), np.inf, np.float16)
        return cls(order[:, 0].astype(np.uint8), near, low, outer)

    def moved(self, x: np.ndarray, entries: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """Follow entries that have moved by ``moves`` (lengths, rounded up). Returns, for each row, how many kept entries had to
        be looked at: up to b, or b + 1 if all entries had to be."""
        n, b = self.near.shape
        step = np.append(moves, np.zeros(NONE + 1 - len(moves)))
        low = _down(self.low.astype(float) - step[self.near])
        order = np.argsort(low, axis=1, kind="stable")
        self.near, self.low = np.take_along_axis(self.near, order, 1), np.take_along_axis(low, order, 1)
        self.outer = _down(self.outer.astype(float) - moves.max(initial=0.0))
        own = x - entries[self.code]
        mine = np.sqrt((own * own).sum(1).astype(float)) * (1 + 1e-12)
        looked = (self.low <= mine[:, None]).sum(1)  # bounds are ordered
        every = self.outer <= mine
        some = np.flatnonzero((looked > 0) & ~every)
        looked[every] = b + 1
        if len(some):
            ids = np.concatenate([self.code[some, None], self.near[some]], 1)
            there = ids != NONE
            gap = x[some, None, :] - entries[np.where(there, ids, 0)]
            d = np.where(there, (gap * gap).sum(2), np.iinfo(np.int64).max)
            best = np.lexsort((ids, d), axis=1)
            ids, d = np.take_along_axis(ids, best, 1), np.take_along_axis(d, best, 1)
            self.code[some], self.near[some] = ids[:, 0], ids[:, 1:]
            self.low[some] = np.where(ids[:, 1:] == NONE, np.float16(np.inf), _down(np.sqrt(d[:, 1:].astype(float)) * (1 - 1e-12)))
        rows = np.flatnonzero(every)
        if len(rows):
            new = Bounds.fresh(x[rows], entries, b)
            self.code[rows], self.near[rows], self.low[rows], self.outer[rows] = new.code, new.near, new.low, new.outer
        return looked

    def resized(self, b: int) -> Bounds:
        """With lists of ``b``: what is left out is covered by the outer bound, what is not known stays empty."""
        have = self.near.shape[1]
        if b < have:
            return Bounds(self.code, self.near[:, :b], self.low[:, :b], np.minimum(self.outer, self.low[:, b:].min(1)))
        more = ((0, 0), (0, b - have))
        return Bounds(self.code, np.pad(self.near, more, constant_values=NONE), np.pad(self.low, more, constant_values=np.inf), self.outer)

    def packed(self) -> np.ndarray:
        """One row of bytes each: code, near, low, outer."""
        return np.concatenate([self.code[:, None], self.near, np.ascontiguousarray(self.low).view(np.uint8), np.ascontiguousarray(self.outer[:, None]).view(np.uint8)], 1)

    @classmethod
    def unpacked(cls, rows: np.ndarray) -> Bounds:
        b = (rows.shape[1] - 3) // 3
        rows = rows.copy()
        half = lambda x: np.ascontiguousarray(x).view(np.float16)
        return cls(rows[:, 0].copy(), rows[:, 1 : 1 + b].copy(), half(rows[:, 1 + b : 1 + 3 * b]).copy(), half(rows[:, 1 + 3 * b :])[:, 0].copy())


def _whole(column: pa.Array, parts: int, part_width: int) -> np.ndarray:
    """The vectors of byte cells, as (rows, parts, components); a cell holds 16-bit or 32-bit numbers."""
    cells, width = column.to_pylist(), parts * part_width
    size, out = np.array([len(x) for x in cells], np.int64), np.zeros((len(cells), width), np.int64)
    for kind in ("<i2", "<i4"):
        at = np.flatnonzero(size == width * int(kind[2]))
        if len(at):
            out[at] = np.frombuffer(b"".join([cells[k] for k in at]), kind).reshape(len(at), width)
    return out.reshape(len(cells), parts, part_width)


def _cells(column: pa.Array, parts: int) -> np.ndarray:
    """Byte cells of equal size as (rows, parts, bytes of a part)."""
    cells = column.to_pylist()
    size = len(cells[0]) // parts if cells else 0
    return np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), parts, size)


def _batch(batch: pa.RecordBatch, keep: tuple[str, ...], **columns) -> pa.RecordBatch:
    """Columns of a batch as they are, with others beside them."""
    return pa.RecordBatch.from_arrays([batch[c] for c in keep] + list(columns.values()), names=[*keep, *columns])


def kept_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The rows whose vector is not null and holds finite components only, none beyond ``REACH``."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= float(REACH)))
    return vectors.where(F.coalesce(good, F.lit(False)) & (F.size(vector) > 0))


def _first_books(kept: DataFrame, id: str, vector: str, parts: int, entries: int) -> list[np.ndarray]:
    """Codebooks of the vectors with the smallest ids (nulls last, ties by vector)."""
    rows = kept.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    if not rows:
        return []
    width = len(rows[0]["v"])
    if width % parts or not width:
        return []
    x = np.floor(np.array([r["v"] for r in rows if len(r["v"]) == width]) * SCALE).astype(np.int64)
    return list(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def _assign(table: DataFrame, books: list[np.ndarray], moves: list[np.ndarray] | None, b: int, last: bool, id_kind: str, name: str) -> DataFrame:
    """``table`` (id, label, x, and from the second round on bounds) with new codes and bounds (after the last round codes alone),
    and per row how often each number of kept entries had to be looked at; stored."""
    parts, part_width = len(books), books[0].shape[1]

    def run(batches):
        for batch in batches:
            x = _whole(batch["x"], parts, part_width)
            states, looked = [], np.zeros((batch.num_rows, MOST_B + 2), np.uint8)
            old = None if moves is None else _cells(batch["bounds"], parts)
            for p, book in enumerate(books):
                if old is None:
                    state = Bounds.fresh(x[:, p], book, b)
                else:
                    state = Bounds.unpacked(old[:, p]).resized(b)
                    looked[np.arange(batch.num_rows), np.minimum(state.moved(x[:, p], book, moves[p]), MOST_B + 1)] += 1
                states.append(state.code[:, None] if last else state.packed())
            cells = np.stack(states, 1)
            yield _batch(batch, ("id", "label", "x"), bounds=pa.array([r.tobytes() for r in cells], pa.binary()), looked=pa.array([r.tobytes() for r in looked], pa.binary()))

    label = table.schema["label"].dataType.simpleString()
    return stored(table.mapInArrow(run, f"id {id_kind}, label {label}, x binary, bounds binary, looked binary"), name)


def _sums(table: DataFrame, parts: int, entries: int, part_width: int) -> list:
    """(part, entry, n, sums) of every entry in use: at most ``parts`` times ``entries`` rows, summed up on the executors."""
    def run(batches):
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, part_width), np.int64)
        for batch in batches:
            x = _whole(batch["x"], parts, part_width)
            codes = _cells(batch["bounds"], parts)[:, :, 0]
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p], codes[:, p], x[:, p])
        used = np.argwhere(n)
        sums = pa.array([total[p, e].tolist() for p, e in used], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(n[tuple(used.T)]), sums], names=["part", "entry", "n", "sums"])

    one = table.select("x", "bounds").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(part_width)]
    return one.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()


def _looked(table: DataFrame) -> np.ndarray:
    """How many parts had to look at 0, 1, ... of their kept entries; the last number counts those that had to look at all entries."""

    def run(batches):
        total = np.zeros(MOST_B + 2, np.int64)
        for batch in batches:
            total += _cells(batch["looked"], 1)[:, 0].sum(0, dtype=np.int64) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(MOST_B + 2), pa.int32()), pa.array(total)], names=["k", "n"])

    rows = table.select("looked").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(MOST_B + 2, np.int64)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


def adapted(looked: np.ndarray, b: int) -> int:
    """The fewest entries that would have settled ``SETTLED`` of the parts that could be settled by them; twice as many as now,
    if too many parts had to look at all."""
    if not looked.sum():
        return b
    if looked[b + 1 :].sum() > (1 - SETTLED) * looked.sum():
        return min(2 * b, MOST_B)
    return int(max(1, np.searchsorted(np.cumsum(looked[: b + 1]), SETTLED * looked.sum())))


class Codes:
    """What :func:`train` gives: ``rows`` (id, label, x, bounds), the ``books`` (one array of entries a part position), and for each
    round after the first how many parts looked at how many entries (``looked``), with the ``b`` of that round."""

    def __init__(self, rows: DataFrame, books: list[np.ndarray], looked: list[tuple[int, np.ndarray]]):
        self.rows, self.books, self.looked = rows, books, looked


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> Codes | None:
    """Codebooks of at most 255 ``entries`` and codes of ``vectors``; None if no vector is left.

    Left out are null vectors, and those that are empty or hold null, non-finite or unfit components (:func:`kept_vectors`), or
    that are not as long as the one with the smallest id, whose length ``parts`` must divide. Codebooks start as the parts of
    the vectors with the smallest ids (all, if there are fewer than ``entries``; null ids come last, equal ones in order of
    their vectors). Rows that repeat count each. Every round is written to the shared folder, in place of the one before; what
    comes to the driver is one row for each entry.
    """
    kept = kept_vectors(vectors, id, vector)
    books = _first_books(kept, id, vector, parts, entries)
    if not books:
        return None
    part_width, kind = books[0].shape[1], vectors.schema[id].dataType.simpleString()

    def whole(batches):
        for batch in batches:
            x = np.floor(batch["v"].flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64).reshape(batch.num_rows, -1 if batch.num_rows else 0)
            small = ((x >= -(1 << 15)) & (x < 1 << 15)).all(1)
            cells = [r.astype("<i2" if s else "<i4").tobytes() for r, s in zip(x, small, strict=True)]
            yield _batch(batch, ("id", "label"), x=pa.array(cells, pa.binary()))

    given = kept.where(F.size(vector) == parts * part_width).select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    table = given.mapInArrow(whole, f"id {kind}, label {vectors.schema[label].dataType.simpleString()}, x binary")
    b, moves, looked = min(FIRST_B, entries), None, []
    for number in range(rounds + 1):
        before, table = table, _assign(table, books, moves, b, number == rounds, kind, f"codes-{number}")
        discard(before)
        if moves is not None:
            looked.append((b, _looked(table)))
            b = adapted(looked[-1][1], b)
        if number < rounds:
            new = [book.copy() for book in books]
            for r in _sums(table, parts, len(books[0]), part_width):
                new[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(part_width)]
            gaps = [a - c for a, c in zip(new, books, strict=True)]
            moves, books = [np.sqrt((g * g).sum(1).astype(float)) * (1 + 1e-12) for g in gaps], new
    return Codes(table, books, looked)


def codes(found: Codes) -> DataFrame:
    """(id, label, code, error): the entries of a vector's parts, two hexadecimal digits each, and the sum of squared distances to them."""
    books, parts, part_width = found.books, len(found.books), found.books[0].shape[1]
    kinds = {c: found.rows.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches):
        for batch in batches:
            x = _whole(batch["x"], parts, part_width)
            got = _cells(batch["bounds"], parts)[:, :, 0]
            error = np.zeros(batch.num_rows, np.int64)
            for p, book in enumerate(books):
                gap = x[:, p] - book[got[:, p]]
                error += (gap * gap).sum(1)
            yield _batch(batch, ("id", "label"), code=pa.array([r.tobytes().hex() for r in got], pa.string()), error=pa.array(error))

    return found.rows.select("id", "label", "x", "bounds").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of all rows of its label; null labels count as one. A label may hold any share of the rows."""
    nothing = F.lit("0").cast(coded.schema["label"].dataType)
    rows = stored(coded.withColumns({"_known": F.col("label").isNotNull(), "_label": F.coalesce("label", nothing)}), "codes")
    sums = stored(rows.groupBy("_known", "_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    return with_one(rows, sums, ["_known", "_label"]).drop("_known", "_label")


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all vectors that can be coded; an empty table gives an empty one."""
    found = train(vectors, id=id, vector=vector, label=label)
    if found is None:
        none = vectors.where("false")
        return none.select(id, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    out = with_label_error(codes(found))
    return out.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(books_sha256(found.books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    return compressed(table(spark, sf_dir, "embeddings"))


def _rounds_sql() -> str:
    """Assignment and averaging, round by round, over all distances."""
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT v.rid, v.part, min(struct_pack(d := list_sum(list_transform(range(1, len(v.xs) + 1), lambda i: (v.xs[i] - c.xs[i]) * (v.xs[i] - c.xs[i]))), entry := c.entry)) AS best FROM v JOIN c{k} c USING (part) GROUP BY v.rid, v.part)")
        if k < ROUNDS:
            out.append(f"m{k} AS (SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT a.part, a.best.entry AS entry, unnest(range(1, len(v.xs) + 1)) AS i, unnest(v.xs) AS x FROM a{k} a JOIN v USING (rid, part)) GROUP BY ALL)")
            out.append(f"n{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS xs FROM m{k} GROUP BY part, entry)")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.xs, c.xs) AS xs FROM c{k} c LEFT JOIN n{k} n USING (part, entry))")
    return ",\n".join(out)


SQL = f"""
WITH kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS xs
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT rid, part, xs[part * (len(xs) // {PARTS}) + 1 : (part + 1) * (len(xs) // {PARTS})] AS xs FROM kept, (SELECT unnest(range({PARTS})) AS part)),
c0 AS (SELECT part, rid - 1 AS entry, xs FROM v WHERE rid <= {ENTRIES}),
{_rounds_sql()},
coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} JOIN kept k USING (rid) GROUP BY k.rid, k.vec_id, k.label),
books AS (SELECT sha256(string_agg(array_to_string(xs, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""
