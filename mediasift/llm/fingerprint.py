"""Document fingerprints from closed syncmers.

A k-mer of a text's bytes is an anchor if its smallest inner s-mer (by hash) lies at one of its edges. Whether it is
depends on nothing outside the k-mer, so the same passage has the same anchors wherever it stands. A fingerprint holds
the text's anchors with the smallest hashes, each with its place: a fixed share of all, so that long texts have more, and
:data:`ANCHORS` at least. The likeness of two fingerprints is the share of anchors, among those that both would hold, that
both do hold at places that agree with the main shift between the texts.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.textbytes import blocks
from mediasift.sources.shared import stored

#: Bytes of an anchor, and of its inner strings, for texts of any length.
K, S = 12, 4
#: Anchors of a fingerprint at least; all of them if a text has fewer. Beyond that, all with a hash below SHARE.
ANCHORS = 48
SHARE = (1 << 64) // 64
#: Bytes by which a shared anchor may be off the main shift.
SLACK = 64
#: Text bytes of a range of neighbouring ids, on average.
RANGE_BYTES = 48 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def syncmers(data: np.ndarray, offsets: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in the text, first of each text) of the closed syncmers of every text of a block."""
    n, rows = len(data), len(offsets) - 1
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    b = data.astype(_U)
    inner = np.zeros(n - s + 1, _U)  # the s-mer itself, as it has 8 bytes at most, then mixed
    for i in range(s):
        inner = inner << _U(8) | b[i : n - s + 1 + i]
    inner = _mix(inner)
    width = k - s + 1  # s-mers of a k-mer
    low, have = inner, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    count = n - k + 1
    ends = np.repeat(offsets[1:], np.diff(offsets))[:count]
    at = np.flatnonzero(((inner[:count] == low[:count]) | (inner[width - 1 : width - 1 + count] == low[:count])) & (np.arange(count) + k <= ends))
    h = inner[at]
    for i in sorted({*range(s, k - s + 1, s), k - s}):
        h = _mix(h * _U(0x100000001B3) + inner[np.minimum(at + i, n - s)])
    row = np.searchsorted(offsets, at, "right") - 1
    return h, at - offsets[row], np.searchsorted(row, np.arange(rows + 1))


_TOP = (1 << 64) - 1


def sketch(h: np.ndarray, place: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, their first places, bound): the anchors with the smallest hashes, which are all up to the bound; for a text
    without any anchor its whole as one."""
    if not len(h):
        return np.array([int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big")], _U), np.zeros(1, np.int64), _TOP
    if len(h) > 16 * ANCHORS:  # hashes far above the bound can't be among the smallest, unless few differ
        few = h <= max(np.partition(h, 4 * ANCHORS)[4 * ANCHORS], _U(SHARE))
        low, first = np.unique(h[few], return_index=True)
        if len(low) >= ANCHORS:
            n = max(ANCHORS, int(np.searchsorted(low, _U(SHARE))))
            return low[:n], place[few][first[:n]], int(low[n - 1])
    low, first = np.unique(h, return_index=True)
    n = max(ANCHORS, int(np.searchsorted(low, _U(SHARE))))
    return low[:n], place[first[:n]], _TOP if n >= len(low) else int(low[n - 1])


def likeness(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> float:
    bound = _U(min(a[2], b[2]))
    x, y = a[0][a[0] <= bound], b[0][b[0] <= bound]
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    shift = b[1][j] - a[1][i]
    return float((np.abs(shift - np.sort(shift)[len(shift) // 2]) <= SLACK).sum()) / (len(x) + len(y) - len(common))


def written(s: tuple[np.ndarray, np.ndarray, int]) -> str:
    return ",".join(f"{h:016x}@{p}" for h, p in zip(s[0].tolist(), s[1].tolist(), strict=True))


def sketches(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, int]]:
    out = []
    for _, _, data, offsets in blocks(texts, 1 << 20):
        h, place, first = syncmers(data, offsets)
        out += [sketch(h[a:b], place[a:b], data[s:e].tobytes()) for a, b, s, e in zip(first, first[1:], offsets, offsets[1:], strict=False)]
    return out


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint) of every row's whole text. Null is as empty; equal texts have equal fingerprints; a text too
    short for an anchor has one of its whole. Repeated rows repeat; other columns are not touched."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([written(s) for s in sketches(batch.column(1))], pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id)


SCHEMA = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LAST = -(1 << 63)
#: Bytes of whole texts that are looked at together; a longer text stands alone.
LOOK_CHARS = 8 << 20


def _measured(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    """Results of all rows but the last and but the guests; the next row of each stands below it."""
    own = np.flatnonzero(~np.asarray(rows.column(1).to_numpy(zero_copy_only=False), bool)[: rows.num_rows - 1])
    if not len(own):
        return None
    texts = rows.column(3).to_pylist()
    edited = []
    for i in own.tolist():
        gone = len(texts[i]) // 3
        edited.append(texts[i][: len(texts[i]) - gone] + texts[i + 1][:gone])
    plain, changed = sketches(rows.column(3)), sketches(pa.array(edited, pa.string()))
    return pa.RecordBatch.from_arrays(
        [
            rows.column(2).take(pa.array(own)),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([written(plain[i]) for i in own], pa.string()),
            pa.array([written(x) for x in changed], pa.string()),
            pa.array([likeness(plain[i], x) for i, x in zip(own, changed, strict=True)], pa.float64()),
            pa.array([likeness(plain[i], plain[i + 1]) for i in own], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _edited(batches):
    """Rows come by range and falling id; a range ends with the first row of the next one, which is only looked at. Batches
    are taken in parts of about LOOK_CHARS."""
    kept = None
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(3)).to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(sizes // LOOK_CHARS)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            rows = pa.Table.from_batches([batch.slice(a, b - a)] if kept is None else [kept, batch.slice(a, b - a)]).combine_chunks().to_batches()[0]
            kept = rows.slice(rows.num_rows - 1)
            out = _measured(rows)
            if out is not None:
                yield out


def edits(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last third of its characters replaced by the first as
    many of the next document's, in falling doc_id, the first after the last), and how like they are.

    Documents are dealt into ranges of neighbouring ids, of bounded bytes on average, and sorted within; the first
    document of a range is also sent to the range before it. So every document meets its next one in a task that
    streams, and texts are shuffled once, each range to a place of its own. A null text is empty. Rows with a null id come
    last, in ranges and an order by a hash of their texts; rows with equal ids in the order of that hash. A table of one
    row has that row as its own next one; an empty table gives an empty one.

    What the driver holds are 24 bytes for each range of RANGE_BYTES.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))
    size = F.sum(F.octet_length("text"))
    sizes = rows.agg(F.coalesce(size, F.lit(-1)).alias("all"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.octet_length("text"))), F.lit(0)).alias("nameless")).first()
    if sizes["all"] < 0:
        return spark.createDataFrame([], SCHEMA.format(kind))
    ranges = max(-(-sizes["all"] // RANGE_BYTES), spark.sparkContext.defaultParallelism)
    named = rows.where("key is not null")
    bounds = sorted({float(x) for x in named.approxQuantile("key", [i / ranges for i in range(1, ranges)], max(1e-6, 0.2 / ranges))}) if ranges > 1 else []
    splits = [-math.inf, *bounds, math.inf]
    falling = F.lit(len(splits) - 2) - F.col("bucket").cast("int")
    nameless = -(-sizes["nameless"] // RANGE_BYTES) or 1
    by_hash = F.least(F.lit(nameless - 1), F.floor((F.col("th") / 2.0**64 + 0.5) * nameless)).cast("int")
    bucketed = Bucketizer(splits=splits, inputCol="place", outputCol="bucket", handleInvalid="keep").transform(rows.withColumn("place", F.coalesce(F.col("key").cast("double"), F.lit(0.0))))
    order = F.struct(F.bitwise_not("key").alias("k"), "th")  # falling ids; nulls are dealt to ranges of their own, which come last
    dealt = bucketed.select("doc_id", "key", "th", "text", F.when(F.col("key").isNull(), F.lit(len(splits) - 1) + by_hash).otherwise(falling).alias("range"))
    heads = dealt.groupBy("range").agg(F.min(order).alias("head")).select("range", "head").orderBy("range")
    heads = [(r["range"], r["head"]["k"], r["head"]["th"]) for r in heads.collect()]  # one row a range
    before = {r[0]: heads[k - 1][0] for k, r in enumerate(heads)}
    listed = stored(spark.createDataFrame([(r, k, th, before[r]) for r, k, th in heads], "range int, k long, th long, earlier int"), "heads")
    first = F.broadcast(listed.select(F.col("range").alias("own"), F.col("k").alias("head_k"), F.col("th").alias("head_th"), "earlier"))  # a row a range
    known = dealt.join(first, (F.col("range") == F.col("own")) & F.bitwise_not("key").eqNullSafe(F.col("head_k")) & (F.col("th") == F.col("head_th")), "left")
    places = F.array(F.struct("range", F.lit(False).alias("guest")), F.struct(F.col("earlier").alias("range"), F.lit(True).alias("guest")))
    sent = F.when(F.col("earlier").isNotNull(), places).otherwise(F.slice(places, 1, 1))
    met = known.select("doc_id", "key", "th", "text", F.explode(sent).alias("at")).select("at.range", "at.guest", "doc_id", "key", "th", "text")
    met = met.repartitionById(heads[-1][0] + 1, F.col("range")).sortWithinPartitions("range", "guest", F.desc_nulls_last("key"), "th", "text")
    return met.select("range", "guest", "doc_id", "text").mapInArrow(_edited, SCHEMA.format(kind))


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    return edits(table(spark, sf_dir, "documents"))
