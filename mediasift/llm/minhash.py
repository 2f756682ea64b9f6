"""MinHash near-duplicate detection with SuperMinHash signatures.

1. Every text becomes its set of word shingles (64-bit hashes) and a SuperMinHash signature: each element deals the
   ranks 0, 1, 2, ... (plus a fraction of its own) to the slots in a random order of its own, a slot keeps the smallest
   value, and dealing stops once no slot can fall any more.
2. Texts with equal sets form a class; its smallest id stands for it from here on.
3. Bands of the signature are bucketed. A bucket never gives all its pairs: first each class is verified against one
   pivot, the smallest id that it shares a bucket with, and the links found are turned into components. Only then are
   buckets that still hold more than one component joined, across components alone, and only where the elements that
   each has in common with any other candidate, and the signatures, allow for the threshold; these pairs are verified
   too, so no link between components is lost that shares a bucket and whose signatures agree as they should (both fail
   with a chance below 1e-7 at a threshold of 0.85). Buckets and classes of very many texts are split around hot keys, and
   the sets of pivots are copied for so many pairs each.
4. Links are confirmed on the full sets, as integers. Components of the links, carried to all members of the classes,
   give one row for each document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.textbytes import LOWER, blocks
from mediasift.operators.components import components
from mediasift.operators.joins import with_one
from mediasift.sources.shared import stored

SHINGLE = 5
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: A pair at a threshold of 0.8 or more agrees in so much less of its slots with a chance below 1e-7.
MARGIN = 0.18
#: Pairs that meet one copy of a set.
PAIRS_OF_A_COPY = 1000

#: Elements whose permutations are held at once.
PART = 1 << 17

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9E3779B97F4A7C15
_P_BACK = pow(_P, -1, 1 << 64)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(p: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = _U(p)
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """Distinct shingle hashes of the texts of a block, vectorised over all its bytes."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.up, self.down = size, np.zeros(0, _U), np.zeros(0, _U)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes sorted by text and hash, first of each text)."""
        n, k = len(data), self.size
        if len(self.up) < n + 1:
            self.up, self.down = _powers(_P, n + 1), _powers(_P_BACK, n + 1)
        low = LOWER[data]
        inside = np.zeros(n + 1, bool)
        inside[:-1] = ~_SPACES[low]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        starts = np.flatnonzero(inside & (~before | cut))
        ends = np.flatnonzero(before & (~inside | cut))
        sums = np.zeros(n + 1, _U)
        np.cumsum((low.astype(_U) + _U(0x51)) * self.up[:n], out=sums[1:])
        words = _mix((sums[ends] - sums[starts]) * self.down[starts] ^ (ends - starts).astype(_U) * _U(_P))
        first = np.searchsorted(starts, offsets)
        count = np.diff(first)
        take = np.where(count == 0, 0, np.maximum(count - k + 1, 1))
        doc = np.repeat(np.arange(len(count)), take)
        at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + first[:-1][doc]
        h = np.zeros(len(at), _U)
        last = first[1:][doc]
        for i in range(k):  # a short text is one shingle of all its words
            there = at + i < last
            w = words[np.minimum(at + i, max(len(words) - 1, 0))] if len(words) else np.zeros(0, _U)
            h = np.where(there, _mix(h * _U(0x100000001B3) + w + _U(i + 1)), h)
        order = np.lexsort([h, doc])
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[new], doc[new]
        return h, np.searchsorted(doc, np.arange(len(count) + 1))


def superminhash(h: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (texts x slots) of sets of 64-bit hashes, each value mixed down to 16 bits."""
    n = len(first) - 1
    sig = np.full((n, slots), np.inf)
    flat = sig.ravel()
    size = np.diff(first)
    doc = np.repeat(np.arange(n), size)
    for begin in range(0, len(h), PART):  # minima don't mind parts, and a part's permutations fit in memory
        live = np.arange(begin, min(len(h), begin + PART))
        perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(live), 1))
        for step in range(slots):
            # a text is done once none of its slots is above the next rank
            keep = (sig.max(axis=1) > step)[doc[live]]
            live, perm = live[keep], perm[keep]
            if not len(live):
                break
            r = _mix(h[live] + _U((step + 1) * _P & (1 << 64) - 1))
            to = step + ((r >> _U(40)) % _U(slots - step)).astype(np.int64)
            row = np.arange(len(live))
            slot = perm[row, to]
            perm[row, to] = perm[row, step]
            value = step + (r & _U(0xFFFFFFFF)).astype(np.float64) / 2.0**32
            np.minimum.at(flat, doc[live] * slots + slot, value)
    return _mix(sig.view(_U)).astype(np.uint16)


def sketches(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, n, set_key, sig): size of the shingle set, a digest of the set, and the signature as bytes."""

    def run(batches):
        cut = Shingler(shingle)
        for batch in batches:
            n, keys, sigs = [], [], []
            for _, _, data, offsets in blocks(batch.column(1), 1 << 20):
                h, first = cut(data, offsets)
                sig = superminhash(h, first)
                size = np.diff(first)
                n += size.tolist()
                keys += [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first, first[1:], strict=False)]
                sigs += [s.tobytes() if k else None for s, k in zip(sig, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n", "set_key", "sig"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n bigint, set_key binary, sig binary")


def _bands(kind: str):
    def run(batches):
        for batch in batches:
            ids, keys = [], []
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, BANDS, ROWS)
                h = np.zeros((batch.num_rows, BANDS), _U) + np.arange(1, BANDS + 1, dtype=_U) * _U(_P)
                for i in range(ROWS):
                    h = _mix(h ^ (sig[:, :, i].astype(_U) + _U(i << 17)))
                keys = h.astype(np.int64).ravel()
                ids = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0).take(pa.array(ids, pa.int64()))], names=["bucket", "id"])

    return run, f"bucket bigint, id {kind}"


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, kind: str) -> DataFrame:
    """(id, h): the full sets, as bytes of sorted hashes, of the wanted ids."""

    def run(batches):
        cut = Shingler(shingle)
        for batch in batches:
            out = []
            for _, _, data, offsets in blocks(batch.column(1), 1 << 20):
                h, first = cut(data, offsets)
                out += [h[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "h"])

    return docs.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(run, f"id {kind}, h binary")


def _confirm(percent: int, kind: str):
    """Of pairs with both sets, those with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                common = 0
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    common = int((b[at] == a).sum())
                keep.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run, f"a {kind}, b {kind}"


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, kind: str) -> DataFrame:
    """Those of the candidates (a, b) that are similar enough.

    A set that very many pairs ask for, as that of a pivot, is there in as many copies as it takes, and each copy goes to
    so many pairs at most, so no task has all pairs of one document. Sets join once each pair knows its copies; those of ``b``
    come first, as a pair with a pivot is the only one of its ``b``.
    """
    pairs, joins = stored(pairs, "candidates"), []
    for end, other in (("b", "a"), ("a", "b")):
        on, there = [end], sets.select(F.col("id").alias(end), F.col("h").alias(f"h{end}"))
        asked = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        asked = stored(asked.withColumn("copies", F.ceil(F.col("n") / PAIRS_OF_A_COPY)), "asked")
        if (asked.agg(F.max("copies")).first()[0] or 0) > 1:
            on.append(f"copy_{end}")
            pairs = stored(with_one(pairs, asked, [end]).withColumn(on[1], F.pmod(F.xxhash64(other), "copies")).drop("copies"), "candidates")
            copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias(on[1])
            there = there.join(asked.drop("n").hint("merge"), end).select(end, f"h{end}", copies)
        joins.append((there, on))
    for there, on in joins:
        pairs = pairs.join(there.hint("merge"), on)
    return pairs.select("a", "b", "ha", "hb").mapInArrow(*_confirm(percent, kind))


def _shared_part(sets: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """(id, n, shared): the size of a set, and how many of its elements any other of the wanted sets has too. No two
    sets have more in common than the smaller of these numbers."""

    def run(batches):
        for batch in batches:
            h = batch.column(1).to_pylist()
            ids = np.repeat(np.arange(len(h)), [len(x) // 8 for x in h])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(np.frombuffer(b"".join(h), np.int64))], names=["id", "element"])

    there = sets.join(wanted.hint("merge"), "id", "left_semi")
    only = there.mapInArrow(run, f"id {kind}, element bigint").groupBy("element").agg(F.count(F.lit(1)).alias("sets"), F.min("id").alias("id")).where("sets = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    n = (F.octet_length("h") / 8).cast("long")
    return there.select("id", n.alias("n")).join(only.hint("merge"), "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Words are runs of other characters than blanks, in lower case (A-Z only). Two texts are linked if 100 * common
    shingles >= ``percent`` * all their shingles. ``component_id`` is the smallest id that links lead to, the row's own
    included; ``kept`` marks the rows with that id. Null and empty texts, and texts of blanks, have no shingles and no
    links. Rows that repeat an id are one node if equal, and their links are shared if not; a null id has the null
    component and is kept. Other columns are not touched, whatever their names.
    """
    kind = docs.schema[id].dataType.simpleString()
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    sketched = stored(sketches(texts, "id", "text", shingle), "sketches")
    known = sketched.where("n > 0 and id is not null")
    reps = stored(known.groupBy("set_key").agg(F.min(F.struct("id", "sig")).alias("r"), F.count(F.lit(1)).alias("copies")).select("set_key", "r.id", "r.sig", "copies"), "classes")

    in_band = stored(reps.select("id", "sig").mapInArrow(*_bands(kind)), "bands")
    shared = in_band.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("pivot < top").select("bucket", "pivot", "n")
    members = stored(with_one(in_band, stored(shared, "shared"), ["bucket"]), "buckets")
    sets = stored(_sets(texts, members.select("id").distinct(), shingle, kind), "sets")

    first = members.where("id > pivot").groupBy("id").agg(F.min("pivot").alias("pivot")).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = stored(_verified(first, sets, percent, kind), "links")
    found = components(links)

    # buckets that hold more than one component still: pairs across components that can reach the threshold, by what
    # each has in common with any other candidate and by their signatures
    tagged = members.join(found.hint("merge"), members["id"] == found["node"], "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    tagged = stored(tagged, "tagged")
    mixed = tagged.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("bucket", "n")
    open_ = stored(with_one(tagged, stored(mixed, "mixed"), ["bucket"]), "mixed-buckets")
    shared_part = _shared_part(sets, open_.select("id").distinct(), kind)
    able = stored(shared_part.where(F.col("shared") * 100 >= F.col("n") * percent), "able")
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.substring("sig", i * 2 + 1, F.lit(2)))
    own = open_.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))  # a bucket for each band at most
    wide = able.join(reps.select("id", "sig").hint("merge"), "id").join(own.hint("merge"), "id").select("id", "n", "shared", "buckets", slots.alias("sig"))
    rest = open_.join(wide.hint("merge"), "id")
    x, y = rest.alias("x"), rest.alias("y")
    alike = F.aggregate(F.zip_with("x.sig", "y.sig", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, e: n + e)
    across = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    reach = F.least("x.shared", "y.shared") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    once = F.array_min(F.array_intersect("x.buckets", "y.buckets")) == F.col("x.bucket")  # of the buckets that a pair shares, one gives it
    pairs = x.join(y.hint("merge"), across & reach & once & (alike >= int((percent / 100 - MARGIN) * SLOTS))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    more = stored(_verified(pairs, sets, percent, kind), "links")
    if not more.isEmpty():
        found = components(links.union(more))

    of_class = reps.select("set_key", "copies", F.col("id").alias("rep")).join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select("set_key", F.col("copies").alias("n_rows"), F.coalesce("component", "rep").alias("component"))
    linked = with_one(known.select("id", "n", "set_key"), stored(of_class, "components-of-classes"), ["set_key"], "n_rows")
    alone = sketched.where("not (n > 0 and id is not null)").select("set_key", "id", "n", F.lit(None).cast(kind).alias("component"))
    rows = linked.select("set_key", "id", "n", "component").unionByName(alone)
    component = F.coalesce("component", "id")
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
