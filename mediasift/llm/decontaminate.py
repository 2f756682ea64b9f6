"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a block of documents inside a task. Its words become symbols: the words of the benchmark have one each, and
every other word ends a run, as no benchmark phrase can go across it; runs shorter than the shortest phrase can't hold
one either. The runs are indexed, all phrases are searched backward through the wavelet tree, their occurrences are
located by sampled suffix positions, compared word by word with the text, and merged into spans.

Benchmark phrases are broadcast in blocks of at most ``BLOCK_ITEMS_BYTES`` of item text; each block is one more pass.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.fmindex import FMIndex
from mediasift.llm.textbytes import LOWER, blocks

WINDOW = 13
BLOCK_ITEMS_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
#: Bytes of whole texts whose words are hashed at once (some 50 bytes of memory each).
HASH_BYTES = 1 << 20
#: Contaminated: hit words times this are at least the document's words.
SHARE = 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_P = 0x9E3779B97F4A7C15 | 1
_P_BACK = pow(_P, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER.tobytes()))


def _powers(p: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(p)
    return np.cumprod(out, dtype=np.uint64)


def _word_hashes(data: np.ndarray, offsets: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text). A word's hash is a polynomial in its bytes, modulo 2^64."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 1, bool)
    inside[:-1] = _IS_WORD[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(0x51)) * up[: len(low)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    return h, np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class Phrases:
    vocabulary: np.ndarray  # sorted hashes of the benchmark's words
    matrices: list[np.ndarray]  # phrases as symbols, a matrix for each length
    items: list[list[list[str]]]  # items of each phrase, alike
    words: list[list[tuple]]  # the words of each phrase, alike
    shortest: int


def phrases_of(items: list[tuple[str, str]]) -> Phrases:
    """Windows of 13 words of each (item id, text); an item of fewer words is one window."""
    found: dict[tuple, set] = {}
    for name, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
            found.setdefault(tuple(w[i : i + WINDOW]), set()).add(name)
    every = sorted({x for p in found for x in p})
    blob = np.frombuffer(b" ".join(every), np.uint8)
    h = _word_hashes(blob, np.array([0, len(blob)]), _powers(_P, len(blob) + 1), _powers(_P_BACK, len(blob) + 1))[0]
    hash_of = dict(zip(every, h, strict=True))
    vocabulary = np.unique(h)
    lengths = sorted({len(p) for p in found})
    by = [sorted(p for p in found if len(p) == n) for n in lengths]
    return Phrases(
        vocabulary,
        [np.searchsorted(vocabulary, np.array([[hash_of[x] for x in p] for p in ps], np.uint64)).astype(np.int64) + 1 for ps in by],
        [[sorted(x for x in found[p] if x is not None) for p in ps] for ps in by],
        by,
        min(lengths, default=0),
    )


def _runs(h: np.ndarray, first: np.ndarray, vocabulary: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with a 0 between runs, word number of each symbol) of the runs of benchmark words that are long enough."""
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    known = vocabulary[at] == h
    starts = np.zeros(len(h) + 1, bool)
    starts[first] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]])) | starts)
    a, b = edge[:-1], edge[1:]
    keep = (b - a >= shortest) & known[np.minimum(a, len(h) - 1)] & (a < len(h))
    a, b = a[keep], b[keep]
    size = b - a + 1  # with the 0 that ends it
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    number = np.repeat(a, size) + place
    symbol = np.where(place < np.repeat(b - a, size), at[np.minimum(number, len(h) - 1)] + 1, 0)
    return symbol, number


class Powers:
    """Powers of the base and of its inverse, as many as asked for so far."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_P, n), _powers(_P_BACK, n)
        return self.up, self.down


def _hashed(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_word_hashes`, by parts of whole texts."""
    hashes, counts, row = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + HASH_BYTES, "right")) - 1)
        part = data[offsets[row] : offsets[end]]
        h, first = _word_hashes(part, offsets[row : end + 1] - offsets[row], *powers(len(part) + 1))
        hashes.append(h)
        counts.append(np.diff(first))
        row = end
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


def _shard(data: np.ndarray, offsets: np.ndarray, p: Phrases, powers: Powers):
    """(word count of each text, {row: (merged spans of words, item ids)}) of one shard."""
    h, first = _hashed(data, offsets, powers)
    number = np.diff(first)
    if not len(h) or not p.shortest:
        return number, {}
    symbols, word = _runs(h, first, p.vocabulary, p.shortest)
    if not len(symbols):
        return number, {}
    index = FMIndex(symbols)
    hits: dict[int, tuple[list, set]] = {}
    texts: dict[int, list[bytes]] = {}
    for matrix, items, words in zip(p.matrices, p.items, p.words, strict=True):
        lo, hi = index.search(matrix)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        rows = np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        place = word[index.locate(rows)]
        row = np.searchsorted(first, place, "right") - 1
        for w, r, i in zip(which.tolist(), row.tolist(), (place - first[row]).tolist(), strict=True):
            if r not in texts:
                texts[r] = WORD.findall(LOWER[data[offsets[r] : offsets[r + 1]]].tobytes())
            if tuple(texts[r][i : i + matrix.shape[1]]) == words[w]:  # hashes met; do the words?
                spans, names = hits.setdefault(r, ([], set()))
                spans.append((i, i + matrix.shape[1]))
                names.update(items[w])
    return number, {r: (merged(spans), sorted(names)) for r, (spans, names) in hits.items()}


def merged(spans: list) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", carry_text: bool = False) -> DataFrame:
    """(id, n_words, spans, items) for every row: merged spans of word numbers that occur in a window of an item, and
    the items whose windows occur, sorted as strings.

    Null or empty texts have no words and no spans; null item texts have no windows; hits of an item without an id
    count as words but name no item. Repeated rows give repeated results; the word spans of one item may overlap those
    of another and are merged. ``carry_text`` keeps the text beside the result (as ``text``).
    """
    spark = docs.sparkSession
    bench = items.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // BLOCK_ITEMS_BYTES) or 1
    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k in range(count):
        rows = bench.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).collect()  # a block of bounded bytes
        shared = spark.sparkContext.broadcast(phrases_of([(r["name"], r["text"]) for r in rows]))
        last = k == count - 1

        def run(batches, shared=shared, drop=last and not carry_text):
            p = shared.value
            powers = Powers()
            for batch in batches:
                n_words, spans, names = [], batch.column(3).to_pylist(), batch.column(4).to_pylist()
                for first, _, data, offsets in blocks(batch.column(1), SHARD_BYTES):
                    number, hits = _shard(data, offsets, p, powers)
                    n_words += number.tolist()
                    for r, (s, i) in hits.items():
                        had = [(x["start"], x["end"]) for x in spans[first + r]]
                        spans[first + r] = [{"start": a, "end": b} for a, b in merged(had + s)]
                        names[first + r] = sorted({*names[first + r], *i})
                found = [pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(names, pa.list_(pa.string()))]
                kept = [batch.column(0)] if drop else [batch.column(0), batch.column(1)]
                yield pa.RecordBatch.from_arrays([*kept, *found], names=[*("id", "text")[: len(kept)], "n_words", "spans", "items"])

        head = f"id {kind}, " if last and not carry_text else f"id {kind}, text string, "
        out = out.mapInArrow(run, head + "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>")
    return out.withColumnRenamed("id", id)


def verdicts(found: DataFrame) -> DataFrame:
    """``n_hit`` and ``contaminated`` from the spans of :func:`find`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def without_spans(text: str | None, spans: list) -> str | None:
    """The text without the bytes from the first to the last word of each span (for keeping the rest of a document)."""
    if text is None or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(LOWER.tobytes()))]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    found = verdicts(find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""
