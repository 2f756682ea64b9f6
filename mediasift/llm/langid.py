"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its subwords (hashed byte n-grams inside words, word ends marked by a
blank); a linear softmax on that mean gives the language. Embeddings and softmax are trained together by stochastic
gradient descent in numpy, on a bounded sample for each language; a held-back fifth of that sample sets a temperature
(so that the score is a calibrated probability) and the score below which a prediction is marked as rejected.

Since both layers are linear, prediction adds up rows of the product of the embedding and softmax matrices.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.textbytes import BLOCK_BYTES, LOWER, SPACE, blocks, parts

UNDETERMINED = "und"
BUCKET_BITS = 15
SIZES = (3, 4)
DIMENSION = 16
#: Rows that the model learns from, for each language; every language with fewer is taken whole.
ROWS_PER_LANGUAGE = 700
#: Steps of the descent at least, so that a small table is learned as well.
LEAST_STEPS = 800
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # of a bucket's embedding times the softmax matrix; row 0 is zero
    bias: np.ndarray
    temperature: float
    reject_below: float


def _words(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, other ASCII as blanks, the bytes of other characters as they are."""
    table = LOWER.copy()
    ascii_ = np.arange(128)
    table[:128][~((ascii_ >= 97) & (ascii_ <= 122) | (ascii_ >= 65) & (ascii_ <= 90))] = SPACE
    return table[data]


def _buckets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each n-gram size the bucket at each byte; 0 where there is no n-gram inside one word of one text."""
    x, out = _words(data), []
    blank = x == SPACE
    ends = np.zeros(len(x) + 1, bool)
    ends[offsets[1:]] = True  # a text ends before this byte
    for n in SIZES:
        h = np.zeros(len(x), np.int32)
        m = len(x) - n + 1
        if m > 0:
            code = np.zeros(m, np.uint32)
            for i in range(n):
                code = (code ^ x[i : m + i]) * np.uint32(0x01000193)
            code ^= code >> np.uint32(15)
            bucket = (code & np.uint32((1 << BUCKET_BITS) - 2)).astype(np.int32) + 1
            bad = np.zeros(m, bool)
            for i in range(1, n):
                bad |= ends[i : m + i]
                if i < n - 1:
                    bad |= blank[i : m + i]
            bucket[bad] = 0
            h[:m] = bucket
        out.append(h)
    return out


def _sums_of_part(data: np.ndarray, a: int, b: int, logits: np.ndarray) -> tuple[np.ndarray, int]:
    """As :func:`_sums`, of the n-grams that begin in this part of one text; the last ones end in the next part."""
    near = data[a : min(len(data), b + max(SIZES) - 1)]
    found = [h[: b - a] for h in _buckets(near, np.array([0, len(near)]))]
    return sum(logits[h].sum(axis=0, dtype=float) for h in found), sum(int((h > 0).sum()) for h in found)


def _sums(data: np.ndarray, offsets: np.ndarray, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows of ``logits``, and count of n-grams, for each text."""
    n = len(offsets) - 1
    total, count = np.zeros((n, logits.shape[1])), np.zeros(n)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for h in _buckets(data, offsets):
            total[full] += np.add.reduceat(logits[h], offsets[full], axis=0)
            count[full] += np.add.reduceat((h > 0).astype(np.int64), offsets[full])
    return total, count


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    found = np.zeros(n, bool)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        low = data | 0x20
        found[full] = np.add.reduceat(((low >= 97) & (low <= 122) & (data < 128)).astype(np.int64), offsets[full]) > 0
        for i in full[~found[full]]:  # rare: a text without any ASCII letter
            text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            found[i] = LETTER.search(text) is not None
    return found


def _features(batches):
    """Label and the counted buckets of each text, for training."""
    for batch in batches:
        labels, out = batch.column(0), ([], [], [])
        for first, _, data, offsets in blocks(batch.column(1)):
            hs = _buckets(data, offsets)
            for i in range(len(offsets) - 1):
                h = np.concatenate([x[offsets[i] : offsets[i + 1]] for x in hs])
                bucket, count = np.unique(h[h > 0], return_counts=True)
                if len(bucket):
                    out[0].append(labels[first + i].as_py())
                    out[1].append(bucket.astype(np.int32))
                    out[2].append((count / count.sum()).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.float32()))],
            names=["label", "bucket", "share"],
        )


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int, seed: int):
    """Stochastic gradient descent on embeddings and softmax; the learning rate falls linearly."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSION))
    out, bias = np.zeros((DIMENSION, k)), np.zeros(k)
    size, steps = 32, 0
    each = -(-len(rows) // size)
    epochs = max(epochs, -(-LEAST_STEPS // each))
    total = epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            idx = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            lens = np.array([len(rows[i][0]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            mean = np.add.reduceat(emb[idx] * val[:, None], starts, axis=0)
            p = _softmax(mean @ out + bias)
            p[np.arange(len(pick)), y[pick]] -= 1
            back = p @ out.T
            rate = 0.5 * (1 - steps / total)
            out -= rate * mean.T @ p / len(pick) * 4
            bias -= rate * p.mean(axis=0)
            change = rate * np.repeat(back, lens, axis=0) * val[:, None] * 4
            by = np.argsort(idx, kind="stable")  # each bucket is changed once
            new = np.flatnonzero(np.diff(idx[by], prepend=-1))
            emb[idx[by][new]] -= np.add.reduceat(change[by], new, axis=0)
            steps += 1
    emb[0] = 0
    return emb, out, bias


def train(
    labelled: DataFrame,
    text: str = "text",
    label: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    precision: float = 0.99,
    epochs: int = 6,
    seed: int = 7,
) -> LanguageModel:
    """Learn from the rows that have both a text and a label.

    At most ``rows_per_language`` different texts of each language are used, chosen by a hash of the text. A table without
    any usable row gives a model that knows no language (every prediction is ``und``).
    """
    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).where("label is not null and text is not null")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # as many rows as languages
    share = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("label") == name, float(min(1.0, rows_per_language / n))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["label", "text"])
    picked = picked.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"), "text"))).where(F.col("k") <= rows_per_language).drop("k")
    got = picked.mapInArrow(_features, "label string, bucket array<int>, share array<float>").toArrow()
    names = sorted(set(got.column("label").to_pylist()))
    if not names:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    y = np.array([names.index(x) for x in got.column("label").to_pylist()])
    buckets, shares = got.column("bucket").combine_chunks(), got.column("share").combine_chunks()
    feats = [(buckets[i].values.to_numpy(), shares[i].values.to_numpy(zero_copy_only=False)) for i in range(len(y))]
    order = np.lexsort([[int(f[0].sum()) for f in feats], [len(f[0]) for f in feats], y])  # not the order of arrival
    order = np.random.default_rng(seed).permutation(order)
    held = order[: len(order) // 5]
    emb, out, bias = _descend([feats[i] for i in order[len(held) :]], y[order[len(held) :]], len(names), epochs, seed)
    logits = emb @ out
    temperature, reject = 1.0, 0.0
    if len(held) >= 20 and len(names) > 1:
        z = np.array([(logits[feats[i][0]] * feats[i][1][:, None]).sum(axis=0) for i in held]) + bias
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in np.geomspace(0.1, 5, 40)}
        temperature = float(min(loss, key=loss.get))
        p = _softmax(z / temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == y[held]
        best = np.argsort(-score)
        good = np.flatnonzero(np.cumsum(right[best]) / np.arange(1, len(best) + 1) >= precision)
        reject = float(score[best[good[-1]]]) if len(good) else 1.0
    return LanguageModel(names, logits.astype(np.float32), bias, temperature, reject)


def predict(docs: DataFrame, model: LanguageModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row.

    A null text, or one without a letter, gives ``und`` with score 0, not rejected. Whole texts are read. Repeated rows
    give repeated results; other columns of ``docs`` are not touched, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # buckets times languages: of a fixed size

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            n = batch.num_rows
            total, count, letter = np.zeros((n, len(m.languages))), np.zeros(n), np.zeros(n, bool)
            for first, last, data, offsets in blocks(batch.column(1)):
                if last == first + 1 and len(data) > BLOCK_BYTES:
                    for a, b in parts(data):
                        s, c = _sums_of_part(data, a, b, m.logits)
                        total[first] += s
                        count[first] += c
                        letter[first] |= _has_letter(data[a:b], np.array([0, b - a]))[0]
                else:
                    total[first:last], count[first:last] = _sums(data, offsets, m.logits)
                    letter[first:last] = _has_letter(data, offsets)
            best, score = np.full(n, len(m.languages)), np.zeros(n)
            if m.languages:
                p = _softmax((total / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
                best = np.where(letter, p.argmax(axis=1), len(m.languages))
                score = np.where(letter, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(letter & (score < m.reject_below))],
                names=["id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id)


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
