"""Quality scores: attention-based multiple-instance learning over passages.

A document is a bag of passages. Every passage is encoded (hashed byte-trigram and character-class shares through a
tanh layer), a gated attention network gives each passage a weight, and the weighted mean of the encodings is scored
by a logistic layer. All layers are learned together from document labels (Adam, in numpy), on a bounded sample of
labelled documents; sampling is undone by weights, so a score of 0.5 means what it means over all labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.textbytes import LOWER, blocks

PASSAGE_BYTES = 800
#: Texts are looked at in blocks of so many bytes; a byte takes some 60 bytes of working memory.
BLOCK = 1 << 20
BINS = 64
#: Byte classes whose share of a passage is a feature.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n\r\t", ".,;:", "!?", "'\"()[]{}", "*#", "$%&@", "|\\/<>=_-+~^`"]
WIDTH = BINS + len(CLASSES) + 3
HIDDEN, GATE = 24, 12
#: Documents of each label that the model learns from, at most about, and passages of each of them (evenly spread over a
#: longer one), so that the sample has a bound in bytes as well. Scores are of all passages.
ROWS_PER_LABEL, PASSAGES_PER_ROW = 1500, 256

_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c.encode())] = _k


@dataclass(frozen=True)
class QualityModel:
    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray


def _codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bin of the three bytes from each byte on; bytes beyond a text's end read as 0, so that its neighbours don't count."""
    n = len(data)
    low = LOWER[data].astype(np.uint32)
    code = np.zeros(n, np.uint32)
    for i in range(3):
        later = np.zeros(n, np.uint32)
        later[: max(0, n - i)] = low[i:]
        for j in range(1, i + 1):
            later[(offsets[1:] - j)[offsets[1:] >= j]] = 0
        code = (code ^ later) * np.uint32(0x01000193)
    return (code ^ code >> np.uint32(13)) % np.uint32(BINS)


def _shares(x: np.ndarray, data: np.ndarray, code: np.ndarray, at: np.ndarray) -> None:
    """Write into ``x`` what the bytes of each passage (``at``) are like."""
    m = len(x)
    size = np.maximum(np.bincount(at, minlength=m), 1)[:, None]
    grams = np.bincount(at * BINS + code, minlength=m * BINS).reshape(m, BINS) / size
    kinds = np.bincount(at * (len(CLASSES) + 1) + _CLASS[data], minlength=m * (len(CLASSES) + 1)).reshape(m, -1) / size
    x[:, :BINS] = np.sqrt(grams)
    x[:, BINS : BINS + kinds.shape[1]] = np.sqrt(kinds)
    x[:, -2] = (grams**2).sum(axis=1)  # high where a passage repeats itself


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of each text); an empty text has one passage of zeros.

    A text is cut into equal passages by its length alone. One that is longer than a block is looked at some passages at a
    time, each time with the bytes that its last features reach for, so the features are the same.
    """
    lens = np.diff(offsets)
    number = np.maximum(1, -(-lens // PASSAGE_BYTES))
    first = np.concatenate([[0], np.cumsum(number)])
    n, m = len(data), int(first[-1])
    x = np.zeros((m, WIDTH), np.float64)
    if len(lens) == 1 and n > BLOCK:
        for p in range(0, m, BLOCK // PASSAGE_BYTES):
            q = min(m, p + BLOCK // PASSAGE_BYTES)
            a, b = -(-p * n // m), -(-q * n // m)  # the first bytes of both passages
            near = data[a : min(n, b + 2)]
            _shares(x[p:q], data[a:b], _codes(near, np.array([0, len(near)]))[: b - a], np.arange(a, b) * m // n - p)
    elif n:
        doc = np.repeat(np.arange(len(lens)), lens)
        _shares(x, data, _codes(data, offsets), (np.arange(n) - offsets[:-1][doc]) * number[doc] // lens[doc] + first[:-1][doc])
    x[:, -1] = np.repeat(np.log1p(lens), number) / 10
    return x, first


def _starts(first: np.ndarray) -> np.ndarray:
    return first[:-1]


def _forward(w: dict, x: np.ndarray, first: np.ndarray) -> dict:
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = np.tanh(x @ w["enc"] + w["enc0"])
    t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-np.clip(h @ w["u"], -30, 30)))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, _starts(first))[bag])
    att = e / np.add.reduceat(e, _starts(first))[bag]
    z = np.add.reduceat(att[:, None] * h, _starts(first), axis=0)
    return {"bag": bag, "h": h, "t": t, "g": g, "att": att, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["out"] + w["out0"], -30, 30)))}


def _gradients(w: dict, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    f = _forward(w, x, first)
    d = (f["p"] - y) * weight / weight.sum()
    dz = d[:, None] * w["out"]
    dh = f["att"][:, None] * dz[f["bag"]]
    datt = (f["h"] * dz[f["bag"]]).sum(axis=1)
    de = f["att"] * (datt - np.add.reduceat(f["att"] * datt, _starts(first))[f["bag"]])
    dt, dg = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (dh + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
    return {"out": f["z"].T @ d, "out0": d.sum(), "a": (f["t"] * f["g"]).T @ de, "v": f["h"].T @ dt, "u": f["h"].T @ dg, "enc": x.T @ dh, "enc0": dh.sum(axis=0)}


def _learn(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int, steps: int = 900) -> QualityModel:
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in (("enc", (WIDTH, HIDDEN)), ("v", (HIDDEN, GATE)), ("u", (HIDDEN, GATE)), ("a", (GATE,)), ("out", (HIDDEN,)))}
    share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    w |= {"enc0": np.zeros(HIDDEN), "out0": np.log(share / (1 - share))}
    moved, spread = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(bags), min(64, len(bags)))
        first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
        grads = _gradients(w, (np.concatenate([bags[i] for i in pick]) - mean) / scale, first, y[pick], weight[pick])
        for k, g in grads.items():
            g = g + 1e-4 * w[k]
            moved[k] = 0.9 * moved[k] + 0.1 * g
            spread[k] = 0.999 * spread[k] + 0.001 * g * g
            w[k] = w[k] - 0.01 * (1 - step / (steps + 1)) * (moved[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(w, mean, scale)


def _bag_rows(batches):
    for batch in batches:
        label, share, bags = [], [], []
        for first, _, data, offsets in blocks(batch.column(2), BLOCK):
            x, start = passages(data, offsets)
            for i in range(len(offsets) - 1):
                label.append(batch.column(0)[first + i].as_py())
                share.append(batch.column(1)[first + i].as_py())
                bag = x[start[i] : start[i + 1]]
                if len(bag) > PASSAGES_PER_ROW:
                    bag = bag[np.arange(PASSAGES_PER_ROW) * len(bag) // PASSAGES_PER_ROW]
                bags.append(bag.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(share, pa.float64()), pa.array(bags, pa.binary())], names=["label", "share", "bag"])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows_per_label: int = ROWS_PER_LABEL, seed: int = 11) -> QualityModel | float:
    """Learn from the documents whose label is 0 or 1; null labels and ids are left out, a null text is empty.

    About ``rows_per_label`` labelled ids of each label are used, chosen by a hash of the id, so what is broadcast to
    the scan of the texts has a bound; a label that repeats counts once, and of rows that repeat an id the least text. With
    one label only, or none, the result is a constant score (that label, or 0.5).
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and id is not null").distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    share = F.when(F.col("label") == 1, min(1.0, rows_per_label / counts[1])).otherwise(min(1.0, rows_per_label / counts[0]))
    picked = known.withColumn("share", share).where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    texts = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "id").groupBy("id", "label", "share").agg(F.min("text").alias("text"))
    got = sample.select("label", "share", "text").mapInArrow(_bag_rows, "label int, share double, bag binary").toPandas()
    if got["label"].nunique() < 2:
        return float(counts[1] / (counts[0] + counts[1]))
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH).astype(np.float64) for b in got["bag"]]
    order = sorted(range(len(bags)), key=lambda i: (got["label"][i], len(bags[i]), got["bag"][i][:64]))  # not that of arrival
    return _learn([bags[i] for i in order], got["label"].to_numpy()[order].astype(float), 1 / got["share"].to_numpy()[order], seed)


def _score(model: QualityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x, first = passages(data, offsets)
    return _forward(model.weights, (x - model.mean) / model.scale, first)["p"]


def score(docs: DataFrame, model: QualityModel | float, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, predicted) for every row, from the whole text.

    Null and empty texts are scored alike, as one passage without content. Repeated rows give repeated results; other
    columns of ``docs`` are not touched, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        m = shared.value
        for batch in batches:
            s = np.full(batch.num_rows, m if isinstance(m, float) else 0.0)
            if not isinstance(m, float):
                for first, last, data, offsets in blocks(batch.column(1), BLOCK):
                    s[first:last] = _score(m, data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(s, 9)), pa.array((np.round(s, 9) >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id)


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def model_of(spark, sf_dir: str, docs: DataFrame) -> QualityModel | float:
    """Learned from the labelled rows of ``docs`` that are not held out."""
    from mediasift.sources.tables import table

    return train(docs, table(spark, sf_dir, "labels").where(~held_out()))


def query(spark, sf_dir: str) -> DataFrame:
    from mediasift.sources.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, model_of(spark, sf_dir, docs)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
