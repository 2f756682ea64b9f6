"""Features of frame rows: hashes, motion, foreground, keyframes, quality. Pixel kernels are numpy over Arrow batches.

Frames come as rows (id, frame_no, h, w, pixels), pixels being 8-bit grays, row by row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
SIDE, LOW = 32, 8
FOREGROUND, KEY_DISTANCE, KEYS = 18, 30.0, 5
#: Numbers of images that are worked out at once.
STACK = 4 << 20
QUALITY = (0.35, 0.25, 0.25, 0.15)


def resample(n: int, m: int) -> np.ndarray:
    """Matrix (m x n) that averages n values into m by the overlap of their intervals."""
    edges = np.linspace(0, n, m + 1)
    lo, hi = edges[:-1, None], edges[1:, None]
    cover = np.clip(np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n)), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """One image, or many of one shape."""
    return resample(image.shape[-2], h) @ image @ resample(image.shape[-1], w).T


def _dct() -> np.ndarray:
    k, i = np.arange(SIDE)[:, None], np.arange(SIDE)
    return np.cos(np.pi * k * (2 * i + 1) / (2 * SIDE))


def _bits(flags: np.ndarray) -> np.ndarray:
    """A number for each of many times 64 flags."""
    return np.packbits(flags.reshape(len(flags), -1), axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)


def phashes(images: np.ndarray) -> np.ndarray:
    """64 bits of each of many images of one shape: low frequencies of the cosine transform of the 32 x 32 image, above their median."""
    d = _dct()[:LOW]
    low = d @ resized(images.astype(float), SIDE, SIDE) @ d.T
    return _bits(low > np.median(low, axis=(1, 2), keepdims=True))


def dhashes(images: np.ndarray) -> np.ndarray:
    """64 bits of each of many images of one shape: is each pixel of the 8 x 9 image brighter than the one left of it?"""
    small = np.floor(resized(images.astype(float), LOW, LOW + 1) + 0.5)
    return _bits(small[:, :, 1:] > small[:, :, :-1])


def phash(image: np.ndarray) -> int:
    return int(phashes(image[None])[0])


def dhash(image: np.ndarray) -> int:
    return int(dhashes(image[None])[0])


def image(pixels: bytes | None, h: int, w: int) -> np.ndarray | None:
    return None if pixels is None or len(pixels) != h * w or not h * w else np.frombuffer(pixels, np.uint8).reshape(h, w)


def stacks(pixels: list[bytes | None], h: np.ndarray, w: np.ndarray):
    """(places, images) of the frames that can be read, those of one shape together, so many at a time."""
    shapes: dict = {}
    for k, (p, *shape) in enumerate(zip(pixels, h, w, strict=True)):
        if p is not None and shape[0] and shape[1] and len(p) == shape[0] * shape[1]:
            shapes.setdefault(tuple(shape), []).append(k)
    for (height, width), places in shapes.items():
        step = max(1, STACK // int(max(height * width, SIDE * SIDE)))
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield some, np.frombuffer(b"".join(pixels[k] for k in some), np.uint8).reshape(len(some), int(height), int(width))


def hashed(frames: DataFrame) -> DataFrame:
    """``frames`` with ``phash`` and ``dhash``; null for a frame that can't be read."""

    @F.pandas_udf("phash long, dhash long")
    def both(pixels: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        out, there = np.zeros((2, len(pixels)), np.int64), np.zeros(len(pixels), bool)
        for places, images in stacks(pixels.to_list(), h.to_list(), w.to_list()):
            out[0, places], out[1, places], there[places] = phashes(images), dhashes(images), True
        return pd.DataFrame({c: pd.arrays.IntegerArray(v, ~there) for c, v in zip(("phash", "dhash"), out, strict=True)})

    return frames.withColumn("_h", both("pixels", "h", "w")).select(*frames.columns, "_h.phash", "_h.dhash")


def signatures(catalog: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, phash, dhash) with lists in frame order, and (id, error_type) of the items without any hash."""
    h = hashed(frames)
    pack = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("frame_no", c)))), lambda s: s[c])
    of = h.groupBy("id").agg(pack("phash").alias("phash"), pack("dhash").alias("dhash"), F.count(F.lit(1)).alias("n"))
    every = catalog.select("id").join(of.hint("merge"), "id", "left")
    error = F.when(F.col("n").isNull(), "zero_frames").when(F.size("phash") == 0, "decode_error")
    return every.where(error.isNull()).select("id", "phash", "dhash"), every.where(error.isNotNull()).select("id", error.alias("error_type"))


def audio_chunks(samples: DataFrame, chunks: int, least: int) -> DataFrame:
    """(id, chunk, h): mean loudness, rounded down, of equal chunks of each item with at least ``least`` samples (id, pos, sample)."""
    sizes = samples.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    chunk = F.least(F.lit(chunks - 1).cast("long"), F.floor(F.col("pos") / F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / chunks))))
    return samples.join(sizes.hint("merge"), "id").groupBy("id", chunk.alias("chunk")).agg(F.floor(F.avg(F.abs("sample"))).alias("h"))


def scalar_motion(rows: DataFrame) -> DataFrame:
    """(id, motion_mean, motion_std) of rows (id, burst, at, value): mean step inside bursts, over the bursts."""
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("id", "burst").orderBy("at")))
    bursts = rows.withColumn("step", step).groupBy("id", "burst").agg(F.avg("step").alias("m")).where("m is not null")
    return bursts.groupBy("id").agg(F.avg("m").alias("motion_mean"), F.stddev_pop("m").alias("motion_std"))


def motion(frames: DataFrame) -> DataFrame:
    """(id, motion_mean, motion_std) of frames with a ``burst``: mean difference of neighbouring frames, over the bursts."""

    @F.pandas_udf("double")
    def gap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or len(x) != len(y) or not len(x) else float(np.abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(y, np.uint8)).mean()) for x, y in zip(a, b, strict=True)], dtype="float64")

    w = Window.partitionBy("id", "burst").orderBy("frame_no")
    steps = frames.withColumn("_before", F.lag("pixels").over(w)).where("_before is not null").select("id", "burst", gap("_before", "pixels").alias("step"))
    bursts = steps.groupBy("id", "burst").agg(F.avg("step").alias("m")).where("m is not null")
    return bursts.groupBy("id").agg(F.avg("m").alias("motion_mean"), F.stddev_pop("m").alias("motion_std"))


def _foregrounds(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pHashes, dHashes, share that differs) of many items with as many frames each of one shape (items x frames x h x w)."""
    stack = images.astype(np.int16)
    back = np.median(stack, axis=1, keepdims=True)
    mask = np.abs(stack - back) > FOREGROUND
    fore = np.where(mask, stack, back).reshape(-1, *images.shape[2:])
    return phashes(fore).reshape(images.shape[:2]), dhashes(fore).reshape(images.shape[:2]), mask.reshape(len(mask), -1).mean(1)


def foreground(frames: DataFrame) -> DataFrame:
    """(id, fg_phash, fg_dhash, motion_ratio): hashes of what differs from the median of an item's sampled frames.

    Fewer than three frames: empty lists and 1.0. A row is one item's few sampled frames; items with equally many frames of
    one shape are worked out together.
    """

    @F.pandas_udf("fg_phash array<long>, fg_dhash array<long>, motion_ratio double")
    def every(lists: pd.Series) -> pd.DataFrame:
        p, d, ratio, alike = [[] for _ in lists], [[] for _ in lists], np.ones(len(lists)), {}
        for k, item in enumerate(lists):
            got = [x for x in item if x["pixels"] is not None and x["h"] and x["w"] and len(x["pixels"]) == x["h"] * x["w"]]
            if len(got) >= 3 and len({(x["h"], x["w"]) for x in got}) == 1:
                alike.setdefault((len(got), got[0]["h"], got[0]["w"]), []).append((k, b"".join(x["pixels"] for x in got)))
        for (n, h, w), items in alike.items():
            step = max(1, STACK // (n * max(h * w, SIDE * SIDE)))
            for at in range(0, len(items), step):
                places, pixels = zip(*items[at : at + step], strict=True)
                a, b, shares = _foregrounds(np.frombuffer(b"".join(pixels), np.uint8).reshape(len(places), n, h, w))
                for k, x, y, share in zip(places, a, b, shares, strict=True):
                    p[k], d[k], ratio[k] = x, y, share
        return pd.DataFrame({"fg_phash": p, "fg_dhash": d, "motion_ratio": ratio})

    items = frames.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("frame_no").isNull().alias("last"), "frame_no", "h", "w", "pixels"))).alias("_frames"))
    return items.select("id", every("_frames").alias("_f")).select("id", "_f.fg_phash", "_f.fg_dhash", "_f.motion_ratio")


def keyframes(frames: DataFrame, distance: float = KEY_DISTANCE, most: int = KEYS) -> DataFrame:
    """(id, frame_no) of the first frame and those whose gray histogram is far (Bhattacharyya x 100) from the sample
    before, at most ``most``; an item that never changes has none."""

    @F.pandas_udf("array<double>")
    def histogram(pixels: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.frombuffer(p, np.uint8), minlength=256) / max(1, len(p)) if p is not None else None for p in pixels])

    w = Window.partitionBy("id").orderBy("frame_no")
    h = frames.select("id", "frame_no", histogram("pixels").alias("hist")).withColumn("_before", F.lag("hist").over(w))
    overlap = F.aggregate(F.zip_with("hist", "_before", lambda a, b: F.sqrt(a * b)), F.lit(0.0), lambda s, x: s + x)
    far = F.sqrt(F.greatest(F.lit(0.0), 1 - overlap)) * 100 > distance
    keys = h.where(F.col("_before").isNull() | far).withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    many = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return keys.withColumn("n", many).where("n > 1").select("id", "frame_no")


def frame_quality(frames: DataFrame) -> DataFrame:
    """(id, quality): sharpness, brightness, edges and steadiness, weighted, four places; 0.5 for the steadiness of one frame."""

    @F.pandas_udf("sharp double, bright double, edge double")
    def stats(pixels: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = []
        for x in zip(pixels, h, w, strict=True):
            g = image(*x)
            if g is None or min(g.shape) < 3:
                out.append((None, None, None))
                continue
            g = g.astype(float)
            lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
            gx, gy = g[1:-1, 2:] - g[1:-1, :-2], g[2:, 1:-1] - g[:-2, 1:-1]
            out.append((min(1.0, lap.var() / 500), 1 - abs(g.mean() - 128) / 128, min(1.0, float((np.hypot(gx, gy) > 100).mean()) * 8)))
        return pd.DataFrame(out, columns=["sharp", "bright", "edge"], dtype="float64")

    @F.pandas_udf("double")
    def gap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or len(x) != len(y) or not len(x) else float(np.abs(np.frombuffer(x, np.uint8).astype(int) - np.frombuffer(y, np.uint8)).mean() / 255) for x, y in zip(a, b, strict=True)], dtype="float64")

    w = Window.partitionBy("id").orderBy("frame_no")
    rows = frames.withColumn("_s", stats("pixels", "h", "w")).withColumn("_before", F.lag("pixels").over(w))
    rows = rows.select("id", "_s.*", gap("_before", "pixels").alias("d")).withColumn("steady", 1 - F.least(F.lit(1.0), F.abs(F.col("d") - 0.02) * 20))
    q = rows.groupBy("id").agg(*[F.avg(c).alias(c) for c in ("sharp", "bright", "edge")], F.coalesce(F.avg("steady"), F.lit(0.5)).alias("steady"))
    total = sum(F.coalesce(F.col(c), F.lit(0.0)) * v for c, v in zip(("sharp", "bright", "edge", "steady"), QUALITY, strict=True))
    return q.select("id", F.round(total, 4).alias("quality"))
