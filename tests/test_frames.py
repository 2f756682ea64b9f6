import numpy as np
from pyspark.sql import functions as F

from mediasift.operators import frames as X


def stripes(shift=0, add=0):
    y, x = np.mgrid[:64, :64]
    return np.clip(np.where((x + shift) // 8 % 2, 200, 40) + 20 * ((x - 30) ** 2 + (y - 30) ** 2 < 200) + add, 0, 255).astype(np.uint8)


def other():
    y, x = np.mgrid[:64, :64]
    return np.where(y < 32, 30, np.where(x > y, 220, 90)).astype(np.uint8)


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def frame_rows(images, id=1, burst=0):
    return [(id, burst, k, *(g.shape if g is not None else (64, 64)), bytearray(g.tobytes()) if g is not None else None) for k, g in enumerate(images)]


SCHEMA = "id long, burst int, frame_no int, h int, w int, pixels binary"


def test_hash_properties():
    for h in (X.phash, X.dhash):
        assert h(stripes()) == h(stripes())
        assert bits(h(stripes()), h(stripes(add=6))) <= 6
        assert bits(h(stripes()), h(other())) >= 12


def test_signatures_and_errors(spark):
    frames = spark.createDataFrame(frame_rows([stripes(), other()], 1) + frame_rows([None], 2), SCHEMA)
    good, bad = X.signatures(spark.createDataFrame([(1,), (2,), (3,)], "id long"), frames)
    r = good.collect()
    assert len(r) == 1 and list(r[0]["phash"]) == [X.phash(stripes()), X.phash(other())]
    assert {(x["id"], x["error_type"]) for x in bad.collect()} == {(2, "decode_error"), (3, "zero_frames")}


def test_motion(spark):
    frames = spark.createDataFrame(frame_rows([stripes(k * 4) for k in range(6)], 1) + frame_rows([stripes()] * 6, 2), SCHEMA)
    got = {r["id"]: r["motion_mean"] for r in X.motion(frames).collect()}
    assert got[1] > 10 and got[2] == 0


def test_foreground(spark):
    moving = []
    for k in range(5):
        g = np.full((64, 64), 50, np.uint8)
        g[10:20, 10 * k : 10 * k + 10] = 200
        moving.append(g)
    frames = spark.createDataFrame(frame_rows(moving, 1) + frame_rows([stripes()] * 2, 2), SCHEMA)
    got = {r["id"]: r for r in X.foreground(frames).collect()}
    assert 0 < got[1]["motion_ratio"] < 0.1 and len(got[1]["fg_phash"]) == 5
    assert got[2]["motion_ratio"] == 1.0 and not got[2]["fg_phash"]


def test_keyframes(spark):
    dark, light = np.full((64, 64), 30, np.uint8), np.full((64, 64), 220, np.uint8)
    frames = spark.createDataFrame(frame_rows([dark] * 3 + [light] * 3, 1) + frame_rows([dark] * 4, 2), SCHEMA)
    assert sorted((r["id"], r["frame_no"]) for r in X.keyframes(frames).collect()) == [(1, 0), (1, 3)]


def test_quality(spark):
    flat = np.full((64, 64), 5, np.uint8)
    frames = spark.createDataFrame(frame_rows([stripes(k) for k in range(4)], 1) + frame_rows([flat], 2), SCHEMA)
    got = {r["id"]: r["quality"] for r in X.frame_quality(frames).collect()}
    assert got[1] > got[2] and 0 <= got[2] <= 1


def test_many_items_of_mixed_shapes_at_once(spark):
    rng = np.random.default_rng(3)
    items = {k: [rng.integers(0, 256, ((8, 9), (64, 64))[k % 2]).astype(np.uint8) for _ in range(3 + k % 3)] for k in range(20)}
    items[20] = [stripes(), None, other(), stripes(3)]  # three can be read
    items[21] = [stripes(), other(), items[0][0]]  # of two shapes
    frames = spark.createDataFrame([row for k, images in items.items() for row in frame_rows(images, k)], SCHEMA)
    got = {r["id"]: r for r in X.foreground(frames).collect()}
    for k, images in items.items():
        images = [g for g in images if g is not None]
        if k == 21:
            assert got[k]["motion_ratio"] == 1.0 and got[k]["fg_phash"] == []
            continue
        stack = np.stack(images).astype(int)
        back = np.median(stack, axis=0)
        mask = np.abs(stack - back) > X.FOREGROUND
        assert got[k]["motion_ratio"] == mask.mean() and got[k]["fg_phash"] == [X.phash(f) for f in np.where(mask, stack, back)]
    one = [g for images in items.values() for g in images if g is not None and g.shape == (8, 9)]
    assert X.phashes(np.stack(one)).tolist() == [X.phash(g) for g in one] and X.dhashes(np.stack(one)).tolist() == [X.dhash(g) for g in one]
    plan = X.foreground(frames)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan  # no Python call for each item
