"""Expressions over 64-bit fingerprints (signed BIGINT) and lists of them. All of them are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64
BANDS, BAND_BITS = 4, 16
#: Fixed values of the fused similarity.
P_WEIGHT, D_WEIGHT, AUDIO_FACTOR, AUDIO_GATE = 0.7, 0.3, 0.8, 0.3


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_hex(c: Column | str) -> Column:
    """Hex string of up to 16 digits -> BIGINT."""
    return F.conv(col(c), 16, -10).cast("long")


def to_hex(c: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(col(c))), 16, "0")


def hamming(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def band_keys(h: Column | str, bucket_count: int | None = 32) -> Column:
    """Array of the four 16-bit bands, each modulo ``bucket_count`` (None: the whole band)."""
    keys = [F.shiftrightunsigned(col(h), BAND_BITS * k).bitwiseAND(F.lit((1 << BAND_BITS) - 1)) for k in range(BANDS)]
    return F.array(*[k if bucket_count is None else k % bucket_count for k in keys])


def nearest_sum(a: Column | str, b: Column | str) -> Column:
    """Sum over the hashes of ``a`` of the Hamming distance to the nearest hash of ``b``, an integer."""
    nearest = F.transform(col(a), lambda x: F.array_min(F.transform(col(b), lambda y: hamming(x, y))))
    return F.aggregate(nearest, F.lit(0).cast("long"), lambda n, d: n + d)


def _present(c: Column | str) -> Column:
    return F.coalesce(F.size(col(c)) > 0, F.lit(False))


def list_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - mean distance to the nearest hash / 64; directional, from a to b. Empty or null lists: 0."""
    return F.when(_present(a) & _present(b), 1 - nearest_sum(a, b) / (F.size(col(a)) * BITS)).otherwise(0.0)


def symmetric_similarity(a: Column | str, b: Column | str) -> Column:
    return (list_similarity(a, b) + list_similarity(b, a)) / 2


def symmetric_with_foreground(a: Column | str, b: Column | str, fa: Column | str, fb: Column | str) -> Column:
    """Symmetric similarity of the whole frames and of their foregrounds, half each, if both items have a foreground."""
    whole = symmetric_similarity(a, b)
    return F.when(_present(fa) & _present(fb), (whole + symmetric_similarity(fa, fb)) / 2).otherwise(whole)


def fused_similarity(pa: Column, da: Column, aa: Column, pb: Column, db: Column, ab: Column, weights: tuple[float, float] = (P_WEIGHT, D_WEIGHT), audio_factor: float = AUDIO_FACTOR) -> Column:
    """Weighted pHash and dHash similarity; one of them alone if side a lacks the other; lowered if the sound differs."""
    p, d = list_similarity(pa, pb), list_similarity(da, db)
    both = p * weights[0] + d * weights[1]
    visual = F.when(_present(pa) & _present(da), both).when(_present(pa), p).when(_present(da), d).otherwise(0.0)
    sounds = _present(aa) & _present(ab)
    heard = F.when(sounds & (list_similarity(aa, ab) < AUDIO_GATE), visual * audio_factor).otherwise(visual)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), heard))


def duration_too_different(a: Column | str, b: Column | str, ratio: float = 0.2) -> Column:
    """Both known (above 0), and further apart than ``ratio`` of the longer."""
    a, b = col(a), col(b)
    return (a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b) > ratio)
