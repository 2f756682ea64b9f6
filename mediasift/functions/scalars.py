"""Scalar rules of a media catalog, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
UNITS = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}
TOLERANCE = 0.01
CODES = ("read_failed", "zero_frames", "timeout", "decode_error", "encrypted", "permission", "disk_error", "low_quality")


def parse_size(c: Column) -> Column:
    """``100MB``, ``1.5 GB``, ``7`` -> bytes; null if it is no size. Two-letter units are honoured."""
    number = F.regexp_extract(F.upper(F.trim(c)), r"^([0-9]+(?:\.[0-9]+)?) *([KMGT]?B)?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(c)), r"^([0-9]+(?:\.[0-9]+)?) *([KMGT]?B)?$", 2)
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.when(unit == "", "B").otherwise(unit))
    return F.when(number != "", F.floor(number.cast("double") * factor).cast("long"))


def duration_filter(rule: str, duration: Column) -> Column:
    """``>=60``, ``>120&<=360`` ...: the conjunction of its parts; ``==`` and ``!=`` within 0.01; bad parts are ignored."""
    ops = {
        ">=": lambda v: duration >= v,
        "<=": lambda v: duration <= v,
        "!=": lambda v: F.abs(duration - v) > TOLERANCE,
        "==": lambda v: F.abs(duration - v) <= TOLERANCE,
        ">": lambda v: duration > v,
        "<": lambda v: duration < v,
    }
    parts = [re.fullmatch(r"\s*(>=|<=|!=|==|>|<)\s*([0-9]+(?:\.[0-9]+)?)\s*", p) for p in rule.split("&")]
    return reduce(lambda a, b: a & b, [ops[m[1]](float(m[2])) for m in parts if m], F.lit(True))


def format_size(n: Column) -> Column:
    whole, n = n.cast("long"), n.cast("double")
    steps = F.when(n < UNITS["KB"], F.format_string("%d B", whole)).when(n < UNITS["MB"], F.format_string("%.2f KB", F.bround(n / UNITS["KB"], 2)))
    return steps.when(n < UNITS["GB"], F.format_string("%.2f MB", F.bround(n / UNITS["MB"], 2))).otherwise(F.format_string("%.2f GB", F.bround(n / UNITS["GB"], 2)))


def format_duration(s: Column) -> Column:
    s = F.floor(s).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def duration_bucket(s: Column) -> Column:
    return F.when(F.coalesce(s, F.lit(0.0)) <= 0, "unknown").when(s < 30, "<30s").when(s < 60, "30-60s").when(s < 180, "1-3min").when(s < 600, "3-10min").otherwise(">10min")


def resolution_tier(w: Column, h: Column) -> Column:
    short = F.least(w, h)
    return F.when(F.coalesce(short, F.lit(0)) <= 0, "unknown").when(short >= 2160, "4K+").when(short >= 1440, "2K").when(short >= 1080, "1080p").when(short >= 720, "720p").otherwise("SD")


def size_bucket(n: Column) -> Column:
    return F.when(n < 10 * UNITS["MB"], "<10MB").when(n < 100 * UNITS["MB"], "10-100MB").when(n < UNITS["GB"], "100MB-1GB").otherwise(">1GB")


def quality_bucket(q: Column) -> Column:
    return F.when(q.isNull(), "unscored").when(q < 0.3, "<0.3").when(q < 0.5, "0.3-0.5").when(q < 0.7, "0.5-0.7").when(q < 0.9, "0.7-0.9").otherwise(">=0.9")


def organise_class(by: str, duration: Column, height: Column, purpose: Column | None = None) -> Column:
    """Category of a file: by ``duration`` (minutes), by ``resolution`` (height) or by ``purpose``."""
    if by == "duration":
        return F.when(F.coalesce(duration, F.lit(0.0)) <= 0, "unknown").when(duration < 60, "<1min").when(duration < 300, "1-5min").when(duration < 1800, "5-30min").otherwise(">30min")
    if by == "resolution":
        return F.when(F.coalesce(height, F.lit(0)) <= 0, "unknown").when(height < 720, "<720p").when(height < 1080, "720p").when(height < 2160, "1080p").otherwise("4K")
    return F.coalesce(purpose, F.lit("unknown"))


def safe_dir_name(c: Column) -> Column:
    clean = F.trim(F.regexp_replace(c, '[<>:"/\\\\|?*]', ""))
    return F.when(F.coalesce(clean, F.lit("")) == "", "other").otherwise(clean)


def mask_path(path: Column) -> Column:
    """Up to four parts unchanged; else the first part, ``//.../``, and the last two."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) <= 4, path).otherwise(F.concat(F.get(parts, 0), F.lit("//.../"), F.array_join(F.slice(parts, -2, 2), "/")))


def mask_path_ends(path: Column) -> Column:
    """Up to two parts unchanged; else first and last part around ``\\...\\``."""
    bare = F.regexp_replace(path, r"^\\\\\?\\", "")
    parts = F.filter(F.split(F.replace(bare, F.lit("/"), F.lit("\\")), r"\\"), lambda p: p != "")
    return F.when(F.size(parts) <= 2, bare).otherwise(F.concat(F.get(parts, 0), F.lit("\\...\\"), F.element_at(parts, -1)))


def is_inside(path: Column, folder: Column) -> Column:
    """The folder itself, or below it; never a name that merely begins alike; case does not count."""
    p, f = F.lower(path), F.regexp_replace(F.lower(folder), "/+$", "")
    return (p == f) | F.startswith(p, F.concat(f, F.lit("/")))


def metadata_quality(size: Column, duration: Column, width: Column, height: Column) -> Column:
    """0 to 100: 65 % for pixels (up to 1920x1080), 35 % for bytes a second (up to 8 MiB); 50 if both are unknown."""
    pixels = (F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0))).cast("double")
    rate = F.when(F.coalesce(duration, F.lit(0.0)) > 0, size / duration).otherwise(0.0)
    score = F.least(F.lit(1.0), pixels / 2073600.0) * 65 + F.least(F.lit(1.0), rate / (8.0 * UNITS["MB"])) * 35
    return F.when((pixels <= 0) & (rate <= 0), 50.0).otherwise(F.round(score, 2))


def valid_label(c: Column) -> Column:
    """At least two characters and a letter of any script."""
    t = F.trim(c)
    return F.coalesce((F.length(t) >= 2) & t.rlike(r"\p{L}"), F.lit(False))


def extension(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    return F.when(ext == "", "[unknown]").otherwise(ext)


def tag_names(tags: Column) -> Column:
    """Labels of an array of (label, score), joined; ``-`` if there are none."""
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.array_join(F.transform(tags, lambda t: t["label"]), ", ")).otherwise("-")


def label_verdict(n: Column, intra: Column, inter: Column) -> Column:
    return (
        F.when((n < 2) | intra.isNull(), "insufficient")
        .when(intra >= F.greatest(F.lit(0.7), inter + 0.15), "consistent")
        .when(intra >= F.greatest(F.lit(0.5), inter + 0.05), "mostly_consistent")
        .otherwise("suspicious")
    )


def label_tokens(label: Column) -> Column:
    return F.split(F.lower(F.replace(label, F.lit("+"), F.lit("-"))), "-")
