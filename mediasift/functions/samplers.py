"""Which frames of an item are looked at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_places(total: Column, n: int, low: float = 0.1, high: float = 0.9) -> Column:
    """Array of at most ``n`` evenly spaced places between the shares ``low`` and ``high`` of ``total``, at least one; null for a null.

    ``total`` may be costly (the length of a text), so it isn't worked out anew for each place: it is the element that a place is made from.
    """

    def place(t: Column, i: Column) -> Column:
        start = F.floor(t * low)
        span = F.greatest(F.lit(1).cast("long"), F.least(t.cast("long"), F.floor(t * high)) - start)
        k = F.least(F.lit(n).cast("long"), span)
        return F.when(i < k, (start + F.floor(span * i / k)).cast("int"))

    places = F.filter(F.transform(F.array_repeat(total, n), place), lambda p: p.isNotNull())
    return F.when(total.isNotNull(), places)


def check_places(total: Column, fps: Column, duration: Column, n: int = 5) -> Column:
    """Array of ``n`` places in the middle second, for items of more than two seconds; else empty."""
    start = F.greatest(F.lit(0).cast("long"), F.floor(total / 2) - F.floor(fps / 2))
    step = F.greatest(F.lit(1).cast("long"), F.floor(fps / n))
    places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (start + step * i).cast("int")), lambda p: p < total)
    return F.when(duration > 2, places).otherwise(F.array().cast("array<int>"))
