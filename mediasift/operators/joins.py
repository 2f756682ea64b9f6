"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.sources.shared import stored

#: A key is hot if it holds more than one in so many rows; so there are fewer hot keys than this, whatever the size.
HOT_SHARE = 1024
#: Keys of fewer rows are never hot.
HOT_ROWS = 1000
#: Rows of a list that is broadcast, counted first.
FEW = 10_000


def key_sizes(n: str = "n") -> list[Column]:
    """What :func:`with_one` asks of the numbers of rows."""
    return [F.sum(n).alias("total"), F.max(n).alias("most")]


def with_one(rows: DataFrame, one: DataFrame, on: list[str], n: str = "n", sizes: dict | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``one``, a table of one row a key that tells in ``n`` how many of ``rows`` have the key.

    Hot keys are fewer than ``HOT_SHARE`` by their definition, and so are broadcast: their rows stay where they are, spread
    over all tasks. All other keys are joined by sorting. ``rows`` may be read twice and should be a stored table, as should ``one``; null keys
    join nothing; ``n`` is not among the columns that come out. ``sizes`` are :func:`key_sizes` of ``one``, if known.
    """
    sizes = sizes or one.agg(*key_sizes(n)).first().asDict()
    least = max(HOT_ROWS, (sizes["total"] or 0) // HOT_SHARE + 1)
    cold = one.where(F.col(n) < least).drop(n)
    if (sizes["most"] or 0) < least:
        return rows.join(cold.hint("merge"), on)
    hot = stored(one.where(F.col(n) >= least).drop(n), "hot-keys")
    spread = rows.join(F.broadcast(hot), on)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return spread.unionByName(others.join(cold.hint("merge"), on))


def against(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Every row with every row of a list, which is broadcast if it is short and read in blocks by all tasks if not."""
    listed = stored(listed, "list")
    return rows.crossJoin(F.broadcast(listed) if listed.count() <= FEW else listed.hint("shuffle_replicate_nl"))
