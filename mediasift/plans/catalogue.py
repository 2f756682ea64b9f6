"""All registered queries of the media operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediasift.plans import q_frames, q_labels, q_pairs, q_reports, q_scalars, q_semantic, q_store
from mediasift.plans.registry import QUERIES, SQL

MODULES = (q_pairs, q_scalars, q_labels, q_semantic, q_store, q_frames, q_reports)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups and the bytes that each would free."""
    return QUERIES["e8_space_report"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
