"""Tables for export: pairs, and the members of groups, with what is known about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.operators.groups import similarity_level
from mediasift.operators.joins import with_one
from mediasift.sources.shared import stored

#: Tags that are shown of an item.
TAGS = 3


def _shown(semantic: DataFrame, suffix: str = "") -> DataFrame:
    """(id, scenes, purpose) as text, ``-`` for none."""
    text = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    return semantic.select("id", text(F.array_join(F.slice("scenes", 1, TAGS), ", ")).alias(f"scenes{suffix}"), text(F.col("purpose")).alias(f"purpose{suffix}"))


def _beside(rows: DataFrame, key: str, info: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``info`` (id, ...) of the item ``key``, which may be in any share of the rows."""
    rows = stored(rows, "export-rows")
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return with_one(rows, stored(often.join(info.withColumnRenamed("id", key).hint("merge"), key, "left"), "export-info"), [key])


def pair_table(pairs: DataFrame, files: DataFrame, threshold: float = 0.85, semantic: DataFrame | None = None, lite: bool = False) -> DataFrame:
    """(path_a, path_b, distance, similarity, duplicate) of pairs (a, b, distance, similarity): distance to six places, similarity to four,
    and whether it reaches the threshold. ``lite`` gives paths and similarity alone; ``semantic`` (id, scenes, purpose) adds
    scenes_a, purpose_a, scenes_b and purpose_b."""
    out = pairs.select("a", "b", "distance", "similarity")
    for side in "ab":
        info = files.select("id", F.col("path").alias(f"path_{side}"))
        if semantic is not None and not lite:
            info = info.join(_shown(semantic, f"_{side}").hint("merge"), "id", "left").na.fill("-", [f"scenes_{side}", f"purpose_{side}"])
        out = _beside(out, side, info)
    columns: list[str | Column] = ["path_a", "path_b", F.round("similarity", 4).alias("similarity")]
    if not lite:
        columns += [F.round("distance", 6).alias("distance"), (F.col("similarity") >= threshold).alias("duplicate")]
        columns += [f"{c}_{s}" for s in "ab" for c in ("scenes", "purpose")] if semantic is not None else []
    return out.select(*columns)


def group_table(marked: DataFrame, similarities: DataFrame, semantic: DataFrame | None = None, min_sim: float = 0.0) -> DataFrame:
    """(group_id, rank, mark, path, size, max_similarity, level) of the members (group_id, id, rank, retained, path, size) of the groups whose
    largest similarity (group_id, max_similarity) is ``min_sim`` or more; ``semantic`` adds scenes and purpose."""
    members = stored(marked.select("group_id", "id", "rank", "retained", "path", "size"), "group-members")
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    shown = similarities.where(F.col("max_similarity") >= min_sim).join(sizes.hint("merge"), "group_id")
    rows = with_one(members, stored(shown, "shown-groups"), ["group_id"])
    extra = []
    if semantic is not None:
        rows = rows.join(_shown(semantic).hint("merge"), "id", "left").na.fill("-", ["scenes", "purpose"])
        extra = ["scenes", "purpose"]
    mark = F.when(F.col("retained"), "keep").otherwise("clean")
    return rows.select("group_id", "rank", mark.alias("mark"), "path", "size", F.round("max_similarity", 4).alias("max_similarity"), similarity_level(F.col("max_similarity")).alias("level"), *extra)


def group_purposes(marked: DataFrame, semantic: DataFrame) -> DataFrame:
    """(group_id, purpose, n): how often each purpose occurs in a group."""
    known = semantic.where("purpose <> ''").select("id", "purpose")
    return marked.select("group_id", "id").join(known.hint("merge"), "id").groupBy("group_id", "purpose").agg(F.count(F.lit(1)).alias("n"))
