"""Operators put together: scans, store reports, label verification, clustering, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.functions import scalars as S
from mediasift.operators import groups as G
from mediasift.operators import labels as L
from mediasift.operators import pairs as P
from mediasift.operators import reports as R
from mediasift.operators import segments
from mediasift.operators import semantic as M
from mediasift.operators import store as T
from mediasift.operators.catalog import target_manifest
from mediasift.sources.shared import stored


def groups_of(items: DataFrame, threshold: float, floor: float | None = None, strategy: str = "max_size") -> dict[str, DataFrame]:
    """Links, groups and their report over items with signatures and file data (id, path, name, size, mtime, width, height)."""
    found = P.similar_pairs(items, threshold).select("a", "b", "similarity")
    copies = P.copy_links(items)
    links = stored(found.unionByName(copies.withColumn("similarity", F.lit(1.0))), "links")
    members = G.group_members(links) if floor is None else G.split_groups(found, floor, copies)
    marked = stored(G.retention(members.join(items.select("id", "path", "name", "size", "mtime", "width", "height", "duration").hint("merge"), "id"), strategy), "marked")
    return {"links": links, "members": marked, "similarity": G.group_similarity(links, marked.select("group_id", "id")), "space": G.space_report(marked)}


def dedup_scan(catalog: DataFrame, store: DataFrame, compute, rule: str | None = None, threshold: float = 0.7, floor: float | None = None, strategy: str = "max_size", purposes: tuple[str, ...] | None = None, least_quality: float | None = None) -> dict[str, DataFrame]:
    """Catalog and store to duplicate groups. ``compute`` makes signature rows of the files that the store lacks.

    Before pairs are made, items go that ``rule`` does not hold for, those of other ``purposes``, and analysed ones of less than
    ``least_quality`` (without a score: 1); items that have not been analysed pass the latter. Both read ``purpose`` and ``quality_score`` of
    the signatures.
    """
    new = compute(T.to_compute(catalog, store))
    current = stored(T.merged([new, T.without_invalid(store, catalog)]), "signatures")
    kept = current if rule is None else current.where(S.duration_filter(rule, F.col("duration")))
    kept = kept if purposes is None else kept.where(F.col("purpose").isin(*purposes))
    kept = kept if least_quality is None else kept.where(F.coalesce("quality_score", F.lit(1.0)) >= least_quality)
    out = groups_of(kept, threshold, floor, strategy)
    return out | {"store": current, "summary": R.scan_summary(catalog, out["members"])}


def groups_from_store(store: DataFrame, threshold: float = 0.85) -> dict[str, DataFrame]:
    return groups_of(store, threshold)


def verify_labels(items: DataFrame, threshold: float = L.SUSPECT) -> dict[str, DataFrame]:
    """Label statistics and suspects over items (id, label, phash, dhash, motion_mean, motion_std, motion_ratio, emb)."""
    sums = stored(L.label_sums(items), "label-sums")
    means = L.item_means(sums)
    stats = stored(L.label_stats(items, sums), "label-stats")
    apart = L.separation(sums)
    return {"stats": stats, "suspects": L.suspects(means, stats, threshold), "confusion": L.confusion(sums), "separation": apart, "silhouette": L.silhouette(means), "verdicts": L.verdicts(stats, apart), "balance": L.balance(items)}


def health_check(items: DataFrame, groups: dict[str, DataFrame], labels: dict[str, DataFrame], pattern: str) -> DataFrame:
    """One row: counts and the grade."""
    mixed = G.mixed_labels(groups["members"], pattern).agg(F.count_if("mixed").alias("mixed"), F.count(F.lit(1)).alias("groups"))
    one = items.agg(F.count(F.lit(1)).alias("items")).crossJoin(labels["suspects"].agg(F.count(F.lit(1)).alias("suspects"))).crossJoin(mixed)
    return one.withColumn("grade", L.grade(F.col("items"), F.col("suspects"), F.col("mixed"), F.col("groups")))


def auto_classify(items: DataFrame, tags: DataFrame, root: str, k: int | None = None) -> DataFrame:
    """(id, cluster, category, target): clusters of the embeddings, named by their tags, and where each file would go."""
    k = k or M.classify_cluster_count(items.count())
    clusters = stored(M.kmeans(items, k), "clusters")
    named = clusters.join(M.cluster_names(clusters, tags).hint("merge"), "cluster").withColumn("category", S.safe_dir_name(F.col("name"))).drop("name")
    return target_manifest(named.join(items.select("id", "name").hint("merge"), "id"), root, F.col("category")).select("id", "cluster", "category", "target")


def similar_segments(pairs: DataFrame, samples: DataFrame, threshold: float = 0.85) -> DataFrame:
    return segments.intervals(pairs, samples, threshold)
