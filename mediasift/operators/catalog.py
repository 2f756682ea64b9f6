"""Catalog rules: what is scanned, kept, labelled and where files would go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions import scalars as S
from mediasift.operators.groups import ranked


def glob_regex(rule: Column) -> Column:
    """A pattern with *, ? and sets (``[abc]``, ``[!abc]``) as a regular expression over the whole string."""
    quoted = F.regexp_replace(rule, r"([.^$+(){}|\\])", r"\\$1")
    sets = F.replace(F.regexp_replace(quoted, r"\[\^", r"[\\^"), F.lit("[!"), F.lit("[^"))  # a leading ^ is itself in file patterns
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(sets, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no rule matches by name or by path. Rules are a hand-written list; empty lines and ``#`` comments go.

    All rules become one regular expression (an aggregate of one row), so that files are looked at once. If the rules have a ``root``, those with
    one hold for the files below it alone; there are as many expressions as roots.
    """
    if "root" in rules.columns:
        lines = rules.select(F.regexp_replace("root", "/+$", "").alias("root"), F.trim("rule").alias("rule")).where("rule <> '' and not startswith(rule, '#')")
        of = lines.groupBy("root").agg(F.array_join(F.collect_set(glob_regex(F.col("rule"))), "|").alias("rules"))
        one = of.agg(F.collect_list(F.struct("root", "rules")).alias("_rules"))
        hit = F.exists("_rules", lambda r: (r["root"].isNull() | F.startswith(F.col("path"), F.concat(r["root"], F.lit("/")))) & (F.regexp_like(F.col("name"), r["rules"]) | F.regexp_like(F.col("path"), r["rules"])))
        return files.crossJoin(F.broadcast(one)).where(~hit).drop("_rules")
    lines = rules.select(F.trim("rule").alias("rule")).where("rule <> '' and not startswith(rule, '#')")
    one = lines.agg(F.coalesce(F.array_join(F.collect_set(glob_regex(F.col("rule"))), "|"), F.lit("")).alias("_rules"))
    hit = (F.col("_rules") != "") & (F.expr("name rlike _rules") | F.expr("path rlike _rules"))
    return files.crossJoin(F.broadcast(one)).where(~hit).drop("_rules")


def without_protected(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files outside all protected folders: an equi-join on every folder above the file, not a search over pairs."""
    parts = F.split(F.lower("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = folders.select(F.regexp_replace(F.lower("folder"), "/+$", "").alias("folder"))
    hit = files.select("id", F.explode(above).alias("folder")).join(folders.hint("merge"), "folder", "left_semi").select("id").distinct()
    return files.join(hit.hint("merge"), "id", "left_anti")


def filter_report(items: DataFrame, rule: str, min_width: int) -> DataFrame:
    """One row: how many items each rule removes; width is asked only of those that pass the duration."""
    passes = F.coalesce(S.duration_filter(rule, F.col("duration")), F.lit(False))
    wide = F.coalesce(F.col("width"), F.lit(0)) >= min_width
    return items.agg(F.count(F.lit(1)).alias("total"), F.count_if(~passes).alias("removed_by_duration"), F.count_if(passes & ~wide).alias("removed_by_width"), F.count_if(passes & wide).alias("kept"))


def duration_statistics(items: DataFrame, rule: str) -> DataFrame:
    m = S.duration_filter(rule, F.col("duration"))
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(m).alias("matched"),
        F.round(F.lit(100.0) * F.count_if(m) / F.count(F.lit(1)), 6).alias("percent"),
        F.sum("duration").alias("seconds"),
        F.coalesce(F.sum(F.when(m, F.col("duration"))), F.lit(0.0)).alias("matched_seconds"),
    )


def target_manifest(files: DataFrame, root: str, category: Column, name: str = "name") -> DataFrame:
    """``files`` with ``target``: root/category/name, ``_dup1`` and so on before the extension of further files alike."""
    directory = F.concat(F.lit(f"{root}/"), category)
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    placed = ranked(files.withColumn("_dir", directory).withColumn("_at", F.struct("_dir", name)), "_at", [F.asc("id")], "_k").drop("_at")
    suffix = F.when(F.col("_k") > 1, F.concat(F.lit("_dup"), (F.col("_k") - 1).cast("string"))).otherwise("")
    return placed.withColumn("target", F.concat("_dir", F.lit("/"), stem, suffix, ext)).drop("_dir", "_k")


def label_of(mode: str, pattern: str | None = None, root: str = "") -> Column:
    """Label of a file by its ``folder`` (not the root), by the ``prefix`` of its name, or by a ``regex`` on its stem."""
    if mode == "folder":
        label = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
        label = F.when(F.regexp_replace("path", "/[^/]+$", "") != root, label)
        return F.when(S.valid_label(label), label)
    if mode == "prefix":
        label = F.get(F.split("name", "[_-]"), 0)
        return F.when(S.valid_label(label), label)
    found = F.trim(F.regexp_extract(F.regexp_replace("name", r"\.[^.]*$", ""), pattern, 1))
    return F.when(found != "", found)


def auto_labels(files: DataFrame, root: str = "") -> DataFrame:
    """``files`` with ``label``: by folder if at least two folders hold labels, or as many files as prefixes do; else by prefix."""
    folder, prefix = label_of("folder", root=root), label_of("prefix")
    n = files.agg(F.count(folder).alias("folder"), F.count(prefix).alias("prefix")).first()
    if not n["folder"] and not n["prefix"]:
        raise ValueError("no labels in folders or names")
    by_folder = n["folder"] >= 2 or (n["folder"] > 0 and n["folder"] >= n["prefix"])
    return files.withColumn("label", folder if by_folder else prefix)


def labels_from_csv(spark, path: str) -> DataFrame:
    """(name, label) of a CSV with any of the known headers; blanks go. The key is the base name."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    by_name = {c.strip().lstrip("\ufeff").lower(): c for c in raw.columns}
    #: Accepted headers.
    keys, values = ("path", "file", "filename", "文件名", "路径"), ("label", "标签", "class", "类别")
    key = next((by_name[k] for k in keys if k in by_name), None)
    value = next((by_name[k] for k in values if k in by_name), None)
    if key is None or value is None:
        raise ValueError("the file needs a path and a label column")
    rows = raw.select(F.element_at(F.split(F.trim(F.col(f"`{key}`")), r"[/\\]"), -1).alias("name"), F.trim(F.col(f"`{value}`")).alias("label"), F.monotonically_increasing_id().alias("n"))
    last = rows.where("name <> '' and label <> ''").groupBy("name").agg(F.max_by("label", "n").alias("label"))
    return last


def behaviour_tokens(labels: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """(token): the distinct words of labels without stop words, numbers and words of less than three characters."""
    t = labels.select(F.explode(S.label_tokens(F.col("label"))).alias("token"))
    return t.where((F.length("token") >= 3) & ~F.col("token").isin(*stop) & ~F.col("token").rlike("^[0-9]+$")).distinct()


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of equal widths between the least and the largest value."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.lit(bins - 1).cast("long"), F.floor((F.col(column) - F.col("_lo")) / F.when(width > 0, width).otherwise(1.0)))
    return values.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
