"""From raw documents to packed training sequences: five stages, each one of the operators of ``mediasift.llm``.

Every stage takes the documents that the one before it kept, and its decisions take effect:

1. ``quality``: documents that the classifier rejects go.
2. ``line_dedup``: passages that repeat across documents are taken out; documents of which nothing is left go.
3. ``near_duplicates``: of every group of near-duplicates (five words, 0.8 or more) the smallest id stays.
4. ``decontaminate``: documents that the benchmark's windows cover to a twentieth or more go; all others stay as they are.
5. ``packing``: the rest is cut into pieces and packed into sequences of at most 1024 tokens.

Null or empty texts count as empty ones throughout; they are scored like any other and have nothing to take out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm import decontaminate, linededup, minhash, packing, quality
from mediasift.sources.shared import stored
from mediasift.sources.tables import table

PERCENT = 80

#: No SQL: the first stage learns a model.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one value beside its text, to be carried through an operator."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or that with as many underscores as it takes to clash with no column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more. It learns from those of ``docs`` that have labels; null and empty texts
    are scored like any other, and rows that repeat fare alike."""
    model = quality.model_of(spark, sf_dir, docs)
    return quality.score(_rows(docs), model, id="row").where("predicted = 1").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur before, and ``n_chars`` (if there is one) of what is left of a changed text. A
    document of which nothing but blanks is left goes; null texts and texts that were empty stay."""
    removed = _unused(docs, "removed_lines")
    out = linededup.dedup(docs, removed=removed)
    emptied = (F.size(removed) > 0) & (F.trim(F.translate("text", "\n\t", "  ")) == "")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group the rows of the smallest id. Documents without words, or without an id, are in no group and stay; rows that
    repeat an id stay or go together."""
    found = minhash.near_duplicates(docs, percent=PERCENT)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, as they were. Null and empty texts have no words and stay."""
    found = decontaminate.find(_rows(docs), table(spark, sf_dir, "benchmark"), id="row")
    return decontaminate.verdicts(found).where("not contaminated").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in the sequences; a null or empty text is one piece, its end."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
