"""Corpus pipeline over ``documents``: five stages, each a Parquet table that the next one reads.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given.  All but the last
return the columns of ``documents``; rows with nulls, empty texts or repeated ids pass through as
the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poi_analytics.llm import decontaminate, fm_index, langid, packing, simhash
from poi_analytics.llm.shared import saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go."""
    return langid.with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in runs of 50 that also start in an earlier document go from the text.

    Untouched documents keep their text as it is; a document that loses all its words goes.
    ``n_chars`` follows the text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    cut = fm_index.remove_repeats(docs.select(row, "doc_id", "text"), carry=("row",))
    cut = cut.where("n_removed < n_words or n_removed = 0")
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return cut.select(*[
        F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in changed
        else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of what is left, packed into sequences of 1024."""
    return packing.pack(docs, capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage learns a model, so SQL cannot express the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
