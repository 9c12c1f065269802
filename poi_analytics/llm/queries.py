"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poi_analytics.llm import (
    archives,
    ctph,
    decontaminate,
    fm_index,
    importance,
    langid,
    language_model,
    multi_index,
    packing,
    piece_table,
    simhash,
    suffix_array,
    token_counts,
)
from poi_analytics.llm.shared import table


def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(table(spark, sf_dir, "pages"), at_least=0)


def fuzzy_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_neighbours(table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.digest(fm_index.remove_repeats(table(spark, sf_dir, "documents")))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024)


def tokenizer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=4096)


def byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.digest(suffix_array.remove_repeats(table(spark, sf_dir, "documents")))


def recurrent_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.fill_in_middle(table(spark, sf_dir, "documents"), digests_only=True)


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_warc_archives": warc_archives,
    "op2_substring_dedup": substring_dedup,
    "op3_fuzzy_fingerprints": fuzzy_fingerprints,
    "op4_simhash_near_dedup": simhash_near_dedup,
    "op5_decontamination": decontamination,
    "op6_language_id": language_id,
    "op7_token_counts": tokenizer_counts,
    "op8_best_fit_packing": best_fit_packing,
    "op9_suffix_array_dedup": byte_dedup,
    "op10_lm_scores": recurrent_lm_scores,
    "op11_multi_index_neighbours": multi_index_neighbours,
    "op12_fill_in_middle": fill_in_middle,
    "op13_importance_resampling": importance_resampling,
}
ORACLE: dict[str, str] = {
    "op12_fill_in_middle": piece_table.ORACLE,
    "op13_importance_resampling": importance.ORACLE,
}
