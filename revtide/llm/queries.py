"""Named queries of this package: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from revtide.llm import fmindex, lattice, negatives, packing, sampling, setsketch, sumofsquares, superkmers, tagpaths, tokencount, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def open_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    # Python workers look for this package where the driver has it, if nothing else was said.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(open_table(spark, sf_dir, "documents"), open_table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicate_report(open_table(spark, sf_dir, "documents"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_report(open_table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.contamination_report(open_table(spark, sf_dir, "documents"), open_table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.extraction_report(open_table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vector_report(open_table(spark, sf_dir, "embeddings"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(open_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.segmentation_report(open_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_count_report(open_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.repeats_report(open_table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sumofsquares.packing_report(open_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negative_report(open_table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(open_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_decontamination": op4_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_token_packing": op7_token_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_embedding_whitening": op13_embedding_whitening,
}
