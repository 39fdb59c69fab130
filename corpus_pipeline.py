"""The corpus pipeline: documents pass five operators, each stage written and read again by the next.

All but the last stage return the columns they were given, also extra ones whose names an operator uses inside. An empty
table stays empty. Rows that repeat an id are judged one by one unless a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revtide.llm import fmindex, sampling, setsketch, superkmers, toxicity
from revtide.llm.common import materialize
from revtide.llm.queries import open_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject.

    A null or empty text is scored by the bias alone, so it stays; rows without id stay by their score, and teach nothing.
    """
    return toxicity.drop_toxic(docs, open_table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Texts without words and rows without id stay. Rows that share an id are one document and stay or go together.
    """
    return setsketch.drop_near_duplicates(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that an earlier one has.

    Null and short texts and rows without id keep all; rows that share an id never cut each other. ``n_chars`` follows.
    """
    return superkmers.cut_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated.

    A null or empty text has no words and stays; an empty benchmark removes nothing.
    """
    return fmindex.drop_contaminated(docs, open_table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of each document, checked by decoding.

    A row per document and sample; a null or empty text has one row without sample. Rows that repeat an id have the same
    seed, so equal texts get equal samples.
    """
    return sampling.segmentation_report(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Language models, sketches and sampling can't be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = open_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
