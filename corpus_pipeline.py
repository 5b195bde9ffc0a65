"""The corpus pipeline: quality rules, toxicity, near duplicates, packing; each stage's rows are the next one's documents.

Defined results: a null, empty or wordless text fails the quality base and goes in the first stage, so that no later
stage sees one (each could: see its operator); a very long text is judged, compared and packed whole.  Rows that are
repeated, and rows that share an id, are one document: the near-duplicate stage keeps one row of it.  Rows without an id are
kept by every stage whose judgement of the text keeps them.  Empty tables go through as empty ones.  Without labels the
quality base alone rejects, and no document is toxic.  All stages but the last return the documents' columns, extra ones
among them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arcwright.llm import near_duplicates, packing, quality_rules, toxicity
from arcwright.llm.common import spool, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base thresholds nor the learned decision list reject."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_duplicates.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", clean),
    ("near_duplicates", once),
    ("packing", packed),
]

#: Learned rules, segment scores and tokenizers aren't SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
