"""Corpus pipeline: toxicity, near duplicates, benchmark passages and personal data, then packing.

Every stage works on all rows that its predecessor kept; all but the last return the columns of ``documents``.

Defined results: null and empty texts are clean, have no duplicate and no passage, and reach packing as one end id each. Rows
with a null doc_id are judged by their text and never dropped as duplicates. Of rows that repeat a doc_id and text, one stays;
of rows that repeat a doc_id with other texts, each is judged on its own. An empty table gives no row. Further columns travel
along, whatever their names, up to packing. Labels and benchmark may be empty: then nothing is rejected for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentria.llm import decontamination, near_dedup, packing, pii, toxicity
from sentria.runtime import materialize, read_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.mask_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("near_dedup", keep_one_of_each_group), ("decontamination", decontaminate), ("pii", mask_private), ("packing", pack)]
#: Learned scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
