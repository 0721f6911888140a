"""From raw documents to packed training sequences, as stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridrisk.llm import decontam, near_dups, packing, pii, toxicity
from gridrisk.llm.common import crc_mod, settle, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score as toxic, by models of the labelled training documents among those given.

    Null and empty texts have no evidence and stay; repeated rows stay or go together; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 3) != 1)
    return toxicity.keep_ordinary(docs, toxicity.train(docs, labels))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that with the smallest doc_id.

    Texts without words, null ones too, are in no group and stay; of repeated rows one stays; an empty table stays empty.
    """
    return near_dups.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out what stands in benchmark items, and drop documents that are mostly such.

    Null and empty texts stay as they are; an empty table, of documents or of items, changes nothing.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the names of their kinds. All documents stay; null texts stay null."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences: a row for each piece, with its place and its ids.

    A null or empty text is its end id alone; repeated rows are packed each for itself; an empty table gives no rows.
    """
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: The stages learn models and pack by search, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each over what the one before wrote. Other columns than doc_id and text
    pass through the filtering stages whatever their names; nulls, repeated rows and empty tables are as each stage has it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
