"""The corpus pipeline: STAGES applied one after the other to the documents.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept: quality classifier, language
identification, SimHash near-duplicates, benchmark decontamination, packing. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import op2_language, op3_packing, op4_quality, op7_decontaminate, op8_simhash_dedup
from corpusloom.llm.common import remove, shared_folder, table, through_parquet


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality stay."""
    return op4_quality.keep_good(docs, op4_quality.train(docs, op4_quality.training_labels(spark, sf_dir)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay."""
    return op2_language.keep_languages(docs, op2_language.train(docs, op2_language.training_labels(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return op8_simhash_dedup.drop_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return op7_decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents in a batch."""
    return op3_packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn models and align passages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written as Parquet and read again; what a stage has read is removed once the next is written."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = through_parquet(docs, f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
