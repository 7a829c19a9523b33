"""From raw documents to packed training sequences, as stages that each read what the one before kept.

Every stage but the last returns rows of `documents` with their columns; a stage's result is written as
Parquet to the cluster's shared folder and read again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardlog.llm.common import stored, table
from wardlog.llm.decontamination import remove_contaminated
from wardlog.llm.neardup import keep_one_of_each
from wardlog.llm.packing import pack_with_public_tokenizer
from wardlog.llm.quality_classifier import keep_predicted
from wardlog.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled rows of the raw table: behind the rules hardly a bad example is left."""
    return keep_predicted(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_with_public_tokenizer(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier),
          ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: A fitted classifier and a tokenizer are no SQL; tests compare the rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
