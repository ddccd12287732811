"""A corpus pipeline: language identification, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last keep the columns of documents. Language: documents of undetermined language or with a
score under 0.2 go. Toxicity: documents that score 0.5 or more go. Near duplicates: one row of each group stays, the one with the least id.
Packing: pieces with their sequence and offset.

Defined results: a null or empty text is of undetermined language and goes in the first stage; an empty table gives no rows; of repeated rows one
stays; extra columns are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import jaccard, language, packing, toxicity
from sparkwright.llm.common import discard, table
from sparkwright.shared import scratch


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4 on its input: fitted on the rows that may be learned from, applied to all."""
    return language.keep_identified(docs, language.fit(docs, language.learnable(F.col("doc_id"))))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 on its input, with the labels of the table."""
    return toxicity.keep_harmless(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable(F.col("doc_id"))))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 with its contract's values, shingles of 4 words and a likeness of 85 %, since the stage is that operator; one row of each component."""
    return jaccard.keep_one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 on what is left."""
    return packing.pack_documents(docs)


STAGES = [("language", identify), ("toxicity", harmless), ("near duplicates", distinct), ("packing", packed)]
#: Trained models are no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage has written besides is deleted when its rows are."""
    docs, former = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if former is not None:
            discard(former)  # the next stage's rows are written
        former = docs
    return docs
