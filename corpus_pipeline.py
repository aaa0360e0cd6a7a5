"""Cleaning of a document table into tokenised training text, stage by stage.

toxicity: documents predicted toxic go. near_duplicates: of documents whose 5-word shingles are alike
by 0.8 or more, found by SimHash, one of each class stays.
repeated_strings: strings of 200 bytes that start at several places are cut out of the texts.
decontamination: documents that contain a benchmark item go. tokens: byte-level BPE ids of what is left.
Each stage sees all rows and columns that its predecessor kept, written as Parquet and read again.

Defined cases: a null text is empty: all such rows are near duplicates of each other and one stays; a null doc_id is an
id like any other and comes first where the least stays; repeated rows are one document; texts of any length pass whole;
an empty table gives no rows; other columns travel through all stages but the last, whatever their names; ties between
near duplicates go to the least (doc_id, hash of the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontaminate, neardup, suffixes, toxicity
from quillon.llm.common import store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.strip_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(docs, bpe.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", cut_repeated_strings),
    ("decontamination", drop_contaminated),
    ("tokens", tokenise),
]

#: The classifier and the string index have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
