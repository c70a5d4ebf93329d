"""A corpus pipeline: toxicity, exact dedup, MinHash near-dedup, mixing sources to target weights, best-fit packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps of docs, which is written
as Parquet and read again as the docs of the next. All but the last return the columns of documents, whatever their names. Tables
that a stage wrote on its way are deleted when its result is written.

Cases, as the operators define them: a null text counts as empty and is no reason to go; of equal texts (null and empty ones
are equal) the row with the largest id stays, of near duplicates the smallest id, of repeated rows one; rows with a null id are
kept unless they are exact copies; the mix may take a row up to three times, or not at all where its source is over its target;
rows without words are packed into no bin. Empty tables give an empty result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from pixelloom.llm.exact_dedup import drop_exact_copies
from pixelloom.llm.minhash import drop_near_duplicates
from pixelloom.llm.mixing import mixed_documents
from pixelloom.llm.packing import pack_documents
from pixelloom.llm.toxicity import drop_toxic
from pixelloom.plans.shared import discard, settled


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, (1, 2, 3), 3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("minhash", minhash), ("mixing", mixing), ("packing", packing)]

#: The classifier and the packing can't be put in SQL; tests/llm/test_packing_mixing_suffix.py and tests/llm/test_cases.py check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), name)
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
