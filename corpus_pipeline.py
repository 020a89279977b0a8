"""The pipeline over documents: toxic and poor ones go, one of each group of near copies stays, repeated passages are cut out, and the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import minhash_dedup, packing, quality_rules, substring_dedup, toxicity
from graphloom.llm.common import stored, table
from graphloom.llm.queries import WORD_BPE


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs, percent=80, width=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, WORD_BPE)


STAGES = [("toxicity", toxic), ("quality rules", quality), ("near copies", near_copies), ("repeated passages", repeats), ("packing", packed)]
#: Training a classifier and tokenizing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
