"""Corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes what the one before kept, as a table of documents; the last
returns the packed pieces. Each calls one operator of ``sprank.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sprank.llm import linededup, mixing, packing, simhash, toxicity
from sprank.llm.common import table, written
from sprank.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from ``labels``, does not reject."""
    ship_package(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; those left without words go."""
    ship_package(spark)
    return linededup.strip_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked at four or fewer differing fingerprint bits."""
    ship_package(spark)
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities of the raked token weights."""
    ship_package(spark)
    return mixing.sample(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows that hold every token of every document once."""
    ship_package(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# The toxicity stage is a trained model, which SQL cannot express; the stages
# are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
