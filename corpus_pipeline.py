"""A training-corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Cases: null, empty, blank and short texts fall to the quality rules; without a trusted document only the base rules
decide. Rows with a null doc_id pass like others: of equal texts one with an id stays before one without, of near
copies that with the smallest id. Repeated rows are equal texts. A null source is a source of its own. Very long texts
are read whole in every stage. Extra columns pass through untouched, whatever their names, up to packing, which
ignores them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import exact, mixing, packing, quality, simhash
from tracelake.llm.common import cut, table
from tracelake.llm.queries import vocabulary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact.dedup(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies."""
    return simhash.dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs, vocabulary(), 0)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", unlike), ("mixing", mixed), ("packing", packed)]

#: SimHash components and the tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
