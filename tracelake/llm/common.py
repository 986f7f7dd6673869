"""Small helpers that the corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: blank, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir.

    Only a local session, whose driver and tasks are one machine, may leave that unset (tests); a cluster may not.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tracelake-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends, and losing an executor loses nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a column `row`, a number that tells rows apart and is the same whenever docs, a table, are read.

    It follows from how the table is cut for tasks, and Spark cuts it by the cores that it sees when a read begins. So that an executor that is lost or joins
    between two reads numbers no row anew, the session's least number of file partitions is set to the cores seen first, unless it has one.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        seen = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(seen))
    return docs.withColumn(row, F.monotonically_increasing_id())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, close to those asked for."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out
