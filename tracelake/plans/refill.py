"""Keeping a store in step with a folder of evidence: only cases whose source files changed are read again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__, model
from ..operators import graph
from ..sources import snapshots, store, tables
from . import reports

#: What turned files into facts. Another release reads every case again.
TOOL = f"{__version__}/{model.SCHEMA_VERSION}"


@dataclass(frozen=True)
class Refilled:
    """snapshot: the store afterwards; cases: case_id, and added, changed, removed, its counts of files, for each case that was read."""

    snapshot: snapshots.Snapshot
    cases: DataFrame


def listed(spark: SparkSession, root: str) -> DataFrame:
    """snapshots.LEDGER rows of the files below root as they are now; their contents are not read."""
    return tables.listing(spark, root).where("file_in_case").select(F.col("host").alias("case_id"), "rel", "size", "modified", F.lit(TOOL).alias("tool"))


def stale(now: DataFrame, ledger: DataFrame) -> DataFrame:
    """(case_id, added, changed, removed) of cases in `now` whose files differ from the ledger's by name, size, time or tool.

    A case without a file in `now` is none of them: folders are moved away when a case is closed.
    """
    mark = lambda df, name: df.select("case_id", "rel", F.struct("size", "modified", "tool").alias(name))
    both = mark(now, "new").join(mark(ledger, "old"), ["case_id", "rel"], "full_outer")
    kinds = {"added": "old IS NULL", "changed": "new IS NOT NULL AND old IS NOT NULL AND NOT (new <=> old)", "removed": "new IS NULL"}
    n = both.groupBy("case_id").agg(*(F.count_if(F.expr(c)).alias(k) for k, c in kinds.items()), F.count("new").alias("there"))
    return n.where("there > 0 AND added + changed + removed > 0").drop("there")


def refill(spark: SparkSession, root: str, path: str, zones: DataFrame | None = None) -> Refilled:
    """Brings the store at `path` up to date with the folder of cases at `root`, in one commit.

    Files are compared with the ledger of the store's version by path, size and time of change. A case with a
    difference is built anew from all its files, since one of them may name its host or say how it was
    collected; its former facts are replaced. Of other cases no file is opened, and without a difference nothing is
    committed. Facts that came into the store in other ways stay. The ledger is listed before files are read,
    so one that changes meanwhile is read again next time. A case of which nothing can be read has a ledger but no fact.
    """
    base = snapshots.snapshot(spark, path)
    now = graph.saved(listed(spark, root))
    cases = graph.saved(stale(now, base.ledger()))
    if cases.isEmpty():
        return Refilled(base, cases)
    taken = reports.evidence(spark, root, cases)
    try:
        facts = reports.facts_of(taken, zones)
    except store.StoreError:  # no artifact at all
        facts = spark.createDataFrame([], model.FACTS)
    ledger = now.join(cases.select("case_id"), "case_id", "left_semi")
    return Refilled(snapshots.replace_cases(facts, ledger, path), cases)
