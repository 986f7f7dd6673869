"""Facts as JSON lines, refilling a store, and the export documents; snapshots.py keeps the store itself."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import expr as X
from ..model import FACTS, conform
from . import snapshots
from .snapshots import StoreError, append, load, refuse, save

__all__ = ["StoreError", "append", "load", "save"]  # S12, S13, S19: the versioned store


def after(facts: DataFrame, store: DataFrame) -> DataFrame:
    """facts with places behind those that a store already uses for their case, in the same order."""
    return snapshots.after(facts, store.groupBy("case_id").agg(F.max("fact_ord").alias("last")))


def checked(facts: DataFrame) -> DataFrame:
    """facts; raises if one has an unsupported version or there is none."""
    refuse(facts.agg(F.count("*").alias("n"), F.min("schema_version").alias("lo"), F.max("schema_version").alias("hi")).first())
    return facts


def load_json(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(facts, rows skipped) of JSON lines: unreadable rows are skipped and counted."""
    schema = StructType([*FACTS.fields, StructField("_bad", StringType())])
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    good = rows.where("_bad IS NULL AND fact_id IS NOT NULL")
    skipped = rows.where("_bad IS NOT NULL OR fact_id IS NULL").count()
    return checked(conform(good)), skipped


def refill(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with facts of those rebuilt sources that it has none of, behind what it has."""
    return store.unionByName(after(missing_sources(store, fresh), store))


def missing_sources(store: DataFrame, fresh: DataFrame) -> DataFrame:
    have = store.select("host", F.lower("source").alias("s")).distinct()
    return fresh.join(have, (fresh["host"] == have["host"]) & (F.lower(fresh["source"]) == have["s"]), "left_anti")


def document(head: DataFrame, arrays: dict[str, DataFrame], path: str) -> None:
    """One JSON document, the file `path`: the one row of head as members, and each frame, in its order, as an array.

    Elements are sorted and turned to text by Spark; the one task that a single file needs passes them on one by one.
    """
    spark = head.sparkSession
    keep = {"ignoreNullFields": "false"}
    parts = [head.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.to_json(F.struct("*"), keep).alias("text"))]
    for i, df in enumerate(arrays.values()):
        parts.append(df.select(F.lit(i + 1).alias("part"), F.monotonically_increasing_id().alias("place"), F.to_json(F.struct(*df.columns), keep).alias("text")))
    names = list(arrays)

    def joined(batches):
        part, out = 0, []
        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p == 0:
                    out.append(t[:-1])
                    continue
                out.append(",\n" + t if p == part else _between(names, part, p) + t)
                part = p
            yield pa.RecordBatch.from_pydict({"value": pa.array(["".join(out)] if out else [], pa.string())})
            out = []
        yield pa.RecordBatch.from_pydict({"value": [_between(names, part, len(names) + 1)]})

    rows = reduce(DataFrame.unionByName, parts).repartition(1).sortWithinPartitions("part", "place").select("part", "text")
    folder = f"{path.rstrip('/')}.parts"
    rows.mapInArrow(joined, "value string").write.mode("overwrite").option("lineSep", "\n").text(folder)
    to = spark._jvm.org.apache.hadoop.fs.Path
    system = to(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    (made,) = [f.getPath() for f in system.globStatus(to(f"{folder}/part-*"))]
    system.delete(to(path), True)
    system.rename(made, to(path))
    system.delete(to(folder), True)


def _between(names: list[str], part: int, to: int) -> str:
    """What stands between an element of one array and one of a later array, arrays without elements included; to: one more than the last for the end."""
    opened = [f',"{n}":[' for n in names[part : min(to, len(names))]]
    text = ("]" if part else "") + "]".join(opened)
    return text + ("]}" if opened else "}") if to > len(names) else text


def rows_as_documents(rows: DataFrame, by: str, path: str) -> None:
    """A JSON document for each row, in a folder for each value of `by`."""
    text = F.to_json(F.struct(*[c for c in rows.columns]), {"ignoreNullFields": "false"})
    rows.select(F.col(by).alias("_by"), text.alias("value")).write.mode("overwrite").partitionBy("_by").text(path)


def timeline_csv(events: DataFrame, path: str) -> None:
    """A delimited export whose cells no spreadsheet takes for formulas."""
    events.select(*(X.neutral(X.text(F.col(c))).alias(c) for c in events.columns)).write.mode("overwrite").csv(path, header=True, quoteAll=False, escape='"')


def timeline_json(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)
