"""The fact table: one row for each analysable event, with typed references to entities.

`facts` has FACTS; its key is (case_id, fact_ord). `fact_entities` has a row for each distinct
entity key of a fact.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION, OLDEST_VERSION = 3, 1
REF = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])
FACTS = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("fact_ord", T.LongType()),
        T.StructField("fact_id", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("time_kind", T.StringType()),
        T.StructField("time_confidence", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("entity_refs", T.ArrayType(REF)),
        T.StructField("source_file", T.StringType()),
        T.StructField("collection_step", T.StringType()),
        T.StructField("collection_status", T.StringType()),
        T.StructField("collection_privilege", T.StringType()),
        T.StructField("parse_level", T.StringType()),
        T.StructField("fallback_used", T.BooleanType()),
        T.StructField("parser_note", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("raw_ref", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
    ]
)
# Fixed values.
TIME_KINDS = ("EventTime", "MetadataTime", "ObservedTime", "UnknownTime")
CONFIDENCES = ("High", "Medium", "Low", "Unknown")
PARSE_LEVELS = ("Structured", "StructuredXml", "RegistryValue", "MetadataDerived", "Synthesized", "RawArtifactDerived", "Unknown")


def conform(df: DataFrame) -> DataFrame:
    """df with exactly the columns of FACTS, missing ones null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in FACTS))


def entity_key(kind: Column, value: Column) -> Column:
    """lower(type):lower(trim(value)); null for a blank value."""
    v = F.lower(F.trim(value))
    return F.when(F.length(v) > 0, F.concat(F.lower(kind), F.lit(":"), v))


def split_key(key: Column) -> tuple[Column, Column]:
    """(type, value) of a key, parted at its first colon."""
    at = F.instr(key, ":")
    return F.when(at > 0, F.substring_index(key, ":", 1)).otherwise(""), F.when(at > 0, F.regexp_replace(key, r"^[^:]*:", "")).otherwise(key)


def host_of(host: Column) -> Column:
    """Blank host names become `host`, so two unnamed cases never correlate."""
    return F.coalesce(F.nullif(F.trim(host), F.lit("")), F.lit("host"))


def exploded(facts: DataFrame) -> DataFrame:
    """facts (with entity_refs and ref_keys) by distinct reference, the first of equal keys: entity_type, value_display, entity_key are added.

    The keys are columns of the fact below the explode, so they are worked out once a fact.
    """
    e = facts.select("*", F.posexplode("entity_refs").alias("_pos", "_ref"))
    key = F.get("ref_keys", F.col("_pos"))
    e = e.where(F.array_position("ref_keys", key) == F.col("_pos") + 1)
    added = {"entity_type": F.col("_ref.type"), "value_display": F.trim("_ref.value"), "entity_key": key}
    return e.withColumns(added).drop("_pos", "_ref")


ROW = ("case_id", "host", "fact_ord", "fact_id", "time", "source", "action", "time_confidence")


def naming(keys: Iterable[str]) -> Column:
    """Whether a fact names one of the keys: a filter of facts that Spark pushes below unions and joins."""
    wanted = sorted({k.lower() for k in keys})
    return F.exists("entity_refs", lambda r: entity_key(r["type"], r["value"]).isin(wanted))


def fact_entities(facts: DataFrame, keys: Iterable[str] | None = None) -> DataFrame:
    """One row for each distinct entity key of a fact, with the first spelling in the fact; of facts that name one of `keys`, if given.

    Repeats are dropped within the fact's own array, so nothing is shuffled and two facts are never taken
    for one. entity_refs and ref_keys stay, so what a fact also names needs no join; Spark drops them where
    nobody asks for them.
    """
    if keys is not None:
        facts = facts.where(naming(keys))
    keys = F.transform("entity_refs", lambda r: entity_key(r["type"], r["value"])).alias("ref_keys")
    f = facts.withColumn("host", host_of(F.col("host"))).select(*ROW, "entity_refs", keys)
    e = exploded(f).withColumn("value_norm", F.lower("value_display"))
    return e.select(*ROW, "entity_type", "value_display", "value_norm", "entity_key", "entity_refs", "ref_keys")
