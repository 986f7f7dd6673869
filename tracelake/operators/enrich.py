"""Fact enrichment: time kind and confidence, and where a fact came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..model import CONFIDENCES, PARSE_LEVELS, TIME_KINDS

# Fixed values, by lower-case source.
EVENT, METADATA = ("process",), ("mft", "prefetch", "jumplist", "jump_list", "userassist", "recentfiles")
MEDIUM, LOW = ("mft", "prefetch", "jumplist", "jump_list", "userassist"), ("recentfiles", "autorun", "scheduledtask", "runmru", "recentdocs")
STEPS = {
    "System Info": ("process", "logonsession", "storedcredential", "kerberosticketcache", "networkresource", "serverconnection"),
    "Memory acquisition": ("memoryacquisition",), "Memory analysis handoff": ("memoryanalysis",), "MFT": ("mft",), "USN Journal": ("usn",), "Unified Timeline": ("activitytimeline",),
    "Persistence": ("autorun", "service", "scheduledtask"), "Execution Artifacts": ("wmipersistence", "bits", "bam", "dam", "amcache", "shimcache", "srumnetwork", "srumapp"),
}
LEVELS = {
    "Structured": ("process", "logonsession", "networkresource", "service", "serverconnection", "wmipersistence", "bits", "srumnetwork", "srumapp"),
    "RawArtifactDerived": ("storedcredential", "kerberosticketcache", "shimcache"), "Synthesized": ("memoryacquisition", "memoryanalysis", "activitytimeline"),
    "StructuredXml": ("scheduledtask",), "RegistryValue": ("autorun", "bam", "dam", "amcache"), "MetadataDerived": ("mft", "usn"),
}


def _low(c: Column) -> Column:
    return F.lower(F.trim(X.text(c)))


def _chain(s: Column, table: dict[str, tuple[str, ...]], other: str) -> Column:
    c = F.when(F.lit(False), "")
    for value, sources in table.items():
        c = c.when(s.isin(*sources), value)
    return c.otherwise(other)


def time_kind(source: Column, has: Column) -> Column:
    """E02"""
    s = _low(source)
    return F.when(~has, "UnknownTime").when(s.startswith("eventlog") | s.isin(*EVENT), "EventTime").when(s.isin(*METADATA), "MetadataTime").otherwise("ObservedTime")


def time_confidence(source: Column, has: Column) -> Column:
    """E03"""
    s = _low(source)
    return F.when(~has, "Low").when(s.startswith("eventlog") | s.isin(*EVENT), "High").when(s.isin(*MEDIUM), "Medium").when(s.isin(*LOW), "Low").otherwise("Medium")


def clamp(c: Column, allowed: tuple[str, ...]) -> Column:
    """A value that is not allowed becomes the last of those that are."""
    return F.when(F.trim(c).isin(*allowed), F.trim(c)).otherwise(allowed[-1])


def with_time_defaults(facts: DataFrame) -> DataFrame:
    has = X.usable(F.col("time"))
    kind = F.when(X.blank(F.col("time_kind")), time_kind(F.col("source"), has)).otherwise(clamp(F.col("time_kind"), TIME_KINDS))
    conf = F.when(X.blank(F.col("time_confidence")), time_confidence(F.col("source"), has)).otherwise(clamp(F.col("time_confidence"), CONFIDENCES))
    return facts.withColumns({"time_kind": kind, "time_confidence": conf})


def step(source: Column, source_file: Column) -> Column:
    """E05"""
    s, f = _low(source), F.lower(X.text(source_file))
    return F.when(s.startswith("eventlog") | f.endswith("_filtered.csv"), "Event Logs").when(f == "activity_timeline.csv", F.when(s.isin(*(x for k, v in STEPS.items() for x in v)), _chain(s, STEPS, "unknown")).otherwise("Unified Timeline")).otherwise(_chain(s, STEPS, "unknown"))


def parse_level(level: Column, source: Column) -> Column:
    """E08"""
    known = clamp(level, PARSE_LEVELS)
    s = _low(source)
    return F.when(known != "Unknown", known).when(s.startswith("eventlog"), "Structured").otherwise(_chain(s, LEVELS, "Unknown"))


def coverage_steps(coverage: DataFrame) -> DataFrame:
    """(host, step, status, artifact counts) of sidecars read with sources.tables.COVERAGE; of equal names the first counts."""
    each = coverage.select("host", F.posexplode("steps").alias("k", "s")).where(~X.blank(F.col("s.step")))
    one = each.groupBy("host", F.lower("s.step").alias("step")).agg(F.min_by("s", "k").alias("s"))
    return one.select("host", "step", F.when(X.blank(F.col("s.status")), "unknown").otherwise(F.col("s.status")).alias("status"), F.col("s.artifacts_present").alias("present"), F.col("s.artifacts_missing").alias("missing"))


def with_provenance(facts: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """Step, status, privilege and parse level."""
    facts = facts.withColumns({"collection_step": step(F.col("source"), F.col("source_file")), "parse_level": parse_level(F.col("parse_level"), F.col("source"))})
    if coverage is None:
        return facts.withColumns({"collection_status": F.lit("unknown"), "collection_privilege": F.lit("unknown")})
    st = coverage_steps(coverage).select(F.col("host").alias("_h"), F.col("step").alias("_s"), F.col("status").alias("_st"))
    pr = coverage.groupBy(F.col("host").alias("_ph")).agg(F.first(X.first_set(F.col("collector_privilege_state"), F.when(F.col("is_administrator"), "Administrator").otherwise("StandardUser"))).alias("_p"))
    j = facts.join(st, (F.col("host") == F.col("_h")) & (F.lower("collection_step") == F.col("_s")), "left").join(pr, F.col("host") == F.col("_ph"), "left")
    return j.withColumns({"collection_status": F.coalesce("_st", F.lit("unknown")), "collection_privilege": F.coalesce("_p", F.lit("unknown"))}).select(facts.columns if {"collection_status", "collection_privilege"} <= set(facts.columns) else [*facts.columns, "collection_status", "collection_privilege"])


def provenance_line() -> Column:
    """E09"""
    part = lambda name, c: F.when(~X.blank(F.col(c)), F.concat(F.lit(f"{name}="), F.col(c)))
    return F.concat_ws(" | ", part("file", "source_file"), part("step", "collection_step"), part("status", "collection_status"), part("privilege", "collection_privilege"), part("parse", "parse_level"), F.when(F.col("fallback_used"), "fallback"))
