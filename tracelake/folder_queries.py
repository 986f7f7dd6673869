"""Registered queries of the folder intake: the events table written as evidence files of five cases with equal inner folders, taken in again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .evidence_queries import _E, events, said
from .operators import pivot
from .plans import refill, reports
from .session import checkpoint_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Type of event -> artifact, its first lines, and its last.
_FILES = {
    "click": ("process_list.csv", "PID,Name,Path,CommandLine,StartTime,User,SHA256", None),
    "view": ("usn_journal.csv", "Journal info\nversion 2\nUsn,File name,Reason,Time stamp,File attributes", None),
    "error": ("Security_filtered.csv", "TimeCreated,EventId,LevelDisplayName,ProviderName,Computer,UserId,TaskDisplayName,Message,EventData", None),
    "signup": ("kerberos_tickets.txt", "ObservedAtUtc: 2024-01-01 00:00:00", None),
    "credential": ("stored_credentials.txt", "ObservedAtUtc: 2024-01-01 00:00:00", None),
    "task": ("scheduled_tasks.xml", "<Tasks>", "</Tasks>"),
}
_SOURCES = "CASE t WHEN 'click' THEN 'Process' WHEN 'view' THEN 'USN' WHEN 'error' THEN 'EventLog:Security' WHEN 'signup' THEN 'KerberosTicketCache' ELSE CASE WHEN k::INT < 50 THEN 'StoredCredential' ELSE 'ScheduledTask' END END"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def laid(lines: DataFrame, root: str) -> None:
    """Writes lines (case, name, place, value) as the files <root>/<case>/IR_Output_1/<name>: a task for each file, then a rename for each."""
    spark = lines.sparkSession
    lines.repartition("case", "name").sortWithinPartitions("case", "name", "place").select("case", "name", "value").write.partitionBy("case", "name").text(f"{root}.parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.globStatus(path(f"{root}.parts/case=*/name=*/part-*")):
        part = f.getPath()
        name, case = (p.getName().partition("=")[2] for p in (part.getParent(), part.getParent().getParent()))
        to = path(f"{root}/{case}/IR_Output_1/{name}")
        fs.mkdirs(to.getParent())
        fs.rename(part, to)


def evidence(spark: SparkSession, sf_dir: str) -> str:
    """The events as evidence of five cases Z0 to Z4, of hosts DESK-H0 to DESK-H4; the case Z3 has one torn file."""
    e = events(spark, sf_dir).withColumn("t", F.when(F.col("t") != "purchase", F.col("t")).when(F.col("k").cast("int") < 50, "credential").otherwise("task"))
    row = {
        "click": F.concat(said("$i", ",,C:\\x\\", "$k", ".exe,,", "$at", ",u", "$u", ","), F.md5(F.col("k").cast("binary"))),
        "view": said("$i", ",f", "$k", ".txt,FILE_CREATE,", "$at", ",A"),
        "error": said("$at", ",1102,I,Eventlog,x,S,,m,"),
        "signup": said("#", "$i", ">     Client: u", "$u", " @ CORP\n        Server: cifs/s", "$k", ".corp @ CORP\n        Start Time: \n"),
        "credential": said("\n    Target: Domain:target=TERMSRV/s", "$k", "\n    Type: Domain Password\n    User: CORP\\u", "$u"),
        "task": said("<Task><RegistrationInfo><URI>\\T", "$k", "</URI></RegistrationInfo><Actions><Exec><Command>C:\\t\\", "$k", ".exe</Command></Exec></Actions></Task>"),
    }
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, (file, _, _) in _FILES.items():
        name, value = F.when(F.col("t") == t, file).otherwise(name), F.when(F.col("t") == t, row[t]).otherwise(value)
    case = F.concat(F.lit("Z"), F.substring("h", 2, 9)).alias("case")
    lines = e.select(case, name.alias("name"), F.col("i").alias("place"), value.alias("value"))
    ends = [(file, place, text) for file, first, last in _FILES.values() for place, text in ((-1, first), (1 << 60, last)) if text]
    lines = lines.unionByName(lines.select("case", "name").distinct().join(spark.createDataFrame(ends, "name string, place long, value string"), "name"))
    cases = e.select(case, F.col("h")).distinct()
    cover = F.lit('{"collection_mode_profile": "triagefast", "is_administrator": true, "steps": [{"step": "System Info", "status": "partial"}]}')
    for file, text in (("system_info.txt", F.concat(F.lit("Hostname: DESK-"), "h")), ("collection_coverage.json", cover), ("services.csv", F.when(F.col("h") == "H3", F.lit("Name,PathName\nx\0")))):
        lines = lines.unionByName(cases.select("case", F.lit(file).alias("name"), F.lit(0).cast("long").alias("place"), text.alias("value")).where("value IS NOT NULL"))
    root = f"{checkpoint_dir(spark)}/evidence-{uuid.uuid4().hex}"
    laid(lines, root)
    return root


@query(f"""{_E} SELECT 'Z' || h[2:] AS case_id, 'DESK-' || h AS host, {_SOURCES} AS source, count(*) AS facts, count(*) FILTER (t <> 'purchase' OR k::INT < 50) AS timed, CASE WHEN t = 'click' THEN 'partial' ELSE '' END AS status FROM e GROUP BY ALL""")
def folder_facts(spark, sf_dir):
    """Facts of a folder of cases, by host and source"""
    f = reports.facts_of_folder(spark, evidence(spark, sf_dir))
    status = F.when(F.col("source") == "Process", F.col("collection_status")).otherwise("")
    return f.groupBy("case_id", "host", "source", status.alias("status")).agg(F.count("*").alias("facts"), F.count("time").alias("timed"))


@query(f"""{_E} SELECT 'hash:' || md5(k) AS entity_key, count(DISTINCT h) AS hosts, count(*) AS facts, min('DESK-' || h) AS first_host FROM e WHERE t = 'click' GROUP BY 1 HAVING count(DISTINCT h) > 1""")
def folder_shared(spark, sf_dir):
    """A01 from files: entities of several hosts, whose inner folders have equal names"""
    f = reports.facts_of_folder(spark, evidence(spark, sf_dir))
    s = pivot.shared(model.fact_entities(f), ("Hash",))
    return s.select("entity_key", F.col("hosts").cast("long").alias("hosts"), "facts", F.get("host_list", F.lit(0)).alias("first_host"))


@query(f"""{_E} SELECT DISTINCT 'Z' || h[2:] AS case_id, 'DESK-' || h AS host, true AS ready, CASE WHEN h = 'H3' THEN 'IR_Output_1/services.csv: torn: zero byte at 15' ELSE '' END AS warnings, 'TriageFast' AS profile FROM e""")
def folder_cases(spark, sf_dir):
    """Cases with their hosts' names, warnings of files left out, recorded profiles"""
    c = reports.evidence(spark, evidence(spark, sf_dir)).cases()
    return c.select("case_id", "host", "ready", F.array_join("load_warnings", "; ").alias("warnings"), F.col("collection_mode_profile").alias("profile"))


@query(f"""{_E} SELECT 'Z' || h[2:] AS case_id, 'system_info.txt' AS name, 15 + length(h) + 1 AS size, sha256('Hostname: DESK-' || h || chr(10)) AS sha256 FROM e GROUP BY h""")
def folder_digests(spark, sf_dir):
    """Digests of files, hashed in chunks"""
    f = reports.evidence(spark, evidence(spark, sf_dir)).files
    return f.where("name = 'system_info.txt'").select(F.col("host").alias("case_id"), "name", "size", "sha256")


def changed(spark: SparkSession, root: str) -> None:
    """Case Z2 loses its journal, and the event log of Z3 moves to another folder of Z4."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(f"{root}/Z2/IR_Output_1/usn_journal.csv"), False)
    fs.mkdirs(path(f"{root}/Z4/IR_Output_2"))
    fs.rename(path(f"{root}/Z3/IR_Output_1/Security_filtered.csv"), path(f"{root}/Z4/IR_Output_2/Security_filtered.csv"))


@query(f"""{_E}, m AS (SELECT i, k, t, CASE WHEN t = 'error' AND h = 'H3' THEN 'H4' ELSE h END AS h FROM e WHERE t <> 'view' OR h <> 'H2')
SELECT 'Z' || h[2:] AS case_id, 'DESK-' || h AS host, {_SOURCES} AS source, count(*) AS facts, count(*) AS places, h IN ('H2', 'H3', 'H4') AS again FROM m GROUP BY ALL""")
def folder_refill(spark, sf_dir):
    """A store filled from a folder, then brought up to date with what changed there; again: cases that were read a second time"""
    root, path = evidence(spark, sf_dir), f"{checkpoint_dir(spark)}/refilled-{uuid.uuid4().hex}"
    refill.refill(spark, root, path)
    changed(spark, root)
    done = refill.refill(spark, root, path)
    n = done.snapshot.facts().groupBy("case_id", "host", "source").agg(F.count("*").alias("facts"), F.count_distinct("fact_ord").alias("places"))
    read = done.cases.select("case_id", F.lit(True).alias("again"))
    return n.join(read, "case_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
