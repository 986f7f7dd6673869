"""Readers of artifact files laid out as <root>/<host folder>/...: delimited text, console text, XML, JSON.

Delimited tables keep every value a string in a map by lower-case column name, since each file has
its own header; missing columns read as ''. Records never span lines. A row's place in its file
comes from counts of the lines in earlier splits, so one very large file is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X

FIELD = r',(?:"((?:[^"]|"")*)"|([^,]*))'


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, host, line, value): the lines of text files, numbered from 0 within each file.

    A block of a file is read by one task, so a line's place is the block's base (lines in earlier
    blocks) and its own distance from the block's least id. Only the table of blocks, a row each, is
    grouped and joined; both reads of the same files are split alike.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    base = base.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("base"))
    return raw.join(base, ["file", "block"]).select("file", host_folder(F.col("file")).alias("host"), (F.col("base") + F.col("id")).alias("line"), "value")


def host_folder(file: Column) -> Column:
    """The folder that holds a file, or, for files one folder deeper (EventLogs, MFT, ...), the one above."""
    parts = F.split(file, "/")
    folder, above = F.element_at(parts, -2), F.element_at(parts, -3)
    return F.when(F.lower(folder).isin("eventlogs", "mft", "usn", "registry", "memory"), above).otherwise(folder)


def fields(line: Column) -> Column:
    """RFC 4180 fields of a trimmed line. A comma is put before it, so that an empty first field is a match of its own."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.trim(line)), F.lit(FIELD), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(x, "^,", ""))
    return F.transform(bare, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(x)))


def _by_header(body: DataFrame, heads: DataFrame) -> DataFrame:
    """Lines and their file's header names -> (file, host, i, f): i numbers data rows from 0, f maps names to values."""
    j = body.join(heads, "file").where(F.col("line") > F.col("head_line")).where(~X.blank(F.col("value")))

    def named(v):
        return F.transform("names", lambda n, k: F.struct(n.alias("k"), F.coalesce(F.get(v, k), F.lit("")).alias("v")))

    def kept(e):
        return F.filter(e, lambda x, k: (F.array_position("names", x["k"]) == k + 1) & (x["k"] != ""))

    record = X.let(fields(F.col("value")), lambda v: X.let(named(v), kept))
    return j.select("file", "host", (F.col("line") - F.col("head_line") - 1).alias("i"), F.map_from_entries(record).alias("f"))


def table(spark: SparkSession, path: str) -> DataFrame:
    """(file, host, i, f) of headered delimited files."""
    t = lines(spark, path)
    heads = t.where("line = 0").select("file", F.lit(0).alias("head_line"), F.transform(fields(F.regexp_replace("value", "^﻿", "")), lambda x: F.lower(F.trim(x))).alias("names"))
    return _by_header(t, heads)


def table_after_preamble(spark: SparkSession, path: str, marks: tuple[str, ...] = ("usn", "file name", "reason")) -> DataFrame:
    """As table(); the header is a file's first line that holds all marks."""
    t = lines(spark, path)
    low = F.lower("value")
    found = t
    for m in marks:
        found = found.where(low.contains(m))
    heads = found.groupBy("file").agg(F.min("line").alias("head_line"), F.min_by("value", "line").alias("h"))
    return _by_header(t, heads.select("file", "head_line", F.transform(fields(F.col("h")), lambda x: F.lower(F.trim(x))).alias("names")))


def get(*names: str) -> Column:
    """A table row's value under the first of the names that has one, else ''."""
    return F.coalesce(*(F.try_element_at("f", F.lit(n.lower())) for n in names), F.lit(""))


def event_logs(spark: SparkSession, path: str) -> DataFrame:
    """table() of `<label>_filtered.csv` files, with the label."""
    return table(spark, path).withColumn("label", F.regexp_extract("file", r"(?i)([^/]*)_filtered\.csv$", 1))


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Exec action of the <Task> documents: file, host, task, exec, uri, run_as, command, arguments."""
    schema = "RegistrationInfo struct<URI:string>, Principals struct<Principal:array<struct<UserId:string,GroupId:string>>>, Actions struct<Exec:array<struct<Command:string,Arguments:string>>,ComHandler:array<struct<ClassId:string>>>, Settings struct<Enabled:string>, Triggers struct<LogonTrigger:array<string>,BootTrigger:array<string>,TimeTrigger:array<string>,CalendarTrigger:array<string>>"
    raw = spark.read.format("xml").option("rowTag", "Task").schema(schema).load(path)
    first = F.get("Principals.Principal", F.lit(0))
    return raw.select(
        F.col("_metadata.file_path").alias("file"), host_folder(F.col("_metadata.file_path")).alias("host"), F.monotonically_increasing_id().alias("task"),
        X.text(F.col("RegistrationInfo.URI")).alias("uri"), X.first_set(first["UserId"], first["GroupId"]).alias("run_as"), F.col("Actions.Exec").alias("execs"),
        F.col("Actions.ComHandler").alias("handlers"), F.coalesce("Settings.Enabled", F.lit("true")).alias("enabled"), F.col("Triggers").alias("triggers"),
    )


def task_actions(t: DataFrame) -> DataFrame:
    return t.select("file", "host", "task", "uri", "run_as", F.posexplode("execs").alias("exec", "e")).select("file", "host", "task", "exec", "uri", "run_as", X.text(F.col("e.Command")).alias("command"), X.text(F.col("e.Arguments")).alias("arguments"))


def task_table(t: DataFrame) -> DataFrame:
    """One wide row for each task."""
    joined = lambda c, f: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), f), "; ")
    kinds = F.array_join(F.array(*(F.when(F.col(f"triggers.{k}").isNotNull(), k) for k in ("LogonTrigger", "BootTrigger", "TimeTrigger", "CalendarTrigger"))), "; ")
    return t.select("file", "host", "uri", (F.lower("enabled") != "false").alias("enabled"), joined("execs", lambda e: e["Command"]).alias("commands"), joined("execs", lambda e: X.text(e["Arguments"])).alias("arguments"), F.array_join(F.transform("handlers", lambda h: h["ClassId"]), "; ").alias("com_handlers"), kinds.alias("triggers"), "run_as")


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON file."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumns({"host": host_folder(F.col("_metadata.file_path")), "file": F.col("_metadata.file_path")})


COVERAGE = "host_name string, evidence_id string, overall_status string, is_administrator boolean, collector_privilege_state string, collection_mode_profile string, steps array<struct<step:string,status:string,detail:string,artifact_count:int,artifacts_present:array<string>,artifacts_missing:array<string>>>"
ACQUISITION = "Status string, StartedAt string, EndedAt string, CollectorUser string, ToolPath string, DiagnosticCategory string, ValidationStatus string, OutputRelativePath string, OutputSha256 string, OutputSizeBytes long"
ANALYSIS = "Status string, StartedAt string, EndedAt string, CollectorUser string, ToolPath string, InputRelativePath string, DiagnosticCategory string, ValidationStatus string, OutputDirectoryRelativePath string, OutputFiles array<string>"


def blocks(spark: SparkSession, path: str, start: str) -> DataFrame:
    """Console text in blocks that begin with lines matching `start`: (file, host, observed, block, f), f by label.

    A line's block is counted from the starts in its split of the file and in those before, so a file is read by many tasks and no row holds more than a block.
    """
    raw = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.replace("value", F.lit("\r"), F.lit("")).alias("value")
    )
    starts = F.col("value").rlike(start)
    told = F.regexp_extract("value", r"(?i)^\s*ObservedAtUtc:\s*(.*)$", 1)
    here = F.when(F.col("value").rlike(r"(?i)^\s*ObservedAtUtc:"), F.struct("split", "id", told.alias("told")))
    n = raw.groupBy("file", "split").agg(F.count_if(starts).alias("n"), F.min(here).alias("first"))
    before = Window.partitionBy("file").orderBy("split")
    n = n.select("file", "split", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.coalesce(F.min("first").over(Window.partitionBy("file"))["told"], F.lit("")).alias("observed"))
    own = F.sum(starts.cast("long")).over(Window.partitionBy("file", "split").orderBy("id"))
    each = raw.withColumn("own", own).join(n, ["file", "split"]).withColumn("block", F.col("own") + F.col("base") - 1).where("block >= 0")
    each = each.groupBy("file", "observed", "block").agg(F.array_sort(F.collect_list(F.struct("split", "id", "value"))).alias("l"))
    each = each.select("file", host_folder(F.col("file")).alias("host"), "observed", F.col("block").cast("int").alias("block"), F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("value"))
    line = r"(?m)(?:^|>)\s*([A-Za-z][A-Za-z ().-]*?)\s*:[ \t]*(.*)$"
    label = lambda x: F.lower(F.trim(F.regexp_extract(x, r"([A-Za-z][A-Za-z ().-]*?)\s*:", 1)))
    pair = lambda x: F.struct(label(x).alias("k"), F.trim(F.regexp_extract(x, r":[ \t]*(.*)$", 1)).alias("v"))
    pairs = F.transform(F.regexp_extract_all("value", F.lit(line), F.lit(0)), pair)
    return each.select("file", "host", "observed", "block", X.first_of_each(pairs).alias("f"))


def kerberos(spark: SparkSession, path: str) -> DataFrame:
    return blocks(spark, path, r"^\s*#\d+>")


def credentials(spark: SparkSession, path: str) -> DataFrame:
    return blocks(spark, path, r"^\s*Target:")


def columns_of_text(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """White-space separated console tables, by place."""
    t = lines(spark, path).withColumn("v", F.split(F.trim("value"), r"\s+")).where(F.size("v") >= len(names))
    return t.select("file", "host", "line", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)))


def host_name(spark: SparkSession, path, folder: Column | None = None) -> DataFrame:
    """(folder, host): the name on the last `Hostname:` line, else the folder's. folder: a file's folder, if not the one that holds it."""
    t = lines(spark, path)
    t = (t if folder is None else t.withColumn("host", folder)).withColumn("n", F.regexp_extract("value", r"(?i)^\s*Hostname:\s*(.*\S)", 1))
    named = t.groupBy(F.col("host").alias("folder")).agg(F.max_by("n", F.when(F.col("n") != "", F.col("line"))).alias("n"))
    return named.select("folder", F.coalesce(F.nullif("n", F.lit("")), "folder").alias("host"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below root: (file, host, rel, name, size, modified, file_in_case), contents unread. file_in_case: not one that lies in root itself."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    top = F.regexp_replace(F.lit(root.rstrip("/")), "^file:/*", "/")
    below = F.expr("substring(regexp_replace(path, '^file:/*', '/'), length(t) + 2)")
    f = f.withColumn("t", top).withColumn("b", below)
    return f.select(F.col("path").alias("file"), F.substring_index("b", "/", 1).alias("host"), F.regexp_replace("b", "^[^/]*/", "").alias("rel"), F.element_at(F.split("b", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("b").contains("/").alias("file_in_case"))


def cases(files: DataFrame, ready: tuple[str, ...] = ("process_list.csv", "services.csv", "autoruns_registry.csv")) -> DataFrame:
    """A case for each host folder, with a warning where none of its files can be read as evidence."""
    c = files.groupBy("host").agg(F.count("*").alias("files"), F.bool_or(F.lower("name").isin(*ready) | F.lower("name").rlike(r"_filtered\.csv$|\.json$|\.xml$|\.txt$|\.csv$")).alias("ready"))
    return c.select(F.col("host").alias("case_id"), "host", "ready", "files", F.when(~F.col("ready"), F.array(F.lit("no readable evidence"))).otherwise(F.array().cast("array<string>")).alias("load_warnings"))


def artifact(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (rel) and host the best file: at that path, then of that name at the root, then of that name anywhere."""
    name = F.element_at(F.split("w", "/"), -1)
    w = wanted.select(F.col("rel").alias("w")).withColumn("wn", F.lower(name))
    j = files.join(w, F.lower("name") == F.col("wn"))
    rank = F.when(F.lower("rel") == F.lower("w"), 0).when(F.lower("rel") == F.col("wn"), 1).otherwise(2)
    return j.withColumn("rank", rank).withColumn("k", F.row_number().over(Window.partitionBy("host", "w").orderBy("rank", "rel"))).where("k = 1").select("host", F.col("w").alias("wanted"), "file", "rel", "rank")


def mft(spark: SparkSession, path: str) -> DataFrame:
    """The file-system preview by place: 14 columns, or 5 in the short form; created is the standard time if usable, else the name's."""
    names = ("record", "in_use", "is_dir", "file_name", "full_path", "size", "std_created", "std_modified", "std_changed", "std_accessed", "fn_created", "fn_modified", "fn_changed", "fn_accessed")
    t = lines(spark, path).where("line > 0").withColumn("v", fields(F.col("value"))).where(F.size("v") >= 5)
    t = t.select("file", "host", (F.col("line") - 1).alias("i"), *(X.text(F.get("v", F.lit(k))).alias(n) for k, n in enumerate(names)))
    times = {n: X.parse_time(F.col(n)) for n in names if n.startswith(("std_", "fn_"))}
    t = t.withColumns(times)
    return t.withColumn("size", F.expr("try_cast(size AS long)")).withColumn("created", F.when(X.usable(F.col("std_created")), F.col("std_created")).otherwise(F.col("fn_created")))


def visits(rows: DataFrame, most: int | None = 5000) -> DataFrame:
    """Browser visits (url, title, raw time) newest first; all of them where most is None."""
    out = rows.withColumn("visited", X.epoch(F.col("raw"))).where("visited IS NOT NULL").orderBy(F.desc("visited"), "url")
    return out if most is None else out.limit(most)
