"""Coverage, freshness, manifests, redaction, reconciliation and small joins."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import expr as X


def step_status(present: Column, missing: Column, failed: Column) -> Column:
    """A13"""
    return F.when(failed, "failed").when((present > 0) & (missing == 0), "complete").when(present > 0, "partial").otherwise("missing")


def coverage(expected: DataFrame, present: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Expected (host, step, artifact) against present (host, artifact) -> status of each host's steps."""
    p = present.select("host", F.lower("artifact").alias("a")).distinct().withColumn("here", F.lit(True))
    j = expected.withColumn("a", F.lower("artifact")).join(p, ["host", "a"], "left")
    g = j.groupBy("host", "step").agg(F.count("here").alias("present"), F.count_if(F.col("here").isNull()).alias("missing"), F.array_sort(F.collect_set(F.when(F.col("here").isNull(), F.col("artifact")))).alias("artifacts_missing"))
    bad = F.lit(False)
    if failed is not None:
        g = g.join(failed.select("host", "step", F.lit(True).alias("bad")).distinct(), ["host", "step"], "left")
        bad = F.coalesce("bad", F.lit(False))
    return g.withColumn("status", step_status(F.col("present"), F.col("missing"), bad)).drop("bad")


def overall(steps: DataFrame) -> DataFrame:
    """Counts by status and a host's overall status."""
    n = {s: F.count_if(F.col("status") == s).alias(s) for s in ("complete", "partial", "failed", "missing", "skipped")}
    g = steps.groupBy("host").agg(*n.values(), F.count("*").alias("steps"))
    return g.withColumn("overall", F.when(F.col("complete") + F.col("skipped") == F.col("steps"), "complete").when(F.col("complete") + F.col("partial") > 0, "partial").otherwise("failed"))


def reconciled(status: Column, present: Column) -> Column:
    """Q03: a sidecar that says complete without its file has failed."""
    return F.when((F.lower(status) == "complete") & ~present, "failed").otherwise(status)


def demoted(status: Column, matched: Column, required: Column) -> Column:
    """Q04"""
    s = F.lower(status)
    return F.when((s == "complete") & (required > 0) & (matched == 0), "failed").when((s == "complete") & (matched < required), "partial").otherwise(status)


def glob_regex(pattern: Column) -> Column:
    """`*` and `?` as a regular expression for whole names, case ignored."""
    safe = F.regexp_replace(pattern, r"([.^$+(){}\[\]|\\])", r"\\$1")
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(safe, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def required_outputs(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """For each (host, pattern) the number of that host's files (host, rel) whose path or base name it matches. The join is on host; patterns of a host are few."""
    p = patterns.withColumn("rx", glob_regex(F.col("pattern")))
    f = files.select("host", "rel")
    hit = p.join(f, "host").where(F.expr("rel rlike rx") | F.expr("regexp_extract(rel, '[^/\\\\\\\\]*$', 0) rlike rx"))
    n = hit.groupBy("host", "pattern").agg(F.count_distinct("rel").alias("matched"))
    return p.drop("rx").join(n, ["host", "pattern"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


def freshness(snapshots: DataFrame, sources: DataFrame) -> DataFrame:
    """Current, stale (a source changed over a second after the snapshot), not_present or unknown."""
    g = sources.groupBy("host").agg(F.max("modified").alias("newest"), F.count("*").alias("sources"))
    j = snapshots.join(g, "host", "left")
    late = F.col("newest") > F.col("snapshot") + F.expr("interval 1 second")
    return j.withColumn("freshness", F.when(F.col("snapshot").isNull(), "not_present").when(F.col("newest").isNull(), "unknown").when(late, "stale").otherwise("current"))


def manifest(files: DataFrame) -> DataFrame:
    """(host, rel, content) -> path, size and SHA-256 of each file."""
    return files.select("host", "rel", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def digest(manifest: DataFrame) -> DataFrame:
    """SHA-256 over `path TAB hash NEWLINE` lines, paths in case-ignoring order.

    One task hashes a host's lines, as each block of a hash needs the one before. Spark sorts them, spilling
    what memory does not hold, and they are hashed batch by batch.
    """
    line = F.concat("rel", F.lit("\t"), "sha256", F.lit("\n")).alias("line")
    lines = manifest.repartition("host").sortWithinPartitions("host", F.lower("rel"), "rel", "sha256").select("host", line)
    return lines.mapInArrow(_hashed, StructType([lines.schema["host"], StructField("digest", StringType()), StructField("files", LongType(), False)]))


def _hashed(batches):
    """(host, line) in order of host -> host, digest and number of its lines; null lines count as empty."""
    import hashlib

    import pyarrow as pa

    host, state, files, kind = None, None, 0, None
    for b in batches:
        done, kind = [], b.schema.field("host").type
        for h, g in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), key=lambda x: x[0]):
            if state is None or h != host:
                if state is not None:
                    done.append((host, state.hexdigest(), files))
                host, state, files = h, hashlib.sha256(), 0
            lines = [x[1] for x in g]
            state.update("".join(x for x in lines if x is not None).encode())
            files += len(lines)
        if done:
            yield _named(pa, done, kind)
    if state is not None:
        yield _named(pa, [(host, state.hexdigest(), files)], kind)


def _named(pa, rows, kind):
    host, digest, files = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(host, kind), pa.array(digest, pa.string()), pa.array(files, pa.int64())], ["host", "digest", "files"])


def redacted(df: DataFrame, profile: str = "Basic", text: tuple[str, ...] = (), principals: tuple[str, ...] = (), paths: tuple[str, ...] = (), lists: tuple[str, ...] = ()) -> DataFrame:
    """Q01: profile None, Basic or Strict. Basic masks literals and paths in text, principals, and keeps base names; Strict blanks principals and paths too."""
    if profile == "None":
        return df
    strict = profile == "Strict"
    out = {c: X.redact(F.col(c), True) for c in text}
    out |= {c: F.when(X.blank(F.col(c)), F.col(c)).otherwise("[redacted]") if strict else X.mask_principal(F.col(c)) for c in principals}
    out |= {c: F.when(X.blank(F.col(c)), F.col(c)).otherwise("[redacted]") if strict else X.base_name(F.col(c)) for c in paths}
    out |= {c: F.transform(c, lambda v: X.redact(v, True)) for c in lists}
    return df.withColumns(out)


def warnings(rows: DataFrame, drop_prefix: str | None = None) -> DataFrame:
    """Each host's distinct warnings, case ignored, first spelling kept, prefixed by the host."""
    if drop_prefix:
        rows = rows.where(~F.lower("warning").startswith(drop_prefix.lower()))
    one = rows.groupBy("host", F.lower("warning").alias("k")).agg(F.min_by("warning", "place").alias("warning"), F.min("place").alias("place"))
    return one.select("host", "place", F.concat("host", F.lit(": "), "warning").alias("warning"))


def notes_by_source(facts: DataFrame, notes: dict[str, str]) -> DataFrame:
    """Each host's notes for the sources it has."""
    flags = facts.groupBy("host").agg(*(F.bool_or(F.lower("source") == k.lower()).alias(f"n{i}") for i, k in enumerate(notes)))
    return flags.select("host", F.array_compact(F.array(*(F.when(F.col(f"n{i}"), v) for i, v in enumerate(notes.values())))).alias("notes"))


def note_summary(rows: DataFrame, most: int = 5) -> DataFrame:
    """A10: distinct (source, note) pairs: how many, of how many sources, the first few and `+k more`."""
    d = rows.where(~X.blank(F.col("note"))).select("source", "note").distinct()
    top = d.orderBy("source", "note").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "note"))), lambda x: F.concat_ws(": ", x["source"], x["note"])), " | ").alias("shown"))
    n = d.agg(F.count("*").alias("pairs"), F.count_distinct("source").alias("sources"))
    return n.join(top).withColumn("more", F.greatest(F.col("pairs") - most, F.lit(0)))


def fallback_notes(facts: DataFrame) -> DataFrame:
    """A11"""
    return facts.where(F.col("fallback_used") & ~X.blank(F.col("parser_note"))).select(F.concat_ws(": ", "source", "parser_note").alias("note")).distinct()


def profile_mix(cases: DataFrame) -> DataFrame:
    """A18"""
    return cases.agg(F.array_sort(F.collect_set(F.nullif(F.trim("collection_mode_profile"), F.lit("")))).alias("profiles"), F.count_if(X.blank(F.col("collection_mode_profile"))).alias("unlabeled"))


def latest_time(rows: DataFrame, columns: list[str], now: Column) -> DataFrame:
    """The newest of several times, those over a day ahead of now ignored."""
    bound = now + F.expr("interval 1 day")
    each = [F.when(F.col(c) < bound, F.col(c)) for c in columns]
    return rows.agg(F.max(F.greatest(*each) if len(each) > 1 else each[0]).alias("latest"))


def artifact_counts(listing: DataFrame) -> DataFrame:
    """A14"""
    return listing.groupBy("artifact").agg(F.count("*").alias("rows"))


def log_labels(raw: DataFrame, derived: DataFrame) -> DataFrame:
    """Labels on either side; `partial` if one side lacks some."""
    r = raw.select(F.lower("label").alias("k"), F.col("label").alias("raw")).dropDuplicates(["k"])
    d = derived.select(F.lower("label").alias("k"), F.col("label").alias("derived")).dropDuplicates(["k"])
    j = r.join(d, "k", "full_outer")
    sorted_set = lambda c: F.array_sort(F.collect_set(c))
    g = j.agg(F.count("*").alias("labels"), sorted_set(F.when(F.col("derived").isNull(), F.col("raw"))).alias("raw_only"), sorted_set(F.when(F.col("raw").isNull(), F.col("derived"))).alias("derived_only"))
    return g.withColumn("status", F.when(F.col("labels") == 0, "missing").when((F.size("raw_only") > 0) | (F.size("derived_only") > 0), "partial").otherwise("complete"))


def decoded(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (id) with the name of a lookup (id, name), else the raw id."""
    one = names.groupBy(F.col("id").alias("_id")).agg(F.min("name").alias("_name"))
    return rows.join(one, F.col("id") == F.col("_id"), "left").withColumn("name", F.coalesce(F.nullif(F.trim("_name"), F.lit("")), F.col("id").cast("string"))).drop("_id", "_name")


def user_of_path(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths (path) -> user of the longest profile root (root, user) that is a prefix, else the segment after `\\Users\\`.

    Roots end at a separator, so each path's prefixes that end at one are looked up by equality; no pair of path and root is tried.
    """
    p = F.lower("path")
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda i: i), lambda i: F.substring(p, i, 1).isin("\\", "/") | (i == F.length("path")))
    pre = paths.select("path").distinct().select("path", F.explode(ends).alias("i")).select("path", F.rtrim(F.substring(p, F.lit(1), F.col("i"))).alias("k"))
    pre = pre.withColumn("k", F.regexp_replace("k", r"[\\/]+$", ""))
    r = roots.select(F.regexp_replace(F.lower("root"), r"[\\/]+$", "").alias("k"), "user").groupBy("k").agg(F.min("user").alias("user"))
    best = pre.join(r, "k").groupBy("path").agg(F.max_by("user", F.length("k")).alias("u"))
    named = F.regexp_extract("path", r"(?i)[\\/]Users[\\/]([^\\/]+)", 1)
    return paths.join(best, "path", "left").withColumn("user", F.coalesce("u", named)).drop("u")


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Urls (url) with whether a rule (url) has the same scheme, host and port and a path that is a prefix on a segment boundary, case kept."""

    def parts(df, name):
        u = F.col("url")
        port = F.coalesce(F.nullif(F.regexp_extract(u, r"^[^:/?#]+://[^/?#:]*:(\d+)", 1), F.lit("")), F.when(F.lower(u).startswith("https:"), "443").otherwise("80"))
        return df.select("url", F.lower(F.regexp_extract(u, r"^([^:/?#]+)://", 1)).alias("scheme"), F.lower(F.regexp_extract(u, r"^[^:/?#]+://([^/?#:]*)", 1)).alias("h"), port.alias("port"), F.regexp_replace(F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), "/+$", "").alias(name))

    r = parts(rules, "rule_path").drop("url").distinct()
    hit = parts(urls, "p").join(r, ["scheme", "h", "port"]).where((F.col("p") == F.col("rule_path")) | F.expr("startswith(p, concat(rule_path, '/'))"))
    yes = hit.select("url").distinct().withColumn("yes", F.lit(True))
    return urls.join(yes, "url", "left").withColumn("allowed", F.coalesce("yes", F.lit(False))).drop("yes")


def reconcile(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, name, stamp) of two extracts, the other side's names as a set by key: match, known_gap (the other side has no name) or mismatch; stamps compared where both have one."""
    t = theirs.join(ours.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.collect_set(F.lower("name")).alias("names"), F.collect_set("stamp").alias("stamps"))
    j = ours.join(t, "key")
    kind = F.when(F.array_contains("names", F.lower(F.col("name"))), "match").when(F.size("names") == 0, "known_gap").otherwise("mismatch")
    same = F.when(F.col("stamp").isNotNull() & (F.size("stamps") > 0), F.array_contains("stamps", F.col("stamp")))
    return j.select("key", kind.alias("names"), same.alias("stamp_equal"))


def recall(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Distinct values of theirs (value) that ours has, of all, in percent."""
    o = ours.select(F.lower("value").alias("v")).distinct().withColumn("hit", F.lit(1))
    t = theirs.select(F.lower("value").alias("v")).where("v IS NOT NULL").distinct().join(o, "v", "left")
    g = t.agg(F.count("*").alias("reference"), F.count("hit").alias("found"))
    return g.withColumn("percent", F.round(100 * F.col("found") / F.nullif(F.col("reference"), F.lit(0)), 1))


def annotated(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """J15"""
    return cases.join(notes.withColumn("tags", X.tags(F.col("tags"))), "case_id", "left")


def distinct_ci(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values, case ignored, first spelling kept."""
    return df.groupBy(F.lower(column).alias("_k")).agg(F.min_by(column, order).alias(column)).drop("_k")
