"""Timelines and log views: unions of time-ordered rows, filters, indicators, highlights, recency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X

# Event ids that are highlighted, in order.
HIGHLIGHTS = {
    "4624": "Logon Success", "4625": "Logon Failure", "4648": "Explicit Credential Use", "4672": "Special Privileges", "4688": "Process Creation",
    "4697": "Service Installed (Security)", "4698": "Scheduled Task Created", "4702": "Scheduled Task Updated", "4768": "Kerberos TGT",
    "4769": "Kerberos Service Ticket", "4776": "NTLM Validation", "7045": "Service Installed (System)", "1102": "Log Cleared", "4719": "Audit Policy Changed",
    "4720": "User Created", "4722": "User Enabled", "4725": "User Disabled", "4732": "User Added to Local Group", "4104": "PowerShell ScriptBlock",
    "5140": "SMB Share Access", "5145": "SMB Share Object Access", "1149": "RDP Auth Success",
}


def of_facts(facts: DataFrame) -> DataFrame:
    """Facts as timeline events. Jump-list rows enter once, through the activity table."""
    jump = F.lower("source").isin("jumplist") & (F.lower(X.text(F.col("source_file"))) != "activity_timeline.csv")
    return facts.where(~jump & X.usable_event(F.col("time"))).select("case_id", "host", "fact_ord", "time", "source", "action", X.summary(F.col("entity_refs")).alias("entities"), "details", "entity_refs", "time_kind", "time_confidence", "raw_ref")


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("time"), "source", "case_id", "fact_ord")


def merged(parts: dict[str, DataFrame]) -> DataFrame:
    """Activity inputs (time, action, path, user, details), each under its source's name."""
    return reduce(DataFrame.unionByName, [d.select("time", F.lit(k).alias("source"), "action", "path", "user", "details") for k, d in parts.items()])


def window(events: DataFrame, source: str | None = None, start=None, end=None) -> DataFrame:
    """A source, and whole minutes from start to the end of end's minute, in either order."""
    if source:
        events = events.where(F.lower("source") == source.lower())
    lo, hi = (F.date_trunc("minute", F.lit(x).cast("timestamp")) for x in (start, end))
    if start is not None and end is not None:
        lo, hi = F.least(lo, hi), F.greatest(lo, hi)
    if start is not None:
        events = events.where(F.col("time") >= lo)
    if end is not None:
        events = events.where(F.col("time") < hi + F.expr("interval 1 minute"))
    return events


def focused(events: DataFrame, key: str) -> DataFrame:
    """Events that reference the entity, or else name its value in their text."""
    kind, _, value = key.partition(":")
    exact = F.exists("entity_refs", lambda r: (F.lower(r["type"]) == kind.lower()) & (F.lower(F.trim(r["value"])) == value.strip().lower()))
    return events.where(exact | F.lower(F.concat_ws(" ", "entities", "details")).contains(value.strip().lower()))


def facts_view(facts: DataFrame, key: str | None = None, raw_ref: str | None = None, most: int | None = 50_000) -> DataFrame:
    """P10: optional entity, the preferred row first, then newest, then source; all rows where most is None."""
    if key:
        kind, _, value = key.partition(":")
        facts = facts.where(F.exists("entity_refs", lambda r: (F.lower(r["type"]) == kind.lower()) & (F.lower(F.trim(r["value"])) == value.strip().lower())))
    wanted = F.coalesce(F.col("raw_ref") == F.lit(raw_ref), F.lit(False))
    out = facts.orderBy(wanted.desc(), F.desc_nulls_last("time"), "source", "case_id", "fact_ord")
    return out if most is None else out.limit(most)


def keywords(df: DataFrame, steps: list[tuple[bool, str]], columns: list[str] | None = None) -> DataFrame:
    """(include, keyword) filters in turn; a row has a keyword if any column contains it, case ignored."""
    cols = [F.lower(X.text(F.col(c))) for c in (columns or df.columns)]
    for include, word in steps:
        has = reduce(lambda a, b: a | b, [c.contains(word.lower()) for c in cols])
        df = df.where(has if include else ~has)
    return df


def recent(events: DataFrame, by: str, time: str, days: int, most: int, tie: str) -> DataFrame:
    """Rows in the last days before each log's own newest, at most so many for each.

    The newest time comes from an aggregate and rows before the window go first, so the ranking sees little of a large log.
    """
    last = events.groupBy(by).agg(F.max(time).alias("_last"))
    near = events.join(last, by).where(F.col(time) >= F.col("_last") - F.make_interval(days=F.lit(days)))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time), tie))).where(F.col("rank") <= most).drop("_last")


def indicators(events: DataFrame, minutes: int = 5, least: int = 2, most: int | None = 200) -> DataFrame:
    """(host, time, source, indicator) -> indicator and bucket on several hosts; rows without time share the bucket `static`."""
    bucket = F.when(X.usable_event(F.col("time")), F.date_format(X.bucket_start(F.col("time"), minutes), "yyyy-MM-dd HH:mm")).otherwise("static")
    g = events.where(~X.blank(F.col("indicator"))).groupBy("indicator", bucket.alias("bucket")).agg(F.count_distinct("host").alias("hosts"), F.count("*").alias("events"), F.array_sort(F.collect_set("source")).alias("sources"))
    g = g.where(F.col("hosts") >= least).orderBy("indicator", "bucket")
    return g.limit(most) if most else g


def _events_own(event_id: Column, data: Column, pair, texts: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], fields: dict[tuple[str, ...], dict[str, tuple[str, ...]]]) -> Column:
    """What an event's own data, a map, say of it, else ''; data is named often, so it should be worked out already (X.let). texts: by id the names of its two values, which `pair` puts together; fields: by ids the labelled ones."""
    v = lambda names: X.lookup(data, *names) if names else F.lit("")
    c = F.when(F.lit(False), "")
    for i, (a, b) in texts.items():
        c = c.when(event_id == i, pair(v(a), v(b)))
    for ids, parts in fields.items():
        said = [F.when(~X.blank(v(n)), F.concat(F.lit(f"{label}="), X.single_line(v(n)))) for label, n in parts.items()]
        c = c.when(event_id.isin(*ids), pair(F.lit(""), F.concat_ws(" ", *said)))
    return F.coalesce(c, F.lit(""))


# By event id the names of the data that stand for it.
PROGRAM, COMMAND = ("NewProcessName", "ProcessName", "Image"), ("CommandLine", "ProcessCommandLine")
BY_ID = {"4688": (PROGRAM, COMMAND), "4698": (("TaskName", "Task"), ("SubjectUserName", "User")), "7045": (("ServiceName",), ("ImagePath", "ServiceFileName"))}
LOGONS = {"User": ("TargetUserName", "SubjectUserName"), "Type": ("LogonType",), "IP": ("IpAddress", "ClientAddress", "SourceAddress", "RemoteAddress")}
SHARES = {"Share": ("ShareName",), "IP": ("IpAddress", "ClientAddress", "SourceAddress")}


def event_indicator(event_id: Column, provider: Column, message: Column, event_data: Column) -> Column:
    """`event:<id>` and what its data say, else its message, else all its data, else its provider; lower case, 120 characters at most."""
    i = F.when(X.blank(event_id), "unknown").otherwise(F.trim(event_id))
    short = lambda a, b: X.indicator(b, a)
    own = X.let(X.pairs(event_data), lambda m: _events_own(i, m, short, {**BY_ID, "4104": ((), ("ScriptBlockText",))}, {("4624", "4625"): LOGONS}))
    said = X.let(own, lambda o: X.first_set(o, X.indicator(F.when(X.blank(message), X.text(event_data)).otherwise(message), X.text(provider))))
    return F.concat(F.lit("event:"), i, X.let(said, lambda s: F.when(s != "", F.concat(F.lit(":"), s)).otherwise("")))


def sample_text(event_id: Column, message: Column, event_data: Column) -> Column:
    """an event's sample: what its data say by event id, else its message in one line, else its first data."""
    i = F.trim(X.text(event_id))
    joined = lambda a, b: X.truncate(F.translate(F.when(X.blank(b), a).when(X.blank(a), b).otherwise(F.concat(a, F.lit(" | "), b)), "\r\n", "  "), 120)

    def told(data):
        own = _events_own(i, data, joined, {**BY_ID, "4104": (("ScriptBlockText",), ())}, {("4624", "4625"): LOGONS, ("5140",): SHARES})
        return X.let(own, lambda o: X.first_set(o, X.single_line(message), X.flatten(data, 8, 120, 240)))

    return X.let(X.pairs(event_data), told)


def highlights(rows: DataFrame, kind: str, order: str, sample: str, labels: dict[str, str] = HIGHLIGHTS, first: int = 3) -> DataFrame:
    """For each listed kind its label, count, and first samples, in the list's order."""
    table = F.broadcast(rows.sparkSession.createDataFrame([(i, k, v) for i, (k, v) in enumerate(labels.items())], "place int, kind string, label string"))
    known = rows.select(F.col(kind).cast("string").alias("kind"), F.col(order).alias("o"), F.col(sample).cast("string").alias("s")).join(table, "kind")
    counts = known.groupBy("place", "kind", "label").agg(F.count("*").alias("events"))
    top = known.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("o", "s"))).where(F.col("k") <= first)
    shown = top.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), " || ").alias("samples"))
    return counts.join(shown, "kind", "left").orderBy("place")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of a page, from page 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_samples(facts: DataFrame, most: int = 100) -> DataFrame:
    """Of the headless summary: the first facts built."""
    return facts.orderBy("case_id", "fact_ord").limit(most)


def newest_samples(facts: DataFrame, most: int = 100) -> DataFrame:
    """A20"""
    return facts.orderBy(F.desc_nulls_last("time"), "source", "case_id", "fact_ord").limit(most)
