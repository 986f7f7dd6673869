"""Whole questions: analyse a folder of hosts, correlate them, draw a graph; and the documents they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__, model
from ..functions import expr as X
from ..operators import enrich, graph, hunt, normalize, pivot, quality
from ..sources import intake, store, tables

# Where each artifact lies below a host's folder.
FILES = {
    "process_list.csv": normalize.process, "logon_sessions.csv": normalize.logon_session, "network_resources.csv": normalize.network_resource, "server_connections.csv": normalize.server_connection,
    "autoruns_registry.csv": normalize.autorun, "services.csv": normalize.service, "activity_timeline.csv": normalize.activity, "bam_dam.csv": normalize.bam_dam, "bits_jobs.csv": normalize.bits,
    "jump_lists.csv": normalize.jump_list, "wmi_persistence.csv": normalize.wmi, "amcache_programs.csv": normalize.amcache_programs, "amcache_files.csv": normalize.amcache_files,
    "shimcache_entries.csv": normalize.shimcache, "srum_network_usage.csv": normalize.srum, "srum_app_usage.csv": lambda r: normalize.srum(r, True), "shellbags.csv": normalize.shell_bags,
}


#: Names that are looked for below a case's folder besides FILES.
OTHERS = ("usn_journal.csv", "mft_preview.csv", "scheduled_tasks.xml", "kerberos_tickets.txt", "stored_credentials.txt", "memory_acquisition.json", "memory_analysis.json", "prefetch.csv")


#: What a reader of the full log should know of facts of a source.
NOTES = {
    "ScheduledTask": "tasks say what is set to run, not that it ran", "Service": "services are as configured when collected", "StoredCredential": "stored credentials come from listed text; servers are guessed from it",
    "KerberosTicketCache": "tickets are dated by their start where it can be read, else by when they were seen", "Autorun": "autoruns are entries as found; a value may be a bare command", "MFT": "file-system times are not times of running",
    "USN": "journal rows may have a file's name without its path", "Amcache": "program inventory differs between system builds", "ShimCache": "cached entries are candidates for having run", "SRUMNetwork": "usage covers the core tables only", "SRUMApp": "usage covers the core tables only",
}


def evidence(spark: SparkSession, root: str, cases: DataFrame | None = None) -> intake.Intake:
    """What lies below root, <root>/<case>/..., judged file by file; of these cases (case_id) only, if given."""
    return intake.take(spark, root, (*FILES, *OTHERS), graph.saved, cases)


def facts_of_folder(spark: SparkSession, root: str, zones: DataFrame | None = None) -> DataFrame:
    """The enriched facts of every case below root. zones: (host, zone), the time zones of hosts, by name or folder, where they are not UTC."""
    return facts_of(evidence(spark, root), zones)


def facts_of(taken: intake.Intake, zones: DataFrame | None = None) -> DataFrame:
    """The enriched facts of an intake: case_id is the case's folder, host its name."""
    spark, there, hosts = taken.spark, taken.paths, taken.hosts()
    clocks = None
    if zones is not None:
        z = zones.select(F.col("host").alias("z"), "zone")
        clocks = hosts.join(z, (F.col("host") == F.col("z")) | (F.col("case_id") == F.col("z"))).groupBy(F.col("case_id").alias("host")).agg(F.first("zone").alias("zone"))

    def local(rows: DataFrame) -> DataFrame:
        rows = taken.at_home(rows)
        return rows if clocks is None else rows.join(clocks, "host", "left")

    makers = {n: (lambda p: tables.table(spark, p), make) for n, make in FILES.items()} | {
        "*_filtered.csv": (lambda p: tables.event_logs(spark, p), normalize.event_log),
        "usn_journal.csv": (lambda p: tables.table_after_preamble(spark, p), normalize.usn),
        "mft_preview.csv": (lambda p: tables.mft(spark, p), normalize.mft),
        "scheduled_tasks.xml": (lambda p: tables.task_actions(tables.tasks(spark, p)), normalize.scheduled_task),
        "kerberos_tickets.txt": (lambda p: tables.kerberos(spark, p), normalize.kerberos_ticket),
        "stored_credentials.txt": (lambda p: tables.credentials(spark, p), normalize.stored_credential),
        "memory_acquisition.json": (lambda p: tables.sidecar(spark, p, tables.ACQUISITION), normalize.memory),
        "prefetch.csv": (lambda p: intake.prefetch(spark, p), normalize.prefetch),
        "memory_analysis.json": (lambda p: tables.sidecar(spark, p, tables.ANALYSIS), lambda r: normalize.memory(r, True)),
    }
    parts = [make(local(read(there[n]))) for n, (read, make) in makers.items() if n in there]
    if not parts:
        raise store.StoreError("no readable artifact")
    facts = enrich.with_provenance(enrich.with_time_defaults(normalize.union(parts)), taken.coverage())
    return facts.drop("host").join(hosts, "case_id", "left").select(facts.columns)


def heading(spark: SparkSession, schema: str, **values) -> DataFrame:
    """One row: what every export document begins with, and these values. Counts may be one-row frames; they are cross-joined as such."""
    first = {"generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'"), "export_schema": F.lit(schema), "tool_name": F.lit("tracelake"), "tool_version": F.lit(__version__)}
    row = spark.range(1).select(*(c.alias(k) for k, c in first.items()))
    for k, v in values.items():
        row = row.crossJoin(v.select(F.col(v.columns[0]).alias(k))) if isinstance(v, DataFrame) else row.withColumn(k, v if isinstance(v, Column) else F.lit(v))
    return row


def hosts_of(facts: DataFrame) -> DataFrame:
    """host, case_id, fact_count of each case, in order."""
    return facts.groupBy("host", "case_id").agg(F.count("*").alias("fact_count")).orderBy("host", "case_id")


def _counted(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """by and `name`: a map of key k to how often it occurs. Keys are sources and types: few."""
    n = df.groupBy(*by, "k").agg(F.count("*").alias("n"))
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name)
    return (n.groupBy(*by) if by else n).agg(entry)


def fact_document() -> Column:
    """A fact as the full log and the samples hold it."""
    refs = F.transform("entity_refs", lambda r: F.struct(r["type"].alias("Type"), r["value"].alias("Value")))
    millis = F.unix_millis(X.export_time(F.coalesce("time", F.timestamp_seconds(F.lit(0)))))
    names = {"TimeKind": "time_kind", "TimeConfidence": "time_confidence", "Source": "source", "Action": "action", "SourceFile": "source_file", "CollectionStep": "collection_step", "CollectionStatus": "collection_status"}
    more = {"CollectionPrivilege": "collection_privilege", "ParseLevel": "parse_level", "FallbackUsed": "fallback_used", "ParserNote": "parser_note", "Details": "details", "RawRef": "raw_ref"}
    time = F.concat(F.lit("/Date("), millis.cast("string"), F.lit(")/"))
    return F.struct(F.col("fact_id").alias("Id"), time.alias("Time"), *(F.col(c).alias(k) for k, c in (names | more).items()), refs.alias("EntityRefs"))


def _hunts(facts: DataFrame) -> DataFrame:
    """case_id and guided_hunt: each case's matches and hypotheses."""
    m = hunt.evaluate(facts)
    names = F.create_map(*(F.lit(x) for kv in hunt.TECHNIQUES.items() for x in kv))
    rule = F.struct(
        F.col("rule").alias("id"), "severity", F.concat(F.col("matches").cast("string"), F.lit(" matching facts")).alias("summary"), F.col("tactic").alias("attack_tactic"),
        F.col("technique").alias("attack_technique_id"), F.try_element_at(names, F.col("technique")).alias("attack_technique_name"),
        F.col("evidence_ids").alias("fact_ids"), "evidence", F.col("hypothesis").alias("suggested_hypothesis_id"),
    )
    h = F.struct(F.col("hypothesis").alias("id"), "title", "question", "why", F.col("rules").alias("related_rule_ids"), F.col("tags").alias("suggested_tags"))
    rules = m.groupBy("case_id").agg(F.array_sort(F.collect_list(rule)).alias("rule_matches"))
    templates = hunt.hypotheses(m).groupBy("case_id").agg(F.array_sort(F.collect_list(h)).alias("hypothesis_templates"))
    return rules.join(templates, "case_id").select("case_id", F.struct("rule_matches", "hypothesis_templates").alias("guided_hunt"))


def summaries(facts: DataFrame, unknown: str = "(unknown)", most: int = 100, coverage: DataFrame | None = None, evidence: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """A summary_v3 row for each case. Samples are the first `most` facts built.

    evidence: (host, rel, size, sha256) of quality.manifest; coverage: sidecars of tables.COVERAGE, by host; with a column
    case_id either goes by case. cases: of Intake.cases, from which load warnings and the recorded profile come.
    """
    source = F.when(X.blank(F.col("source")), unknown).otherwise(F.col("source"))
    n = facts.groupBy("case_id", "host").agg(F.count("*").alias("fact_count"))
    src = _counted(facts.select("case_id", source.alias("k")), ["case_id"], "fact_source_counts")
    typ = facts.select("case_id", F.explode("entity_refs").alias("r")).where(~X.blank(F.col("r.type"))).select("case_id", F.col("r.type").alias("k"))
    notes = facts.where(F.col("fallback_used") & ~X.blank(F.col("parser_note"))).select("case_id", F.concat_ws(": ", "source", "parser_note").alias("n"))
    notes = notes.groupBy("case_id", F.lower("n").alias("k")).agg(F.min("n").alias("n")).groupBy("case_id").agg(F.array_sort(F.collect_list("n")).alias("parser_notes"))
    first = facts.withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy("fact_ord"))).where(F.col("k") <= most)
    samples = first.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", fact_document().alias("f")))), lambda x: x["f"]).alias("fact_samples"))
    out = n.join(src, "case_id").join(samples, "case_id")
    for more in (_counted(typ, ["case_id"], "entity_type_counts"), notes, _hunts(facts)):
        out = out.join(more, "case_id", "left")
    if coverage is not None:
        by = "case_id" if "case_id" in coverage.columns else "host"
        c = coverage.select(by, F.struct("overall_status", "steps").alias("collection_coverage")).dropDuplicates([by])
        out = out.join(c, by, "left")
    if evidence is not None:
        by = "case_id" if "case_id" in evidence.columns else "host"
        evidence = evidence.withColumn("host", F.col(by))
        files = evidence.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(F.col("rel").alias("relpath"), F.col("size").alias("size_bytes"), "sha256"))).alias("evidence"))
        out = out.join(files.withColumnRenamed("host", by), by, "left").join(quality.digest(evidence).select(F.col("host").alias(by), F.col("digest").alias("evidence_digest")), by, "left")
    head = heading(facts.sparkSession, "summary_v3", analysis_mode="facts_only")
    texts = F.array().cast("array<string>")
    if cases is None:
        out = out.withColumns({"load_warnings": texts, "collection_mode_profile": F.lit("")})
    else:
        out = out.join(cases.select("case_id", "load_warnings", "collection_mode_profile"), "case_id", "left")
    out = out.withColumns({"parser_notes": F.coalesce("parser_notes", texts), "load_warnings": F.coalesce("load_warnings", texts), "collection_mode_profile": F.coalesce("collection_mode_profile", F.lit("")), "artifacts_count": F.size("fact_source_counts"), "mft_count": F.coalesce(F.try_element_at("fact_source_counts", F.lit("MFT")), F.lit(0))})
    return head.crossJoin(out)


def analyse(facts: DataFrame, path: str, **more) -> None:
    """Writes a summary_v3 document for each case, in a folder for each host."""
    store.rows_as_documents(summaries(facts, **more), "host", path)


def _shown(row: DataFrame, **more) -> DataFrame:
    value = {"entity_type": F.col("entity_type"), "value": F.col("display"), "fact_count": F.col("facts"), "host_count": F.col("hosts"), "hosts": F.col("host_list"), "sources": F.col("sources")}
    return row.select(*(c.alias(k) for k, c in (value | more).items()))


def correlate(facts: DataFrame, path: str, types=pivot.TYPES, minutes: int = 30, cases: DataFrame | None = None) -> None:
    """Writes correlation_v1. Shared entities are sorted over all types, temporal ones are not sorted again.

    Totals are counted before the limits, over the written rows of one pass. cases: all cases that were taken in, of
    which those without facts count as skipped.
    """
    e, hosts = model.fact_entities(facts), hosts_of(facts)
    whole = [graph.saved(pivot.shared(e, types, most=None)), graph.saved(pivot.temporal(e, minutes, types, most=None))]
    s = pivot.first_shared(whole[0]).orderBy(F.desc("hosts"), F.desc("facts"), F.lower("display"), "entity_key")
    t = pivot.first_temporal(whole[1]).orderBy("entity_type", "rank")
    head = heading(
        facts.sparkSession, "correlation_v1", host_count=hosts.agg(F.count("*")), **pivot.readiness(facts, cases),
        total_shared_entities=whole[0].agg(F.count("*")), total_temporal_correlations=whole[1].agg(F.count("*")), bucket_minutes=minutes, entity_types=F.array(*map(F.lit, types)),
    )
    spans = {"first_seen": X.iso(F.col("first_seen")), "last_seen": X.iso(F.col("last_seen"))}
    store.document(head, {"hosts": hosts, "shared_entities": _shown(s, **spans), "temporal_correlations": _shown(t, bucket_start=X.iso(F.col("bucket")), bucket_end=X.iso(F.col("bucket_end")))}, path)


def draw(facts: DataFrame, seed: str, path: str, depth: int = 2, fan_out: int = graph.FAN_OUT) -> None:
    """Writes graph_v1."""
    kind, _, value = seed.partition(":")
    hosts = hosts_of(facts)
    n, g = graph.ordered(*graph.expand(model.fact_entities(facts), seed, depth, fan_out))
    head = heading(
        facts.sparkSession, "graph_v1", seed_type=kind, seed_value=value, max_depth=depth, per_hop_fanout=fan_out,
        host_count=hosts.agg(F.count("*")), node_count=n.agg(F.count("*")), edge_count=g.agg(F.count("*")),
    )
    nodes = n.select(F.col("entity_type").alias("type"), F.col("display").alias("value"), "depth", F.col("hosts").alias("host_count"), F.col("host_list").alias("hosts"))
    split, to = model.split_key(F.col("seed")), (F.col("entity_type"), F.col("display"))
    edges = g.select(
        split[0].alias("from_type"), split[1].alias("from_value"), to[0].alias("to_type"), to[1].alias("to_value"), F.col("facts").alias("fact_count"), F.col("hosts").alias("host_count"),
        F.col("host_list").alias("hosts"), "sources", "actions", X.iso(F.col("first_seen")).alias("first_seen"), X.iso(F.col("last_seen")).alias("last_seen"), "depth",
    )
    store.document(head, {"hosts": hosts, "nodes": nodes, "edges": edges}, path)


def full_log(facts: DataFrame, cases: DataFrame, path: str, unknown: str = "Unknown") -> None:
    """Writes full_log_v3: facts in build order with safe times, host summaries, notes and warnings."""
    source = F.when(X.blank(F.col("source")), unknown).otherwise(F.col("source"))
    types = facts.select(F.explode("entity_refs").alias("r")).where(~X.blank(F.col("r.type"))).select(F.col("r.type").alias("k"))
    head = heading(
        facts.sparkSession, "full_log_v3", analysis_mode="facts_only", host_count=cases.agg(F.count("*")), fact_count=facts.agg(F.count("*")),
        fact_source_counts=_counted(facts.select(source.alias("k")), [], "m"), entity_type_counts=_counted(types, [], "m"),
    )
    warnings = quality.warnings(cases.select("host", F.posexplode("load_warnings").alias("place", "warning"))).orderBy("host", "place").select("warning")
    of_sources = quality.notes_by_source(facts, NOTES).select("host", F.explode("notes").alias("note"))
    notes = quality.fallback_notes(facts).unionByName(of_sources.select(F.concat_ws(": ", "host", "note").alias("note")).distinct()).orderBy("note")
    hosts = pivot.host_summaries(facts, cases).orderBy("host").select("host", "case_id", F.col("facts").alias("fact_count"), F.col("by_source").alias("fact_source_counts"), "load_warnings")
    own = facts.orderBy("case_id", "fact_ord").select(fact_document().alias("f")).select("f.*")
    store.document(head, {"load_warnings": warnings, "parser_notes": notes, "hosts": hosts, "facts": own}, path)
