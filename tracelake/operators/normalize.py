"""Normalisers: artifact rows to fact rows. Each is one projection; N07, N09, N17, N18 and N23 explode an array.

A normaliser takes rows with file, host, i (data row from 0) and f (values by name), as
sources.tables gives them, and returns columns of FACTS except fact_ord, which union() sets.
"""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..model import SCHEMA_VERSION, conform
from ..sources.tables import get

# Actions of event ids.
EVENT_ACTIONS = {
    "4624": "LogonSucceeded", "4625": "LogonFailed", "4634": "Logoff", "4647": "UserInitiatedLogoff", "4648": "ExplicitCredentialUsed", "4672": "SpecialPrivilegesAssigned",
    "4688": "ProcessCreated", "4697": "ServiceInstalled", "4698": "ScheduledTaskCreated", "4702": "ScheduledTaskUpdated", "4720": "AccountCreated", "4726": "AccountDeleted",
    "4728": "GroupMemberAdded", "4732": "GroupMemberAdded", "4729": "GroupMemberRemoved", "4733": "GroupMemberRemoved", "4776": "NtlmCredentialValidated", "4778": "SessionReconnected",
    "4779": "SessionDisconnected", "5140": "ShareAccessed", "5142": "ShareCreated", "5143": "ShareModified", "5144": "ShareDeleted", "5145": "ShareAccessChecked", "7045": "ServiceInstalled",
    "4103": "PowerShellCommandInvoked", "4104": "ScriptBlockLogged", "1102": "AuditLogCleared", "1116": "DefenderThreatDetected", "1117": "DefenderThreatAction", "1118": "DefenderThreatAction",
    "5001": "DefenderRealtimeProtectionChanged", "5007": "DefenderConfigurationChanged", "4768": "KerberosTgtRequested", "4769": "KerberosServiceTicketRequested", "1149": "RemoteDesktopAuthenticated",
    "21": "RdpSessionLogon", "24": "RdpSessionDisconnected", "25": "RdpSessionReconnected",
}
LOGON_ACTIONS = {"2": "InteractiveLogonSessionObserved", "3": "NetworkLogonSessionObserved", "10": "RemoteInteractiveSessionObserved", "11": "CachedInteractiveSessionObserved"}
STATES = ("complete", "partial", "failed", "skipped", "missing")
#: Order in which a case's facts are built.
SOURCES = ("Process", "LogonSession", "NetworkResource", "ServerConnection", "StoredCredential", "KerberosTicketCache", "Prefetch", "MemoryAcquisition", "MemoryAnalysis", "Autorun", "Service", "ActivityTimeline", "BAM", "BITS", "JumpList", "WmiPersistence", "Amcache", "ShimCache", "SRUMNetwork", "SRUMApp", "MFT", "ScheduledTask", "USN", "ShellBags", "EventLog")


def zoned(make):
    """A normaliser whose rows may have a column `zone`, the host's time zone (E10); without one it is UTC."""

    @wraps(make)
    def with_zone(rows: DataFrame, *more, **named) -> DataFrame:
        if "zone" not in rows.columns:
            rows = rows.withColumn("zone", F.lit("UTC"))
        return make(rows, *more, **named)

    return with_zone


def clock(c: Column) -> Column:
    """A time in the host's zone, unless it says its own."""
    return X.parse_time(c, F.coalesce(F.nullif(F.trim("zone"), F.lit("")), F.lit("UTC")))


def clocked(r: DataFrame, **times: Column) -> DataFrame:
    """r with times as columns, `_` before their names: each is parsed once a row, however often a fact asks for it."""
    return r.withColumns({f"_{n}": clock(c) for n, c in times.items()})


def refs(*pairs: tuple[str, Column]) -> Column:
    """References of values that are not blank, trimmed."""
    each = F.array(*(F.struct(F.lit(t).alias("type"), F.trim(X.text(v)).alias("value")) for t, v in pairs)).cast("array<struct<type:string,value:string>>")
    return F.filter(each, lambda r: F.length(r["value"]) > 0)


def nonblank(a: Column) -> Column:
    return F.filter(a, lambda r: ~X.blank(r["value"]))


def listed(*pairs: tuple[str, Column]) -> Column:
    """`Name=value` of those that have one."""
    return F.array_join(F.array_compact(F.array(*(F.when(~X.blank(v), F.concat(F.lit(f"{k}="), F.trim(v))) for k, v in pairs))), "; ")


def mapped(c: Column, names: dict[str, str], other: str | Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.trim(c)), other if isinstance(other, Column) else F.lit(other))


def fact(rows: DataFrame, source, action, entities: Column, level: str, time: Column | None = None, kind=None, confidence=None, details=None, note=None, fallback=None, suffix: Column | None = None, order: int = 0, longest: int = 500) -> DataFrame:
    """Fact rows. kind and confidence: (with a usable time, without). note: '' for none; it marks a fallback unless fallback says otherwise."""
    t = time if time is not None else F.lit(None).cast("timestamp")
    has = X.usable(t)
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    kind, confidence, note = kind or ("ObservedTime", "UnknownTime"), confidence or ("Low", "Low"), lit("" if note is None else note)
    name = F.element_at(F.split("file", "/"), -1)
    row_id = F.concat(lit(source), F.lit("_"), suffix if suffix is not None else F.col("i").cast("string"))
    return rows.select(
        F.col("host").alias("case_id"), "host", row_id.alias("fact_id"), F.when(has, t).alias("time"),
        F.when(has, lit(kind[0])).otherwise(lit(kind[1])).alias("time_kind"), F.when(has, lit(confidence[0])).otherwise(lit(confidence[1])).alias("time_confidence"),
        lit(source).alias("source"), lit(action).alias("action"), entities.alias("entity_refs"), name.alias("source_file"), F.lit(level).alias("parse_level"),
        (fallback if fallback is not None else ~X.blank(note)).alias("fallback_used"), note.alias("parser_note"), X.truncate(X.text(details if details is not None else F.lit("")), longest).alias("details"),
        F.concat(name, F.lit(":"), (F.col("i") + 2).cast("string")).alias("raw_ref"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(order).alias("_order"), F.col("i").cast("long").alias("_i"),
    )


def no_time(t: Column, note: str, also: Column | None = None) -> Column:
    """The given note, and this one where there is no usable time."""
    own = also if also is not None else F.lit("")
    return F.when(~X.usable(t) & X.blank(own), note).otherwise(own)


@zoned
def process(r: DataFrame) -> DataFrame:
    r = clocked(r, t=get("StartTime"))
    path, cmd, sha, t = get("Path"), get("CommandLine"), get("SHA256"), F.col("_t")
    note = F.when(X.blank(path) & ~X.blank(cmd), "No executable path in this row; linked by command line, hash and user.").when(~X.usable(t), "No usable start time in this row.").otherwise("")
    e = refs(("Path", path), ("Hash", F.when(~sha.startswith("[") & (F.length(sha) >= 10), sha)), ("User", get("User")), ("CommandLine", cmd))
    return fact(r, "Process", "Executed", e, "Structured", t, ("EventTime", "UnknownTime"), ("High", "Low"), F.when(cmd == "", F.concat(get("Name"), F.lit(" "), path)).otherwise(cmd), note, suffix=get("PID"), order=0)


@zoned
def logon_session(r: DataFrame) -> DataFrame:
    r = clocked(r, start=get("StartTime"), seen=get("ObservedAtUtc"))
    start, seen = F.col("_start"), F.col("_seen")
    t = F.when(X.usable(start), start).otherwise(seen)
    note = F.when(~X.usable(t), "No usable start or observation time in this row.").when(~X.usable(start), "Observation time stands in for the start time.").otherwise("")
    e = refs(("User", get("User")), ("Sid", get("Sid")), ("LogonType", get("LogonType")), ("AuthenticationPackage", get("AuthenticationPackage")), ("LogonProcess", get("LogonProcessName")))
    d = listed(("LogonId", get("LogonId")), ("LogonType", get("LogonTypeName")), ("Domain", get("Domain")), ("AuthPackage", get("AuthenticationPackage")), ("LogonProcess", get("LogonProcessName")), ("ObservedAtUtc", get("ObservedAtUtc")))
    k = F.when(X.usable(start), "EventTime").otherwise("ObservedTime"), F.lit("UnknownTime")
    return fact(r, "LogonSession", mapped(get("LogonType"), LOGON_ACTIONS, "LogonSessionObserved"), e, "Structured", t, k, (F.when(X.usable(start), "High").otherwise("Medium"), F.lit("Low")), d, note, order=1)


@zoned
def network_resource(r: DataFrame) -> DataFrame:
    r = clocked(r, t=get("ObservedAtUtc"))
    t, remote = F.col("_t"), get("RemoteName")
    e = nonblank(F.concat(refs(("User", get("UserName")), ("RemoteName", remote), ("Path", remote), ("Path", get("LocalName"))), X.remote_refs(remote)))
    d = listed(("LocalName", get("LocalName")), ("State", get("ConnectionState")), ("Provider", get("ProviderName")), ("Persistent", get("Persistent")), ("DisplayType", get("DisplayType")), ("Comment", get("Comment")))
    return fact(r, "NetworkResource", "NetworkResourceConnectionObserved", e, "Structured", t, None, ("Medium", "Low"), d, no_time(t, "No observation time in this row."), order=2)


@zoned
def server_connection(r: DataFrame) -> DataFrame:
    r = clocked(r, t=get("ObservedAtUtc"))
    t, peer = F.col("_t"), F.regexp_replace(get("ComputerName"), r"^\\+", "")
    e = refs(("User", get("UserName")), ("ShareName", get("ShareName")), ("RemoteName", peer), ("RemoteIP", F.when(X.is_ipv4(peer), peer)), ("Workstation", F.when(~X.is_ipv4(peer), peer)))
    d = listed(("ConnectionId", get("ConnectionId")), ("ActiveTimeSec", get("ActiveTimeSec")), ("IdleTimeSec", get("IdleTimeSec")), ("NumberOfFiles", get("NumberOfFiles")))
    return fact(r, "ServerConnection", "ServerShareConnectionObserved", e, "Structured", t, None, ("Medium", "Low"), d, no_time(t, "No observation time in this row."), order=3)


@zoned
def stored_credential(b: DataFrame) -> DataFrame:
    """b: sources.tables.credentials()."""
    b = clocked(b, t=F.col("observed"))
    t, target = F.col("_t"), get("target")
    bare = F.regexp_replace(target, r"(?i)^(?:domain|legacygeneric|windowslive|microsoftaccount):(?:target|user)=", "")
    server = F.regexp_extract(F.regexp_replace(bare, r"(?i)^[a-z]+/", ""), r"^\\{0,2}([^\\/:\s]+)", 1)
    is_server = target.rlike(r"(?i)^domain:|termsrv/|^\\\\")
    e = refs(("User", get("user")), ("CredentialTarget", target), ("TargetServer", F.when(is_server, server)), ("Workstation", F.when(is_server & ~X.is_ipv4(server), server)))
    return fact(b.withColumn("i", F.col("block")), "StoredCredential", "StoredCredentialObserved", e, "RawArtifactDerived", t, None, ("Medium", "Low"), listed(("Type", get("type"))), no_time(t, "No observation time in this list."), order=4)


@zoned
def kerberos_ticket(b: DataFrame) -> DataFrame:
    """b: sources.tables.kerberos()."""
    b = clocked(b, start=F.regexp_replace(get("start time"), r"\s*\(local\)$", ""))
    start = F.col("_start")
    b = clocked(b, seen=F.col("observed"))
    seen, server, kdc = F.col("_seen"), get("server"), get("kdc called")
    t = F.when(X.usable(start), start).otherwise(seen)
    target = X.service_host(server)
    peer = lambda c: (("RemoteIP", F.when(X.is_ipv4(c), c)), ("Workstation", F.when(~X.is_ipv4(c), c)))
    e = refs(("User", F.trim(F.substring_index(get("client"), "@", 1))), ("ServiceName", server), ("TargetServer", target), ("RemoteName", target), *peer(target), ("Computer", kdc))
    d = listed(("EndTime", get("end time")), ("RenewTime", get("renew time")), ("Encryption", get("kerbticket encryption type")), ("Flags", get("ticket flags")), ("Kdc", kdc), ("Server", server))
    note = F.when(~X.usable(start) & X.usable(seen), "Observation time stands in for the ticket's start time.").otherwise("")
    k = F.when(X.usable(start), "EventTime").otherwise("ObservedTime"), F.lit("UnknownTime")
    return fact(b.withColumn("i", F.col("block")), "KerberosTicketCache", "KerberosTicketCached", e, "RawArtifactDerived", t, k, (F.when(X.usable(start), "Medium").otherwise("Low"), F.lit("Low")), d, note, order=5)


def prefetch(r: DataFrame) -> DataFrame:
    """Rows with file, host, i, executable, run_times array<timestamp>, referenced array<string>, run_count, note: a fact for each run, else one without time."""
    runs = F.when(F.size(F.coalesce("run_times", F.array().cast("array<timestamp>"))) > 0, F.transform("run_times", lambda t, k: F.struct(t.alias("t"), k.alias("k")))).otherwise(F.array(F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit(-1).alias("k"))))
    x = r.withColumn("run", F.explode(runs))
    up = lambda p: F.upper(p)
    odd = F.slice(F.filter(F.coalesce("referenced", F.array().cast("array<string>")), lambda p: ~X.blank(p) & ~up(p).contains("\\WINDOWS\\") & ~up(p).contains("\\PROGRAM FILES") & (up(p).contains("\\USERS\\") | up(p).contains("\\TEMP\\") | up(p).contains("\\APPDATA\\") | up(p).contains("\\PROGRAMDATA\\"))), 1, 15)
    files = F.when(F.col("run.k") == 0, F.transform(odd, lambda p: F.struct(F.lit("ReferencedFile").alias("type"), p.alias("value")))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
    suffix = F.concat(F.col("i").cast("string"), F.when(F.col("run.k") < 0, "_norun").otherwise(F.concat(F.lit("_run_"), F.col("run.k").cast("string"))))
    d = F.concat(F.when(F.col("run.k") == 0, "Last run. ").when(F.col("run.k") > 0, "Prior run. ").otherwise(""), F.lit("RunCount="), X.text(F.col("run_count")))
    return fact(x, "Prefetch", "Executed", F.concat(refs(("FileName", F.col("executable"))), files), "Structured", F.col("run.t"), ("MetadataTime", "UnknownTime"), ("High", "Low"), d, X.text(F.col("note")), F.col("run.k") < 0, suffix, 6)


@zoned
def memory(r: DataFrame, analysis: bool = False) -> DataFrame:
    """r: a sidecar of acquisition or analysis: a summary fact, then one for each output."""
    name = "MemoryAnalysis" if analysis else "MemoryAcquisition"
    r = clocked(r, end=F.col("EndedAt"), start=F.col("StartedAt"))
    end, start = F.col("_end"), F.col("_start")
    t = F.when(X.usable(end), end).otherwise(start)
    r = r.withColumn("file", F.lit(f"{name}.json")).withColumn("i", F.lit(0).cast("long"))
    state = mapped(F.lower("Status"), {s: name + s.capitalize() for s in STATES}, name + "Observed")
    shared = [("User", F.col("CollectorUser")), ("ToolPath", F.col("ToolPath")), ("DiagnosticCategory", F.col("DiagnosticCategory")), ("ValidationStatus", F.col("ValidationStatus"))]
    own = [("InputPath", F.col("InputRelativePath")), ("Path", F.col("OutputDirectoryRelativePath"))] if analysis else [("Path", F.col("OutputRelativePath")), ("Hash", F.col("OutputSha256"))]
    head = fact(r, name, state, refs(*shared, *own), "Synthesized", t, None, ("High", "Low"), listed(("Status", F.col("Status"))), "From the sidecar's metadata; contents are not parsed.", F.lit(False), F.lit("0"), 8 if analysis else 7)
    if analysis:
        each = r.select("*", F.posexplode(F.filter("OutputFiles", lambda p: ~X.blank(p))).alias("k", "out"))
        e = refs(("Path", F.col("out")), ("InputPath", F.col("InputRelativePath")), ("User", F.col("CollectorUser")))
    else:
        each = r.where(~X.blank(F.col("OutputRelativePath"))).withColumn("k", F.lit(0))
        e = refs(("Path", F.col("OutputRelativePath")), ("Hash", F.col("OutputSha256")), ("User", F.col("CollectorUser")))
    outputs = fact(each, name, name + "OutputObserved", e, "Synthesized", t, None, ("High", "Low"), None, "From the sidecar's metadata; contents are not parsed.", F.lit(False), F.concat(F.lit("output_"), F.col("k").cast("string")), 8 if analysis else 7)
    return head.unionByName(outputs)


def autorun(r: DataFrame) -> DataFrame:
    value = get("Value")
    has = value.contains("\\") | F.lower(F.trim(value)).endswith(".exe")
    key = F.regexp_replace(F.concat_ws("\\", get("Hive"), get("Path"), get("Name")), r"^\\+|\\+$", "")
    note = F.when(has, "").otherwise("No executable path in this value; it is kept in the details.")
    return fact(r.where(~X.blank(value)), "Autorun", "Persist", refs(("RegistryKey", key), ("Path", F.when(has, value))), "RegistryValue", details=value, note=note, order=9)


def service(r: DataFrame) -> DataFrame:
    name, path = get("Name"), get("PathName")
    binary = X.binary_path(path)
    e = refs(("ServiceName", name), ("Path", path), ("Path", F.when(F.lower(binary) != F.lower(F.trim(path)), binary)))
    d = listed(("DisplayName", get("DisplayName")), ("StartMode", get("StartMode")), ("State", get("State")), ("PathName", X.truncate(path, 320)))
    return fact(r.where(~(X.blank(name) & X.blank(path))), "Service", "ServiceConfigurationObserved", e, "Structured", details=d, order=10)


@zoned
def activity(r: DataFrame) -> DataFrame:
    r = clocked(r, t=get("Time"))
    t, source = F.col("_t"), F.when(X.blank(get("Source")), "ActivityTimeline").otherwise(get("Source"))
    from .enrich import time_confidence, time_kind

    return fact(r, source, F.when(get("Action") == "", "Activity").otherwise(get("Action")), refs(("Path", get("Path")), ("User", get("User"))), "Synthesized", t, (time_kind(source, F.lit(True)), F.lit("UnknownTime")), (time_confidence(source, F.lit(True)), F.lit("Low")), get("Details"), no_time(t, "No usable time in this row."), order=11)


@zoned
def bam_dam(r: DataFrame) -> DataFrame:
    r = clocked(r, t=get("LastExecutionTime"))
    t = F.col("_t")
    source = F.when(F.upper(F.trim(get("Source"))) == "DAM", "DAM").otherwise("BAM")
    e = refs(("Path", get("Path")), ("User", get("User")), ("RegistryKey", get("RegistryPath")))
    return fact(r, source, "Executed", e, "RegistryValue", t, ("MetadataTime", "MetadataTime"), ("Medium", "Medium"), X.first_set(get("Details"), get("ValueName")), no_time(t, "No usable execution time in this row."), order=12)


@zoned
def bits(r: DataFrame) -> DataFrame:
    r = clocked(r, changed=get("ModificationTime"), made=get("CreationTime"))
    changed, made, remote = F.col("_changed"), F.col("_made"), get("RemoteName")
    t = F.when(X.usable(changed), changed).otherwise(made)
    each = F.flatten(F.transform(F.split(remote, ";"), lambda s: X.remote_refs(s)))
    e = nonblank(F.concat(refs(("BitsJob", get("DisplayName")), ("User", get("OwnerAccount")), ("RemoteName", remote)), each, refs(("Path", get("LocalName")))))
    return fact(r, "BITS", X.first_set(get("JobState"), F.lit("JobObserved")), e, "Structured", t, None, ("Medium", "Low"), X.first_set(get("Description"), remote), no_time(t, "No usable time in this row."), order=13)


@zoned
def jump_list(r: DataFrame) -> DataFrame:
    r = clocked(r, t=get("Time"))
    t, path = F.col("_t"), get("Path")
    empty = X.blank(path) & X.blank(get("AppId")) & X.blank(get("User")) & X.blank(get("Source")) & X.blank(get("Details"))
    e = nonblank(F.concat(refs(("Path", path)), X.remote_refs(F.when(path.startswith("\\\\"), path)), refs(("User", get("User")), ("AppId", get("AppId")))))
    return fact(r.where(~empty), "JumpList", "JumpListDestinationObserved", e, "Structured", t, ("EventTime", "UnknownTime"), ("Medium", "Low"), F.concat_ws("; ", F.nullif(get("Source"), F.lit("")), F.nullif(get("Details"), F.lit(""))), no_time(t, "No usable time in this row."), order=14)


def wmi(r: DataFrame) -> DataFrame:
    kind = F.lower(get("Class"))
    action = F.when(kind.contains("binding"), "WmiBindingObserved").when(kind.contains("filter"), "WmiFilterObserved").when(kind.contains("consumer"), "WmiConsumerObserved").otherwise("WmiObjectObserved")
    e = refs(("WmiClass", get("Class")), ("WmiFilter", get("Filter")), ("WmiConsumer", get("Consumer")), ("TaskName", get("Name")), ("Query", get("Query")), ("Path", get("Path")))
    return fact(r, "WmiPersistence", action, e, "Structured", details=get("Details"), order=15)


@zoned
def amcache_programs(r: DataFrame) -> DataFrame:
    """Rows with nothing but a note give one fact for each distinct note of a file."""
    r = clocked(r, t=get("InstallDate"))
    t, note = F.col("_t"), get("ParserNote")
    names = ("ProgramName", "Publisher", "ProductName", "ProgramId")
    empty = reduce(lambda a, b: a & b, [X.blank(get(n)) for n in names])
    e = refs(("Publisher", get("Publisher")), ("ProductName", get("ProductName")), ("ProgramName", get("ProgramName")), ("ProgramId", get("ProgramId")))
    d = listed(*((n, get(n)) for n in ("ProgramName", "Publisher", "Version", "ProductName", "ProgramId")))
    has = fact(r.where(~empty), "Amcache", F.when(X.usable(t), "Installed").otherwise("FirstObserved"), e, "RegistryValue", t, ("MetadataTime", "UnknownTime"), ("Medium", "Low"), d, note, ~X.usable(t) | ~X.blank(note), F.concat(F.lit("program_"), F.col("i").cast("string")), 16)
    notes = r.where(empty & ~X.blank(note)).groupBy("file", "host", F.lower(note).alias("n")).agg(F.min("i").alias("i"), F.min_by("f", "i").alias("f"))
    return has.unionByName(fact(notes, "Amcache", "ParseNoteObserved", refs(), "RawArtifactDerived", details=note, note=note, suffix=F.concat(F.lit("note_"), F.col("i").cast("string")), order=16))


@zoned
def amcache_files(r: DataFrame) -> DataFrame:
    r = clocked(r, done=get("ExecutedTime"), seen=get("FirstObservedTime"))
    done, seen, note = F.col("_done"), F.col("_seen"), get("ParserNote")
    one = lambda cond, a, t: F.when(cond, F.struct(F.lit(a).alias("a"), t.alias("t")))
    none = F.lit(None).cast("timestamp")
    each = F.array_compact(F.array(one(X.usable(done), "Executed", done), one(X.usable(seen), "FirstObserved", seen), one(~X.usable(done) & ~X.usable(seen), "FirstObserved", none)))
    empty = reduce(lambda a, b: a & b, [X.blank(get(n)) for n in ("Path", "FileName", "Hash", "ProductName", "Publisher", "ProgramId")])
    x = r.where(~empty).withColumn("x", F.explode(each))
    e = refs(("Path", get("Path")), ("FileName", get("FileName")), ("Hash", get("Hash")), ("Publisher", get("Publisher")), ("ProductName", get("ProductName")), ("ProgramId", get("ProgramId")))
    d = listed(*((n, get(n)) for n in ("Path", "FileName", "Hash", "ProductName", "Publisher", "ProgramId")))
    full = no_time(F.col("x.t"), "No stable time for execution or first sight in this row.", note)
    return fact(x, "Amcache", F.col("x.a"), e, "RegistryValue", F.col("x.t"), ("MetadataTime", "UnknownTime"), ("Medium", "Low"), d, full, suffix=F.concat(F.lit("file_"), F.col("x.a"), F.lit("_"), F.col("i").cast("string")), order=16)


@zoned
def shimcache(r: DataFrame) -> DataFrame:
    r = clocked(r, t=get("LastModifiedTime"))
    t, note = F.col("_t"), get("ParserNote")
    r = r.where(~(X.blank(get("Path")) & X.blank(get("FileName"))))
    return fact(r, "ShimCache", "ExecutedCandidate", refs(("Path", get("Path")), ("FileName", get("FileName"))), "RawArtifactDerived", t, ("MetadataTime", "UnknownTime"), ("Low", "Low"), F.concat(F.lit("ValueName="), get("ValueName"), F.lit("; DataHashPrefix="), get("DataHashPrefix")), note, ~X.usable(t) | ~X.blank(note), order=17)


@zoned
def srum(r: DataFrame, app: bool = False) -> DataFrame:
    r = clocked(r, t=get("Timestamp"))
    t, note = F.col("_t"), get("ParserNote")
    e = [("AppId", get("AppId")), ("Path", get("Path")), ("User", get("User"))]
    r = r.where(~(X.blank(get("AppId")) & X.blank(get("Path")) & X.blank(get("User"))))
    how = ("EventTime", "UnknownTime"), ("Medium", "Low")
    if app:
        return fact(r, "SRUMApp", "AppResourceUsageObserved", refs(*e), "Structured", t, *how, F.concat(F.lit("ForegroundCycleTime="), get("ForegroundCycleTime"), F.lit("; BackgroundCycleTime="), get("BackgroundCycleTime")), note, ~X.usable(t) | ~X.blank(note), order=19)
    return fact(r, "SRUMNetwork", "NetworkUsageObserved", refs(*e, ("RemoteIP", get("RemoteIP")), ("Interface", get("Interface"))), "Structured", t, *how, F.concat(F.lit("BytesSent="), get("BytesSent"), F.lit("; BytesReceived="), get("BytesReceived")), note, ~X.usable(t) | ~X.blank(note), order=18)


def mft(r: DataFrame) -> DataFrame:
    """r: sources.tables.mft()."""
    changed = F.when(X.usable_event(F.col("std_modified")), F.col("std_modified")).otherwise(F.col("fn_modified"))
    made = X.usable_event(F.col("created"))
    t = F.when(made, F.col("created")).otherwise(changed)
    r = r.where(~X.blank(F.col("full_path")) & X.usable_event(t))
    d = F.concat("full_path", F.when(F.col("size") > 0, F.concat(F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes)"))).otherwise(""))
    note = F.when(made, "").otherwise("No creation time; another metadata time stands in.")
    return fact(r, "MFT", F.when(made, "Created").otherwise("Modified"), refs(("Path", F.col("full_path"))), "MetadataDerived", t, ("MetadataTime", "MetadataTime"), ("Medium", "Medium"), d, note, suffix=F.col("record"), order=20)


def scheduled_task(a: DataFrame) -> DataFrame:
    """a: sources.tables.task_actions()."""
    note = F.when(X.blank(F.col("uri")), "No task URI; linked by command path and user only.").otherwise("")
    a = a.where(~X.blank(F.col("command"))).withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("task", "exec")) - 1)
    return fact(a, "ScheduledTask", "Scheduled", refs(("Path", F.col("command")), ("TaskName", F.col("uri")), ("User", F.col("run_as"))), "StructuredXml", details=X.truncate(F.col("arguments"), 300), note=note, order=21)


@zoned
def usn(r: DataFrame) -> DataFrame:
    """r: sources.tables.table_after_preamble()."""
    r = clocked(r, t=get("time stamp", "timestamp", "time"))
    t = F.col("_t")
    path, name, reason = get("full path", "path"), get("file name", "filename"), get("reason")
    ref, parent = get("file id", "file reference number", "file ref#"), get("parent file id", "parent file reference number", "parent file ref#")
    e = refs(("Path", path), ("FileName", name), ("UsnReason", reason), ("FileReference", ref))
    d = listed(("Path", path), ("FileName", name), ("Reason", reason), ("Attributes", get("file attributes")), ("FileRef", ref), ("ParentRef", parent))
    note = F.when(X.blank(path), "No full path in this row; linked by file name.").otherwise("")
    return fact(r.where(~(X.blank(name) & X.blank(path))), "USN", X.usn_action(reason), e, "MetadataDerived", t, ("EventTime", "UnknownTime"), ("High", "Low"), d, note, order=22)


@zoned
def shell_bags(r: DataFrame) -> DataFrame:
    r = clocked(r, t=get("LastWriteTime"))
    t, note = F.col("_t"), get("ParserNote")
    d = listed(("BagPath", get("BagPath")), ("RegistryKey", get("RegistryKey")), ("ValueName", get("ValueName")), ("MruSlot", get("MruSlot")), ("SourceFile", get("SourceFile")))
    return fact(r, "ShellBags", "FolderBrowsed", refs(("Path", get("DecodedPath")), ("User", get("User")), ("Sid", get("Sid"))), "Structured", t, ("ObservedTime", "ObservedTime"), ("Low", "Low"), d, no_time(t, "No usable last-write time in this row.", note), ~X.usable(t) | ~X.blank(note), order=23)


def event_action(event_id: Column, provider: Column, data: Column) -> Column:
    p, e = F.lower(provider), F.trim(event_id)
    threat = X.lookup(data, "Threat Name", "ThreatName", "Name")
    family = (
        F.when(p.contains("windows defender"), F.when(X.blank(threat), "DefenderEvent").otherwise("DefenderThreatEvent"))
        .when(p.contains("terminalservices") | p.contains("remotedesktop"), "RdpEvent").when(p.contains("smb"), "SmbEvent")
        .when(e == "", "Event").otherwise(F.concat(F.lit("EventId "), e))
    )
    return mapped(e, EVENT_ACTIONS, family)


@zoned
def event_log(r: DataFrame) -> DataFrame:
    """r: sources.tables.event_logs(). A blank time keeps the fact and its references."""
    # Each value is cleaned once, in the map: blank ones go, placeholders become ''. A lookup is then a plain coalesce.
    clean = lambda k, v: X.let(X.single_line(v), lambda s: F.when(s.isin(*X.PLACEHOLDERS), "").otherwise(s))
    x = r.withColumns({"raw": X.pairs(get("EventData")), "eid": F.trim(get("EventId")), "message": get("Message")})
    x = x.withColumn("raw", F.map_filter("raw", lambda k, v: v != ""))
    x = x.withColumns({"d": F.transform_values("raw", clean), "path": X.path_in(F.col("message"))})
    wanted = {"share_local": ("ShareLocalPath",), "relative": ("RelativeTargetName",), "user": ("User", "UserName"), "param1": ("Param1",), "param3": ("Param3",)}
    raw, eid, path = F.col("raw"), F.col("eid"), F.col("path")
    v = lambda *names: F.coalesce(*(F.try_element_at("d", X.plain_key(F.lit(n))) for n in names), F.lit(""))
    x = x.withColumns({k: v(*n) for k, n in wanted.items()})
    at = lambda ids, c: F.when(eid.isin(*ids), c).otherwise("")
    who = lambda side: X.account(v(f"{side}DomainName"), v(f"{side}UserName", *(("TargetUser",) if side == "Target" else ())))
    local, rel = F.regexp_replace("share_local", r"[\\/]+$", ""), F.regexp_replace("relative", r"^[\\/]+", "")
    own_user, param1 = F.col("user"), F.col("param1")
    rdp_user = X.first_set(own_user, v("Param2", "Param1"))
    from_params = F.when(X.blank(param1) | (F.lower(param1) == F.lower(rdp_user)), F.col("param3")).otherwise(param1)
    rdp_domain = F.when(X.blank(own_user), from_params).otherwise(v("Domain", "DomainName"))
    rdp = X.account(rdp_domain, rdp_user)
    general = [
        ("Provider", X.placeholder(get("ProviderName"))), ("EventId", X.placeholder(eid)), ("Level", X.placeholder(get("LevelDisplayName"))), ("Computer", X.placeholder(get("Computer"))),
        ("UserSid", X.placeholder(get("UserId"))), ("TaskDisplay", X.placeholder(get("TaskDisplayName"))),
        ("User", v("TargetUserName", "AccountName", "User", "SubjectUserName")), ("User", v("SubjectUserName")), ("User", v("UserName", "SamAccountName", "MemberName")), ("User", v("ServiceStartName", "StartAccount")),
        ("RemoteIP", v("IpAddress", "ClientAddress", "SourceAddress", "RemoteAddress")), ("RemotePort", v("IpPort", "SourcePort", "Port")), ("LogonType", v("LogonType")), ("LogonProcess", v("LogonProcessName")),
        ("AuthenticationPackage", v("AuthenticationPackageName")), ("Workstation", v("WorkstationName", "ClientName")), ("ServiceName", v("ServiceName")), ("TaskName", v("TaskName", "Task")),
        ("GroupName", v("GroupName", "TargetSid")), ("ThreatName", v("Threat Name", "ThreatName", "Name")), ("CommandLine", v("CommandLine", "ProcessCommandLine")), ("ProcessId", v("ProcessId", "NewProcessId")),
        ("ShareName", v("ShareName")), ("ShareLocalPath", v("ShareLocalPath")), ("RuleName", v("RuleName")), ("TargetServer", v("TargetServerName", "ServerName", "Destination")), ("ParentPath", v("ParentProcessName")),
        ("Path", v("NewProcessName", "ProcessName", "Image", "Application", "ProcessPath")), ("Path", v("ImagePath", "ServiceFileName", "FilePath", "TargetFilename", "Path")),
        ("Path", v("ParentProcessName", "ScriptPath", "ObjectName")), ("Path", path),
    ]
    own = [
        ("SubjectUser", at(("4624", "4625", "4648", "4672", "5140", "5145", "4688", "4697", "4698", "4702"), who("Subject"))), ("TargetUser", at(("4624", "4625", "4648", "4768", "4769"), who("Target"))),
        ("RemoteIP", at(("4624", "4625", "5140", "5145"), v("IpAddress", "ClientAddress"))), ("TargetServer", at(("4648",), v("TargetServerName", "TargetInfo"))), ("Path", at(("4648",), v("ProcessName"))),
        ("ProcessId", at(("4648",), v("ProcessId"))), ("ServiceName", at(("4768", "4769", "4697", "7045"), v("ServiceName"))), ("User", at(("4776",), v("AccountName", "UserName"))),
        ("Workstation", at(("4776",), v("Workstation"))), ("ShareName", at(("5140", "5145"), v("ShareName"))), ("ShareLocalPath", at(("5140", "5145"), v("ShareLocalPath"))),
        ("Path", at(("5145",), v("RelativeTargetName"))), ("Path", at(("5145",), F.when(~X.blank(local) & ~X.blank(rel), F.concat(local, F.lit("\\"), rel)))), ("RemotePort", at(("5145",), v("IpPort", "Port"))),
        ("TargetUser", at(("1149",), rdp)), ("RemoteIP", at(("1149",), v("ClientAddress", "ClientIP", "IpAddress", "NASIdentifier", "SourceIp"))),
        ("TargetUser", at(("1149",), F.when(X.blank(rdp), X.account_in(F.col("message"))))), ("Path", at(("4697",), v("ServiceFileName"))),
        ("User", at(("4697",), v("ServiceStartName", "AccountName"))), ("Path", at(("7045",), v("ImagePath", "ServiceFileName"))), ("User", at(("7045",), v("AccountName", "StartName"))), ("TaskName", at(("4698", "4702"), v("TaskName", "Name"))),
    ]
    x = clocked(x, t=get("TimeCreated"))
    t = F.col("_t")
    has_data, has_path = ~X.blank(get("EventData")), ~X.blank(path)
    base = F.when(~has_data & has_path, "No structured data; a path comes from the message.").when(~has_data, "No structured data; from the event's columns only.").when(has_path, "A further path comes from the message.").otherwise("")
    more = F.when(eid.isin("4768", "4769"), F.concat(F.lit("Kerberos:"), F.nullif(v("TicketOptions", "TicketEncryptionType", "Status", "ResultCode"), F.lit("")))).when(eid == "4776", F.concat(F.lit("ValidationStatus:"), F.nullif(v("Status", "ErrorCode"), F.lit("")))).when(eid.isin("4698", "4702") & ~X.blank(X.lookup(raw, "TaskContent")), "ScheduledTaskXmlPresent")
    untimed = F.when(~X.usable_event(t), "No usable time in this event.")
    note = F.concat_ws(" | ", F.nullif(base, F.lit("")), more, untimed)
    message, data = X.single_line(F.col("message")), X.single_line(get("EventData"))
    text = F.when(X.blank(data), message).when(X.blank(message), data).otherwise(F.concat(message, F.lit(" | Data: "), data))
    # References are built in a select of their own, so that generated code stays small.
    x = x.withColumns({"e1": refs(*general), "note": note, "fb": ~X.blank(base) | untimed.isNotNull()}).withColumn("e2", refs(*own))
    out = fact(x, F.concat(F.lit("EventLog:"), F.col("label")), event_action(eid, get("ProviderName"), raw), F.concat("e1", "e2"), "Structured", t, ("EventTime", "UnknownTime"), ("High", "Low"), text, F.col("note"), F.col("fb"), F.concat(F.col("label"), F.lit("_"), F.col("i").cast("string")), 24, 900)
    out = out.withColumn("fact_id", F.regexp_replace("fact_id", "^EventLog:[^_]*_", "EventLog_"))
    return out


def union(parts: list[DataFrame]) -> DataFrame:
    """All facts in build order: sources as given, then rows. fact_ord counts within a case.

    A case may hold most of the rows: places come from running counts over blocks of rows, plus the place in the block.
    """
    u = reduce(DataFrame.unionByName, parts).withColumn("_block", F.floor(F.col("_i") / 65_536))
    block = ["case_id", "_order", "source_file", "_block"]
    before = Window.partitionBy("case_id").orderBy(*block[1:]).rowsBetween(Window.unboundedPreceding, -1)
    base = u.groupBy(block).agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = u.withColumn("_k", F.row_number().over(Window.partitionBy(block).orderBy("_i", "fact_id")))
    return conform(own.join(base, block).withColumn("fact_ord", F.col("_base") + F.col("_k") - 1))
