"""Registered queries that hold every column of facts, with where they come from, over rows that vary: blank and odd times, blank values, notes, all event ids.

As in evidence_queries each row of events becomes a row of the artifact. Its time text is one of six by the event's
number: plain, blank, a placeholder, with a zone, padded, and too early to be used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import demo
from .evidence_queries import _E, events, rows, said
from .functions import expr as X
from .operators import normalize

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The events, with has: whether the row's time can be used, and again: whether its second time can.
_V = f"{_E}, v AS (SELECT *, i % 6 IN (0, 3, 4) AS has, i % 4 = 0 AS again FROM e)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def record(source: str, action: str, entities: list[tuple[str, str]], file: str, level: str, kinds: tuple[str, str], confidences: tuple[str, str], note: str, details: str, fact_id: str | None = None, fallback: str | None = None, time: str = "CASE WHEN has THEN tm END", where: str = "true", timed: str = "has") -> str:
    """SQL of the facts of v; entities are left out where their SQL text is blank or null. kinds and confidences: SQL with a usable time, and without."""
    named = ", ".join(f"CASE WHEN trim({v}) <> '' THEN '{k}=' || trim({v}) END" for k, v in entities) or "NULL"
    told = lambda two: f"CASE WHEN {timed} THEN {two[0]} ELSE {two[1]} END"
    return f"""SELECT {fact_id or f"{source} || '_' || i"} AS fact_id, h AS host, {source} AS source, {action} AS action, concat_ws(' | ', {named}) AS entities, {told(kinds)} AS time_kind, {told(confidences)} AS time_confidence, {time} AS time,
'{file}' AS source_file, '{level}' AS parse_level, {fallback or f"({note}) <> ''"} AS fallback_used, {note} AS parser_note, '{file}:' || (i + 2) AS raw_ref, {details} AS details FROM v WHERE {where}"""


def whole(parts: list[DataFrame]) -> DataFrame:
    """Facts with all their columns, references and times as text."""
    one = reduce(DataFrame.unionByName, parts)
    named, time = X.summary(F.col("entity_refs"), 50).alias("entities"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time")
    return one.select("fact_id", "host", "source", "action", named, "time_kind", "time_confidence", time, "source_file", "parse_level", "fallback_used", "parser_note", "raw_ref", "details")


def odd_time() -> Column:
    """The row's time as one of six texts, of which the first, fourth and fifth can be used."""
    n = F.col("i") % 6
    text = F.when(n == 0, F.col("at")).when(n == 1, "").when(n == 2, "n/a").when(n == 3, F.concat(F.replace("at", F.lit(" "), F.lit("T")), F.lit("Z")))
    return text.when(n == 4, said("  ", "$at", " ")).otherwise("1979-05-05 01:02:03")


def second_time() -> Column:
    return F.when(F.col("i") % 4 == 0, F.col("at")).otherwise("")


def unless(kind: str, c: Column, other: str = "  ") -> Column:
    """c, but for events of one type a blank."""
    return F.when(F.col("t") == kind, other).otherwise(c)


_ERR = "t <> 'error'"
_UNSEEN = "CASE WHEN has THEN '' ELSE 'No observation time in this row.' END"
_ODD = "CASE WHEN t = 'view' THEN 'odd' ELSE '' END"
_SEEN = ("'ObservedTime'", "'UnknownTime'")
_SHARE = r"CASE WHEN t <> 'error' THEN '\\srv' || k || '\data' END"


def _note() -> Column:
    return F.when(F.col("t") == "view", "odd").otherwise("")


@query(_V + " " + " UNION ALL ".join((
    record("'NetworkResource'", "'NetworkResourceConnectionObserved'", [("User", "'u' || u"), ("RemoteName", _SHARE), ("Path", _SHARE), ("Path", "CASE WHEN t <> 'view' THEN 'Z:' END"), ("Workstation", f"CASE WHEN {_ERR} THEN 'srv' || k END"), ("ShareName", f"CASE WHEN {_ERR} THEN 'data' END")],
           "network_resources.csv", "Structured", _SEEN, ("'Medium'", "'Low'"), _UNSEEN, "CASE WHEN t <> 'view' THEN 'LocalName=Z:; ' ELSE '' END || 'State=' || t"),
    record("'ServerConnection'", "'ServerShareConnectionObserved'", [("User", "'u' || u"), ("ShareName", f"CASE WHEN {_ERR} THEN 'data' END"), ("RemoteName", "CASE WHEN i % 2 = 1 THEN 'pc' ELSE '10.0.0.' END || k"), ("RemoteIP", "CASE WHEN i % 2 = 0 THEN '10.0.0.' || k END"), ("Workstation", "CASE WHEN i % 2 = 1 THEN 'pc' || k END")],
           "server_connections.csv", "Structured", _SEEN, ("'Medium'", "'Low'"), _UNSEEN, "'ConnectionId=' || i"),
    record("'BITS'", "CASE WHEN t = 'error' THEN 'JobObserved' ELSE t END", [("BitsJob", "'j' || k"), ("RemoteName", "'http://10.0.0.' || k || '/f'"), ("RemoteIP", "'10.0.0.' || k"), ("Path", r"CASE WHEN t <> 'view' THEN 'C:\f' END")],
           "bits_jobs.csv", "Structured", _SEEN, ("'Medium'", "'Low'"), "CASE WHEN has OR again THEN '' ELSE 'No usable time in this row.' END", "CASE WHEN t = 'signup' THEN 'told' ELSE 'http://10.0.0.' || k || '/f' END", time="CASE WHEN has OR again THEN tm END", timed="has OR again"),
    record("'LogonSession'", "CASE t WHEN 'click' THEN 'RemoteInteractiveSessionObserved' WHEN 'view' THEN 'NetworkLogonSessionObserved' WHEN 'error' THEN 'LogonSessionObserved' WHEN 'signup' THEN 'CachedInteractiveSessionObserved' ELSE 'InteractiveLogonSessionObserved' END",
           [("User", "'u' || u"), ("LogonType", "CASE t WHEN 'click' THEN '10' WHEN 'view' THEN '3' WHEN 'error' THEN '7' WHEN 'signup' THEN '11' ELSE '2' END"), ("AuthenticationPackage", f"CASE WHEN {_ERR} THEN 'NTLM' END")], "logon_sessions.csv", "Structured",
           ("'EventTime'", "CASE WHEN again THEN 'ObservedTime' ELSE 'UnknownTime' END"), ("'High'", "CASE WHEN again THEN 'Medium' ELSE 'Low' END"), "CASE WHEN has THEN '' WHEN again THEN 'Observation time stands in for the start time.' ELSE 'No usable start or observation time in this row.' END",
           f"concat_ws('; ', 'LogonId=' || k, CASE WHEN {_ERR} THEN 'AuthPackage=NTLM' END, CASE WHEN again THEN 'ObservedAtUtc=' || tm END)", time="CASE WHEN has OR again THEN tm END"),
    record("'JumpList'", "'JumpListDestinationObserved'", [("Path", r"'C:\' || k"), ("User", "CASE WHEN t <> 'view' THEN 'u' || u END"), ("AppId", "'app'")], "jump_lists.csv", "Structured", ("'EventTime'", "'UnknownTime'"), ("'Medium'", "'Low'"), "CASE WHEN has THEN '' ELSE 'No usable time in this row.' END", "''", where=_ERR),
)))
def records_of_sessions(spark, sf_dir):
    """All columns, odd times and blanks"""
    of = lambda name, **values: rows(spark, sf_dir, name, **values)
    type_id = F.when(F.col("t") == "click", "10").when(F.col("t") == "view", "3").when(F.col("t") == "error", "7").when(F.col("t") == "signup", "11").otherwise("2")
    peer = F.when(F.col("i") % 2 == 1, said("\\\\pc", "$k")).otherwise(said("10.0.0.", "$k"))
    return whole([
        normalize.network_resource(of("network_resources.csv", ObservedAtUtc=odd_time(), LocalName=unless("view", F.lit("Z:")), RemoteName=unless("error", said("\\\\srv", "$k", "\\data")), UserName=said("u", "$u"), ConnectionState=said("$t"))),
        normalize.server_connection(of("server_connections.csv", ObservedAtUtc=odd_time(), ComputerName=peer, UserName=said(" u", "$u"), ShareName=unless("error", F.lit("data")), ConnectionId=said("$i"))),
        normalize.bits(of("bits_jobs.csv", DisplayName=said("j", "$k"), JobState=unless("error", said("$t")), ModificationTime=odd_time(), CreationTime=second_time(), RemoteName=said("http://10.0.0.", "$k", "/f"), LocalName=unless("view", F.lit("C:\\f")), Description=F.when(F.col("t") == "signup", "told").otherwise(" "))),
        normalize.logon_session(of("logon_sessions.csv", StartTime=odd_time(), ObservedAtUtc=second_time(), LogonId=said("$k"), User=said("u", "$u"), Sid=F.lit(" "), LogonType=type_id, AuthenticationPackage=unless("error", F.lit("NTLM")))),
        normalize.jump_list(of("jump_lists.csv", Time=odd_time(), Path=unless("error", said("C:\\", "$k")), User=unless("view", unless("error", said("u", "$u"))), AppId=unless("error", F.lit("app")))),
    ])


_META = ("'MetadataTime'", "'UnknownTime'")
_CMD = "CASE WHEN t <> 'view' THEN 'run ' || k END"
_EXE = r"CASE WHEN t <> 'error' THEN 'C:\x\' || k || '.exe' END"


@query(_V + " " + " UNION ALL ".join((
    record("'Process'", "'Executed'", [("Path", _EXE), ("Hash", "CASE WHEN i % 2 = 1 THEN md5(k) END"), ("User", "'u' || u"), ("CommandLine", _CMD)], "process_list.csv", "Structured", ("'EventTime'", "'UnknownTime'"), ("'High'", "'Low'"),
           "CASE WHEN t = 'error' THEN 'No executable path in this row; linked by command line, hash and user.' WHEN has THEN '' ELSE 'No usable start time in this row.' END", r"CASE WHEN t = 'view' THEN 'p' || k || ' C:\x\' || k || '.exe' ELSE 'run ' || k END"),
    record("CASE WHEN t = 'view' THEN 'DAM' ELSE 'BAM' END", "'Executed'", [("Path", _EXE), ("User", "'u' || u"), ("RegistryKey", r"'\REG'")], "bam_dam.csv", "RegistryValue", ("'MetadataTime'",) * 2, ("'Medium'",) * 2, "CASE WHEN has THEN '' ELSE 'No usable execution time in this row.' END", "CASE WHEN t = 'error' THEN 'v' ELSE 'd' END || k"),
    record("'ShimCache'", "'ExecutedCandidate'", [("Path", _EXE), ("FileName", "k || '.exe'")], "shimcache_entries.csv", "RawArtifactDerived", _META, ("'Low'",) * 2, _ODD, "'ValueName=v; DataHashPrefix=' || u", fallback="NOT has OR t = 'view'", where=_ERR),
    record("'Amcache'", "CASE WHEN has THEN 'Executed' ELSE 'FirstObserved' END", [("Path", _EXE), ("Hash", "'h' || u")], "amcache_files.csv", "RegistryValue", _META, ("'Medium'", "'Low'"), "CASE WHEN t = 'view' THEN 'odd' WHEN has THEN '' ELSE 'No stable time for execution or first sight in this row.' END",
           r"'Path=C:\x\' || k || '.exe; Hash=h' || u", fact_id="'Amcache_file_' || CASE WHEN has THEN 'Executed_' ELSE 'FirstObserved_' END || i", where=_ERR),
    record("'SRUMNetwork'", "'NetworkUsageObserved'", [("AppId", "'a' || k"), ("User", "CASE WHEN t <> 'view' THEN 'u' || u END"), ("RemoteIP", "CASE WHEN t <> 'signup' THEN '10.0.0.' || k END")], "srum_network_usage.csv", "Structured", ("'EventTime'", "'UnknownTime'"), ("'Medium'", "'Low'"), _ODD, "'BytesSent=' || k || '; BytesReceived='", fallback="NOT has OR t = 'view'", where=_ERR),
    record("'USN'", "CASE WHEN t = 'signup' THEN 'Deleted' ELSE 'Created' END", [("Path", _EXE), ("FileName", "k || '.exe'"), ("UsnReason", "CASE WHEN t = 'signup' THEN 'FILE_DELETE' ELSE 'FILE_CREATE' END")], "usn_journal.csv", "MetadataDerived", ("'EventTime'", "'UnknownTime'"), ("'High'", "'Low'"), "CASE WHEN t = 'error' THEN 'No full path in this row; linked by file name.' ELSE '' END",
           r"CASE WHEN t <> 'error' THEN 'Path=C:\x\' || k || '.exe; ' ELSE '' END || 'FileName=' || k || '.exe; Reason=' || CASE WHEN t = 'signup' THEN 'FILE_DELETE' ELSE 'FILE_CREATE' END"),
    record("'ShellBags'", "'FolderBrowsed'", [("Path", _EXE), ("User", "'u' || u")], "shellbags.csv", "Structured", ("'ObservedTime'",) * 2, ("'Low'",) * 2, "CASE WHEN t = 'view' THEN 'odd' WHEN has THEN '' ELSE 'No usable last-write time in this row.' END", "'BagPath=b'", fallback="NOT has OR t = 'view'"),
)))
def records_of_programs(spark, sf_dir):
    """All columns, odd times, blanks and notes"""
    of = lambda name, **values: rows(spark, sf_dir, name, **values)
    exe, name, user = unless("error", said("C:\\x\\", "$k", ".exe")), said("$k", ".exe"), said("u", "$u")
    sha = F.when(F.col("i") % 2 == 1, F.md5(F.col("k").cast("binary"))).otherwise("[none]")
    reason = F.when(F.col("t") == "signup", "FILE_DELETE").otherwise("FILE_CREATE")
    return whole([
        normalize.process(of("process_list.csv", PID=said("$i"), Name=said("p", "$k"), Path=unless("error", said("C:\\x\\", "$k", ".exe"), ""), CommandLine=unless("view", said("run ", "$k"), ""), StartTime=odd_time(), User=user, SHA256=sha)),
        normalize.bam_dam(of("bam_dam.csv", Source=F.when(F.col("t") == "view", " dam ").otherwise("x"), User=user, RegistryPath=F.lit("\\REG"), ValueName=said("v", "$k"), Details=unless("error", said("d", "$k")), Path=exe, LastExecutionTime=odd_time())),
        normalize.shimcache(of("shimcache_entries.csv", Path=exe, FileName=unless("error", name), LastModifiedTime=odd_time(), ValueName=F.lit("v"), DataHashPrefix=said("$u"), ParserNote=_note())),
        normalize.amcache_files(of("amcache_files.csv", Path=exe, Hash=unless("error", said("h", "$u")), ExecutedTime=odd_time(), FirstObservedTime=F.lit("0"), ParserNote=_note())),
        normalize.srum(of("srum_network_usage.csv", Timestamp=odd_time(), AppId=unless("error", said("a", "$k")), User=unless("view", unless("error", user)), RemoteIP=unless("signup", said("10.0.0.", "$k")), BytesSent=said("$k"), ParserNote=_note())),
        normalize.usn(of("usn_journal.csv", **{"timestamp": odd_time(), "path": exe, "filename": name, "reason": reason})),
        normalize.shell_bags(of("shellbags.csv", User=user, BagPath=F.lit("b"), DecodedPath=exe, LastWriteTime=odd_time(), ParserNote=_note())),
    ])


# Actions of event ids, as the SQL holds them.
_ACTIONS = """4624 LogonSucceeded 4625 LogonFailed 4634 Logoff 4647 UserInitiatedLogoff 4648 ExplicitCredentialUsed 4672 SpecialPrivilegesAssigned 4688 ProcessCreated 4697 ServiceInstalled
4698 ScheduledTaskCreated 4702 ScheduledTaskUpdated 4720 AccountCreated 4726 AccountDeleted 4728 GroupMemberAdded 4732 GroupMemberAdded 4729 GroupMemberRemoved 4733 GroupMemberRemoved
4776 NtlmCredentialValidated 4778 SessionReconnected 4779 SessionDisconnected 5140 ShareAccessed 5142 ShareCreated 5143 ShareModified 5144 ShareDeleted 5145 ShareAccessChecked 7045 ServiceInstalled
4103 PowerShellCommandInvoked 4104 ScriptBlockLogged 1102 AuditLogCleared 1116 DefenderThreatDetected 1117 DefenderThreatAction 1118 DefenderThreatAction 5001 DefenderRealtimeProtectionChanged
5007 DefenderConfigurationChanged 4768 KerberosTgtRequested 4769 KerberosServiceTicketRequested 1149 RemoteDesktopAuthenticated 21 RdpSessionLogon 24 RdpSessionDisconnected 25 RdpSessionReconnected""".split()
_IDS = [*_ACTIONS[::2], "9999", ""]
_PROVIDERS = ("Microsoft-Windows-Windows Defender", "Microsoft-Windows-TerminalServices-Gateway", "SMBServer", "Other")
_FAMILY = f"CASE k::INT % 4 WHEN 0 THEN CASE i % 3 WHEN 2 THEN 'DefenderThreatEvent' ELSE 'DefenderEvent' END WHEN 1 THEN 'RdpEvent' WHEN 2 THEN 'SmbEvent' ELSE CASE eid WHEN '' THEN 'Event' ELSE 'EventId ' || eid END END"


def _among(ids: str, value: str) -> str:
    return f"CASE WHEN eid IN ({', '.join(repr(x) for x in ids.split())}) THEN {value} END"


_RICH, _PATH = "i % 3 = 0", "i % 2 = 1"
#: Without an account in its data a remote-desktop event takes the first text like one in its message, here the end of the path.
_LAST = "'x\\' || k || '.exe'"
_LOG = [
    ("Provider", f"{list(_PROVIDERS)}[1 + k::INT % 4]"), ("EventId", "eid"), ("Computer", "'PC'"), ("User", f"CASE WHEN {_RICH} THEN 'tu' || u END"), ("User", f"CASE WHEN {_RICH} THEN 'su' END"),
    ("RemoteIP", f"CASE WHEN {_RICH} THEN '10.0.0.' || k END"), ("ThreatName", "CASE WHEN i % 3 = 2 THEN 'bad' || k END"), ("Path", f"CASE WHEN {_PATH} THEN 'C:\\x\\' || k || '.exe' END"),
    ("SubjectUser", f"CASE WHEN {_RICH} THEN {_among('4624 4625 4648 4672 5140 5145 4688 4697 4698 4702', repr('su'))} END"), ("TargetUser", f"CASE WHEN {_RICH} THEN {_among('4624 4625 4648 4768 4769', chr(39) + 'D' + chr(92) + 'tu' + chr(39) + ' || u')} END"),
    ("RemoteIP", f"CASE WHEN {_RICH} THEN {_among('4624 4625 5140 5145', chr(39) + '10.0.0.' + chr(39) + ' || k')} END"),
    ("RemoteIP", f"CASE WHEN {_RICH} THEN {_among('1149', chr(39) + '10.0.0.' + chr(39) + ' || k')} END"), ("TargetUser", f"CASE WHEN {_PATH} THEN {_among('1149', _LAST)} END"),
]
_BASE = f"CASE WHEN i % 3 = 1 AND {_PATH} THEN 'No structured data; a path comes from the message.' WHEN i % 3 = 1 THEN 'No structured data; from the event''s columns only.' WHEN {_PATH} THEN 'A further path comes from the message.' END"
_MORE = f"CASE WHEN {_RICH} AND eid IN ('4768', '4769') THEN 'Kerberos:0x6' WHEN {_RICH} AND eid = '4776' THEN 'ValidationStatus:0x6' WHEN i % 3 = 2 AND eid IN ('4698', '4702') THEN 'ScheduledTaskXmlPresent' END"
_DATA = "CASE i % 3 WHEN 0 THEN 'TargetUserName=tu' || u || ' | Target Domain Name=D | SubjectUserName=su | SubjectDomainName=- | IpAddress=10.0.0.' || k || ' | Status=0x6' WHEN 2 THEN 'Threat Name=bad' || k || ' | TaskContent=x | TargetUserName=-' ELSE '' END"
_SAYS = f"CASE WHEN {_PATH} THEN 'ran C:\\x\\' || k || '.exe now' ELSE '' END"


@query(f"""{_E}, v AS (SELECT *, i % 6 IN (0, 3, 4) AS has, {_IDS}[1 + (i // 7) % {len(_IDS)}] AS eid FROM e)
""" + record("'EventLog:Security'", f"coalesce(map({_ACTIONS[::2]}, {_ACTIONS[1::2]})[eid], {_FAMILY})", _LOG, "Security_filtered.csv", "Structured", ("'EventTime'", "'UnknownTime'"), ("'High'", "'Low'"),
             f"concat_ws(' | ', {_BASE}, {_MORE}, CASE WHEN NOT has THEN 'No usable time in this event.' END)", f"concat_ws(' | Data: ', nullif({_SAYS}, ''), nullif({_DATA}, ''))", fact_id="'EventLog_Security_' || i", fallback=f"({_BASE}) IS NOT NULL OR NOT has"))
def records_of_events(spark, sf_dir):
    """All 39 event ids and others, families of providers, data, messages and times that are there or not"""
    e, n = events(spark, sf_dir), F.col("i") % 3
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    rich = said("TargetUserName=tu", "$u", " | Target Domain Name=D | SubjectUserName=su | SubjectDomainName=- | IpAddress=10.0.0.", "$k", " | Status=0x6")
    data = F.when(n == 0, rich).when(n == 2, said("Threat Name=bad", "$k", " | TaskContent=x | TargetUserName=-")).otherwise("")
    message = F.when(F.col("i") % 2 == 1, said("ran C:\\x\\", "$k", ".exe now")).otherwise("")
    e = e.withColumns({"eid": pick(_IDS, F.floor(F.col("i") / 7) % len(_IDS)), "provider": pick(_PROVIDERS, F.col("k").cast("int") % 4)})
    r = demo.artifact(e, "Security_filtered.csv", F.col("h"), F.col("i"), TimeCreated=odd_time(), EventId=F.concat(F.lit(" "), "eid"), ProviderName=F.col("provider"), Computer=F.lit("PC"), UserId=F.lit("-"), TaskDisplayName=F.lit("N/A"), Message=message, EventData=data)
    return whole([normalize.event_log(r.withColumn("label", F.lit("Security")))])
