"""Readers, normalisers and operators on small hand-made files and frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracelake import model
from tracelake.functions import expr as X
from tracelake.operators import graph, hunt, normalize, pivot, quality, timeline
from tracelake.plans import reports
from tracelake.sources import store, tables
from tracelake.streaming import live

T = "2025-01-02 03:04:05"
FILES = {
    "process_list.csv": 'PID,Name,Path,CommandLine,StartTime,User,SHA256\n4,"a ""b"".exe",C:\\a.exe,,' + T + ',kim,0123456789abcdef\n5,x,,run "q, z",,,[none]\nshort\n',
    "logon_sessions.csv": f"ObservedAtUtc,StartTime,LogonId,User,Domain,Sid,LogonType,LogonTypeName,AuthenticationPackage,LogonProcessName\n{T},,1,D\\kim,D,S-1,10,Remote,NTLM,User32\n,{T},2,D\\jo,D,S-2,9,New,Negotiate,x\n",
    "server_connections.csv": f"ObservedAtUtc,ComputerName,UserName,ShareName,ActiveTimeSec,IdleTimeSec,ConnectionId,NumberOfFiles\n{T},\\\\10.0.0.7,kim,ADMIN$,1,2,3,4\n{T},desk,jo,docs,1,2,3,4\n",
    "services.csv": "Name,DisplayName,PathName,StartMode,State\nsvc,Service,C:\\Program Files\\x y\\s.exe -k,Auto,Running\n,,,,\n",
    "activity_timeline.csv": f"Time,Source,Action,Path,User,Details\n{T},JumpList,Opened,C:\\f.txt,kim,d\n",
    "bits_jobs.csv": f"DisplayName,OwnerAccount,JobState,CreationTime,ModificationTime,RemoteName,LocalName,Description\njob,kim,,{T},,http://10.1.2.3/a;\\\\srv\\s\\b,C:\\l,\n",
    "jump_lists.csv": f"Time,Source,AppId,Path,User,Details\n{T},auto,app1,\\\\srv\\share\\f,kim,\n,,,,,\n",
    "wmi_persistence.csv": "Class,Name,Filter,Consumer,Query,Path,Details\n__EventFilter,n,f,,SELECT 1,,d\n__FilterToConsumerBinding,n,f,c,,,d\n",
    "amcache_programs.csv": f"RegistryKey,ProgramName,Publisher,Version,ProductName,InstallDate,UninstallString,ProgramId,ParserNote\nk,P,Pub,1,Prod,{T},,id,\nk,,,,,,,,bad hive\nk,,,,,,,,BAD hive\n",
    "amcache_files.csv": f"RegistryKey,Path,FileName,Hash,ProductName,Publisher,ProgramId,FirstObservedTime,ExecutedTime,ParserNote\nk,C:\\a,a,h1,,,,{T},{T},\nk,C:\\b,b,h2,,,,,,\n",
    "srum_network_usage.csv": f"Timestamp,AppId,Path,User,RemoteIP,Interface,BytesSent,BytesReceived,ParserNote\n{T},app,C:\\a,kim,10.0.0.1,eth,1,2,\n",
    "srum_app_usage.csv": f"Timestamp,AppId,Path,User,ForegroundCycleTime,BackgroundCycleTime,ParserNote\n{T},app,C:\\a,kim,1,2,\n",
    "mft_preview.csv": f"Record,InUse,IsDir,FileName,FullPath,Size,StdCreated,StdModified,StdMftModified,StdAccessed,FnCreated,FnModified,FnMftModified,FnAccessed\n9,1,0,f,C:\\f,12,{T},,,,,,,\n10,1,0,g,C:\\g,0,,{T},,,,,,\n11,1,0,h,C:\\h,0,,,,,,,,\n",
    "usn_journal.csv": f"Journal info\nversion 2\nUsn,File name,Reason,Time stamp,File attributes\n1,a.txt,FILE_CREATE | CLOSE,{T},A\n2,b.txt,DATA_EXTEND,{T},A\n",
    "shellbags.csv": f"Sid,User,BagPath,RegistryKey,ValueName,DecodedPath,MruSlot,LastWriteTime,ParserNote,SourceFile\nS,kim,b,k,v,C:\\d,0,{T},,f\n",
    "scheduled_tasks.xml": "<Tasks><Task><RegistrationInfo><URI>\\T1</URI></RegistrationInfo><Principals><Principal><UserId>SYSTEM</UserId></Principal></Principals><Actions><Exec><Command>cmd.exe</Command><Arguments>/c  x -enc AA</Arguments></Exec><Exec><Command>C:\\Users\\k\\t.ps1</Command></Exec></Actions></Task></Tasks>",
    "kerberos_tickets.txt": f"ObservedAtUtc: {T}\nCached Tickets: (2)\n#0>     Client: kim @ CORP\n        Server: cifs/files.corp @ CORP\n        KerbTicket Encryption Type: AES\n        Start Time: 1/2/2025 1:00:00 (local)\n        Kdc Called: dc1\n#1>     Client: kim @ CORP\n        Server: krbtgt/CORP @ CORP\n        Start Time: \n",
    "stored_credentials.txt": f"ObservedAtUtc: {T}\n\n    Target: Domain:target=TERMSRV/files\n    Type: Domain Password\n    User: CORP\\kim\n\n    Target: LegacyGeneric:target=git\n    Type: Generic\n    User: me\n",
    "memory_acquisition.json": '{"Status": "complete", "EndedAt": "2025-01-02T03:04:05Z", "CollectorUser": "op", "OutputRelativePath": "m.raw", "OutputSha256": "ab"}',
    "memory_analysis.json": '{"Status": "partial", "StartedAt": "2025-01-02T03:04:05Z", "OutputFiles": ["a.txt", "", "b.txt"]}',
    "collection_coverage.json": '{"host_name": "h1", "is_administrator": true, "steps": [{"step": "System Info", "status": "partial"}, {"step": "system info", "status": "failed"}]}',
    "EventLogs/Security_filtered.csv": 'TimeCreated,EventId,LevelDisplayName,ProviderName,Computer,UserId,TaskDisplayName,Message,EventData\n,4624,I,Audit,h1,S,Logon,"C:\\m.exe ran","TargetUserName=kim | Target Domain Name=D | IpAddress=- | TargetUserName=two"\n'
    f'{T},5145,I,Audit,h1,S,Share,,"ShareLocalPath=C:\\s\\ | RelativeTargetName=\\d\\f.txt | IpAddress=10.9.9.9"\n{T},9999,I,SMBServer,h1,S,,,\n',
}


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("all")
    for name, text in FILES.items():
        p = root / "h1" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    reports.facts_of_folder(spark, str(root)).write.parquet(str(root / "facts"))
    return spark.read.parquet(str(root / "facts"))


def of(facts, source):
    return sorted(facts.where(F.col("source") == source).collect(), key=lambda r: r["fact_ord"])


def refs(r):
    return {(x["type"], x["value"]) for x in r["entity_refs"]}


def test_every_source(facts):
    n = {r["source"]: r["count"] for r in facts.groupBy("source").count().collect()}
    assert n == {"Process": 3, "LogonSession": 2, "ServerConnection": 2, "Service": 1, "JumpList": 2, "BITS": 1, "WmiPersistence": 2, "Amcache": 5, "SRUMNetwork": 1, "SRUMApp": 1, "MFT": 2, "USN": 2, "ShellBags": 1, "ScheduledTask": 2, "KerberosTicketCache": 2, "StoredCredential": 2, "MemoryAcquisition": 2, "MemoryAnalysis": 3, "EventLog:Security": 3}
    assert facts.select("fact_ord").distinct().count() == facts.count()


def test_details_of_sources(facts):
    a, b, c = of(facts, "Process")
    assert refs(a) == {("Path", "C:\\a.exe"), ("Hash", "0123456789abcdef"), ("User", "kim")} and a["details"] == 'a "b".exe C:\\a.exe' and a["time"] == dt.datetime(2025, 1, 2, 3, 4, 5)
    assert b["time"] is None and b["time_kind"] == "UnknownTime" and b["fallback_used"] and b["collection_status"] == "partial" and b["collection_privilege"] == "Administrator"
    r, n = of(facts, "LogonSession")
    assert (r["action"], r["time_kind"], n["action"], n["time_confidence"]) == ("RemoteInteractiveSessionObserved", "ObservedTime", "LogonSessionObserved", "High")
    s, d = of(facts, "ServerConnection")
    assert ("RemoteIP", "10.0.0.7") in refs(s) and ("Workstation", "desk") in refs(d)
    assert ("RemoteIP", "10.1.2.3") in refs(of(facts, "BITS")[0]) and {("Workstation", "srv"), ("ShareName", "s")} <= refs(of(facts, "BITS")[0])
    k, k2 = of(facts, "KerberosTicketCache")
    assert {("User", "kim"), ("TargetServer", "files.corp"), ("Computer", "dc1")} <= refs(k) and k["time"] == dt.datetime(2025, 1, 2, 1) and k2["time_kind"] == "ObservedTime"
    assert {("User", "CORP\\kim"), ("TargetServer", "files")} <= refs(of(facts, "StoredCredential")[0])
    assert [r["action"] for r in of(facts, "MFT")] == ["Created", "Modified"] and [r["action"] for r in of(facts, "USN")] == ["Created", "Modified"]
    assert of(facts, "USN")[0]["raw_ref"] == "usn_journal.csv:2"
    e, share, smb = of(facts, "EventLog:Security")
    assert e["time"] is None and {("User", "kim"), ("TargetUser", "D\\kim"), ("Path", "C:\\m.exe")} <= refs(e) and not any(t == "RemoteIP" for t, _ in refs(e))
    assert {("Path", "C:\\s\\d\\f.txt"), ("RemoteIP", "10.9.9.9")} <= refs(share) and smb["action"] == "SmbEvent" and smb["fact_id"] == "EventLog_Security_2"
    assert [r["action"] for r in of(facts, "MemoryAnalysis")] == ["MemoryAnalysisPartial", "MemoryAnalysisOutputObserved", "MemoryAnalysisOutputObserved"]
    assert {r["action"] for r in of(facts, "Amcache")} == {"Installed", "ParseNoteObserved", "Executed", "FirstObserved"}


def test_hunts(facts):
    got = {r["rule"] for r in hunt.evaluate(facts).collect()}
    assert {"GH-RDP-001", "GH-SMB-001", "GH-BITS-001", "GH-CRED-001", "GH-WMI-001", "GH-TASK-001", "GH-SVC-001"} <= got
    assert hunt.hypotheses(hunt.evaluate(facts)).where("question IS NULL").count() == 0


def test_prefetch(spark):
    r = spark.createDataFrame([("/x/p.pf", "h", 0, "A.EXE", [dt.datetime(2025, 1, 1), dt.datetime(2024, 1, 1)], ["\\WINDOWS\\a", "\\USERS\\k\\b.dll"], 3, ""), ("/x/p.pf", "h", 1, "B.EXE", [], None, 0, "n")], "file string, host string, i long, executable string, run_times array<timestamp>, referenced array<string>, run_count int, note string")
    got = sorted(normalize.prefetch(r).collect(), key=lambda x: x["fact_id"])
    assert [x["fact_id"] for x in got] == ["Prefetch_0_run_0", "Prefetch_0_run_1", "Prefetch_1_norun"]
    assert ("ReferencedFile", "\\USERS\\k\\b.dll") in refs(got[0]) and len(refs(got[0])) == 2 and len(refs(got[1])) == 1 and got[2]["fallback_used"]


def test_timeline_has_jump_lists_once(facts):
    t = timeline.of_facts(facts).where("source = 'JumpList'").collect()
    assert len(t) == 1 and t[0]["raw_ref"].startswith("activity_timeline.csv")


def test_store(spark, facts, tmp_path):
    store.save(facts, str(tmp_path / "s"))
    assert store.load(spark, str(tmp_path / "s")).count() == facts.count()
    store.append(facts.limit(2), str(tmp_path / "s"))
    assert store.load(spark, str(tmp_path / "s")).count() == facts.count() + 2
    with pytest.raises(store.StoreError):
        store.checked(facts.withColumn("schema_version", F.lit(9)))
    with pytest.raises(store.StoreError):
        store.checked(facts.limit(0))
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"fact_id": "a", "schema_version": 3}\nnot json\n')
    good, skipped = store.load_json(spark, str(tmp_path / "j"))
    assert (good.count(), skipped) == (1, 1)
    store.timeline_csv(spark.createDataFrame([("=1+1", "ok")], "a string, b string"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).first()["a"] == "'=1+1"
    (one,) = facts.limit(1).collect()
    for path in ("two", "three"):  # a store of one fact, to which another is added
        store.save(facts.limit(1), str(tmp_path / path))
    store.append(facts.where(F.col("fact_id") != one["fact_id"]).limit(1).withColumn("fact_ord", F.lit(one["fact_ord"])), str(tmp_path / "two"))
    two = store.load(spark, str(tmp_path / "two"))
    assert two.select("case_id", "fact_ord").distinct().count() == 2
    e = model.fact_entities(two)
    assert {r["fact_id"] for r in e.collect()} == {r["fact_id"] for r in two.where("size(entity_refs) > 0").collect()}
    full = store.refill(store.load(spark, str(tmp_path / "three")), facts)
    assert full.select("case_id", "fact_ord").distinct().count() == full.count() == facts.where(F.col("source") != one["source"]).count() + 1


def required(schema, value):
    """What a document lacks of a schema's required members: {name: schema of the members below, or None}."""
    if isinstance(schema, list):
        return [x for v in value for x in required(schema[0], v)]
    return [k for k in schema if k not in value or value[k] is None] + [x for k, s in schema.items() if s and k in value for x in required(s, value[k])]


HEAD = dict.fromkeys(("export_schema", "generated_at", "tool_name", "tool_version"))
HOSTS = [dict.fromkeys(("host", "case_id", "fact_count"))]


def test_documents(spark, facts, tmp_path):
    read = lambda name: json.loads((tmp_path / name).read_text())
    other = facts.union(facts.withColumns({"host": F.lit("h2"), "case_id": F.lit("h2")}))
    reports.correlate(other, str(tmp_path / "c.json"))
    c = read("c.json")
    row = [dict.fromkeys(("entity_type", "value", "fact_count", "host_count", "hosts"))]
    assert not required(HEAD | {"host_count": None, "hosts": HOSTS, "shared_entities": row, "temporal_correlations": row}, c)
    assert c["export_schema"] == "correlation_v1" and c["host_count"] == 2 == len(c["hosts"])
    assert len(c["shared_entities"]) == pivot.shared(model.fact_entities(other)).count() > 5 and c["temporal_correlations"]
    reports.draw(other, "User:kim", str(tmp_path / "g.json"))
    g = read("g.json")
    nodes, edges = [dict.fromkeys(("type", "value", "depth"))], [dict.fromkeys(("from_type", "from_value", "to_type", "to_value", "depth"))]
    assert not required(HEAD | dict.fromkeys(("seed_type", "seed_value", "max_depth", "host_count", "node_count", "edge_count")) | {"nodes": nodes, "edges": edges}, g)
    assert g["export_schema"] == "graph_v1" and (g["node_count"], g["edge_count"]) == (len(g["nodes"]), len(g["edges"])) and g["edge_count"] > 5
    assert g["nodes"][0]["value"] == "kim" and g["nodes"][0]["depth"] == 0
    reports.draw(other, "User:nobody", str(tmp_path / "none.json"))
    assert read("none.json")["edges"] == [] and len(read("none.json")["nodes"]) == 1
    manifest = spark.createDataFrame([("h1", "process_list.csv", 5, "ab")], "host string, rel string, size long, sha256 string")
    reports.analyse(other, str(tmp_path / "s"), evidence=manifest)
    docs = [json.loads(line) for p in (tmp_path / "s").glob("_by=*/part-*") for line in p.read_text().splitlines()]
    assert {d["host"] for d in docs} == {"h1", "h2"} and all(not required(HEAD | dict.fromkeys(("host", "fact_count")), d) for d in docs)
    (one,) = [d for d in docs if d["host"] == "h1"]
    assert one["fact_count"] == facts.count() and one["export_schema"] == "summary_v3" and one["evidence"][0]["sha256"] == "ab" and one["evidence_digest"]
    assert sum(one["fact_source_counts"].values()) == facts.count() and len(one["fact_samples"]) == min(100, facts.count())
    assert {r["id"] for r in one["guided_hunt"]["rule_matches"]} >= {"GH-RDP-001", "GH-SMB-001"} and all(h["title"] and h["suggested_tags"] for h in one["guided_hunt"]["hypothesis_templates"])
    cases = tables.cases(spark.createDataFrame([("h1", "process_list.csv"), ("h9", "x.bin")], "host string, name string"))
    reports.full_log(facts, cases, str(tmp_path / "f.json"))
    f = read("f.json")
    assert f["export_schema"] == "full_log_v3" and len(f["facts"]) == f["fact_count"] == facts.count() and f["host_count"] == 2
    assert f["load_warnings"] == [{"warning": "h9: no readable evidence"}] and f["facts"][0]["Time"].startswith("/Date(") and f["parser_notes"]


def test_event_texts(spark):
    rows = [
        ("4688", "P", "", "NewProcessName=C:\\A.exe | CommandLine=A.exe  -x"), ("4624", "P", "m", "TargetUserName=Kim | LogonType=3 | IpAddress=10.0.0.1"), ("4698", "P", "", "TaskName=\\T | SubjectUserName=jo"),
        ("7045", "P", "", "ServiceName=svc | ImagePath=C:\\s.exe"), ("4104", "P", "", "ScriptBlockText=Get-X"), ("5140", "P", "Msg\ntwo", "ShareName=C$ | IpAddress=1.2.3.4"), ("9", "Prov", "", ""), ("", "", "", "a=b"),
    ]
    d = spark.createDataFrame(rows, "id string, p string, m string, d string")
    got = [(r[0], r[1]) for r in d.select(timeline.event_indicator(F.col("id"), F.col("p"), F.col("m"), F.col("d")), timeline.sample_text(F.col("id"), F.col("m"), F.col("d"))).collect()]
    assert got == [
        ("event:4688:a.exe  -x", "C:\\A.exe | A.exe  -x"), ("event:4624:user=kim type=3 ip=10.0.0.1", "User=Kim Type=3 IP=10.0.0.1"), ("event:4698:jo", "\\T | jo"), ("event:7045:c:\\s.exe", "svc | C:\\s.exe"),
        ("event:4104:get-x", "Get-X"), ("event:5140:msg\ntwo", "Share=C$ IP=1.2.3.4"), ("event:9:prov", ""), ("event:unknown:a=b", "a=b"),
    ]
    assert list(timeline.HIGHLIGHTS)[:3] == ["4624", "4625", "4648"] and len(timeline.HIGHLIGHTS) == 22 and {"4719", "4722", "4725", "1149"} <= set(timeline.HIGHLIGHTS)


def test_evidence_line(spark, facts):
    r = facts.where("source = 'ServerConnection'").orderBy("fact_ord").select(hunt.evidence_line()).first()[0]
    assert r == "2025-01-02T03:04:05.0000000Z | ServerConnection/ServerShareConnectionObserved | user=kim | remote=10.0.0.7 | share=ADMIN$ | detail=ConnectionId=3; ActiveTimeSec=1; IdleTimeSec=2; NumberOfFiles=4"
    untimed = facts.where("source = 'Autorun' OR source = 'Service'").select(hunt.evidence_line()).first()[0]
    assert untimed.startswith("(time unavailable) | Service/")


def test_credential_facts_are_those_of_the_pairs(facts):
    pairs = hunt.credential_pairs(facts).collect()
    want = {(p["case_id"], p[k]) for p in pairs for k in ("credential", "remote")}
    assert {(r["case_id"], r["fact_ord"]) for r in hunt.credential_facts(facts).collect()} == want != set()


def test_zones(spark, tmp_path):
    (tmp_path / "far").mkdir()
    (tmp_path / "far" / "process_list.csv").write_text("PID,Name,Path,StartTime\n1,a,C:\\a.exe,2025-01-02 03:04:05\n2,b,C:\\b.exe,2025-01-02T03:04:05Z\n")
    zones = spark.createDataFrame([("far", "Asia/Taipei")], "host string, zone string")
    times = [r["time"] for r in reports.facts_of_folder(spark, str(tmp_path), zones).orderBy("fact_ord").collect()]
    assert times == [dt.datetime(2025, 1, 1, 19, 4, 5), dt.datetime(2025, 1, 2, 3, 4, 5)]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join(f"{i} {'x' * (i % 37)}\n" for i in range(900 * k + 5)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = tables.lines(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5 + 905 + 1805 and all(int(r["value"].split()[0]) == r["line"] for r in rows)


def test_files(spark, tmp_path):
    for name in ("a/x.csv", "a/sub/x.csv", "b/sub/x.csv", "b/info.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("Hostname: REAL\n" if name.endswith("txt") else "k\n1\n")
    f = tables.listing(spark, str(tmp_path))
    got = {(r["host"], r["rel"], r["rank"]) for r in tables.artifact(f, spark.createDataFrame([("x.csv",)], "rel string")).collect()}
    assert got == {("a", "x.csv", 0), ("b", "sub/x.csv", 2)}
    assert {r["host"] for r in tables.cases(f).collect()} == {"a", "b"}
    assert tables.host_name(spark, f"{tmp_path}/b/info.txt").first()["host"] == "REAL"
    assert quality.manifest(spark.read.format("binaryFile").load(f"{tmp_path}/b/info.txt").select(F.lit("b").alias("host"), F.lit("info.txt").alias("rel"), "content")).first()["size"] == 15


def test_functions(spark):
    d = spark.createDataFrame([("kim@x.org from 10.0.0.1 at C:\\Users\\kim\\a.txt and \\\\srv\\s\\f",)], "t string")
    got = d.select(X.redact(F.col("t"), True).alias("r"), X.mask_principal(F.lit("D\\kim")).alias("p"), X.base_name(F.lit("C:\\a\\b.txt")).alias("b"), X.tags(F.lit("a; B,b\nA")).alias("g"), X.epoch(F.lit(133802606450000000)).alias("w"), X.epoch(F.lit(1735787045)).alias("u"), X.service_host(F.lit("cifs/h.x:445 @ R")).alias("s"), X.is_hash(F.lit("a" * 40)).alias("h"), graph.trail(F.array(*map(F.lit, "abcdefg")), 3).alias("tr"),
        X.event_xml(F.lit("<Event><EventData><Data Name='A b'>1 &amp; 2</Data><Data>x</Data></EventData><UserData><E><Leaf>v</Leaf></E></UserData></Event>")).alias("x"), X.flatten(F.create_map(F.lit("k"), F.lit("a|b"))).alias("fl")).first()
    assert got["r"].startswith("[email] from [ipv4] at [path_redacted]") and "kim" not in got["r"] and got["p"] == "[user_redacted]" and got["b"] == "b.txt" and got["g"] == ["a", "B"]
    assert got["u"] == dt.datetime(2025, 1, 2, 3, 4, 5) == got["w"] and got["s"] == "h.x" and got["h"] is False and got["tr"] == "e -> f -> g"
    assert got["x"] == {"ab": "1 & 2", "data1": "x", "leaf": "v"} and got["fl"] == "k=a/b"


def test_pivots(spark):
    row = lambda host, k, t, *r: (host, host, k, f"f{k}", t, "S", "A", [{"type": a, "value": b} for a, b in r])
    ten = dt.datetime(2025, 1, 1, 10, 4)
    f = model.conform(spark.createDataFrame([row("A", 0, ten, ("Path", "C:\\BAD.exe"), ("Path", "c:\\bad.EXE"), ("User", "k")), row("B", 0, ten + dt.timedelta(minutes=8), ("Path", " C:\\bad.exe"), ("User", "K")), row("B", 1, None, ("User", "k"))], "case_id string, host string, fact_ord long, fact_id string, time timestamp, source string, action string, entity_refs array<struct<type:string,value:string>>"))
    e = model.fact_entities(f)
    assert e.count() == 5
    s = {r["entity_key"]: r for r in pivot.shared(e).collect()}
    assert s["path:c:\\bad.exe"]["facts"] == 2 and s["path:c:\\bad.exe"]["display"] == "C:\\BAD.exe" and s["user:k"]["facts"] == 3
    assert [(r["entity_key"], r["hosts"], r["facts"]) for r in pivot.temporal(e, 30, ("User",)).collect()] == [("user:k", 2, 2)]
    assert pivot.related(e, "path:c:\\bad.exe").first()["facts"] == 2
    assert {r["refs"] for r in pivot.type_counts(f).collect()} == {3}
    assert pivot.bucket_facts(e, "user:k", "2025-01-01 10:00:00", 10).count() == 1


def test_streaming(spark, facts, tmp_path):
    facts.write.parquet(str(tmp_path / "in"))
    q = live.append_facts(spark, str(tmp_path / "in"), facts.schema, lambda d: d, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert live.stored(spark, str(tmp_path / "out")).count() == facts.count()
    with pytest.raises(ValueError):
        live.live_shared(facts, 25)
