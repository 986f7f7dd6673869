"""Three hosts of an own case, from artifact files to facts, hunts, shared entities and graph; the last two against plain Python."""

from collections import defaultdict

import pytest

from tracelake import model
from tracelake.operators import graph, hunt, pivot
from tracelake.plans import reports

TOOL = "5A" * 16  # the hash of a renamed remote-support tool
SERVICE = r"C:\ProgramData\rmm\agent.exe"
FILES = {
    "KIOSK-07/process_list.csv": "PID,Name,Path,CommandLine,StartTime,User,SHA256\n"
    f"812,agent.exe,C:\\Users\\Public\\agent.exe,agent.exe --silent,2023-06-02 22:14:07,KIOSK-07\\guest,{TOOL}\n"
    f"77,lsass.exe,C:\\Windows\\System32\\lsass.exe,lsass.exe,2023-06-01 04:00:00,SYSTEM,{'b1' * 16}\n",
    "KIOSK-07/scheduled_tasks.xml": "<Tasks><Task><RegistrationInfo><URI>\\Refresh</URI></RegistrationInfo><Principals><Principal><UserId>guest</UserId></Principal></Principals>"
    "<Actions><Exec><Command>C:\\Users\\Public\\agent.exe</Command><Arguments>--refresh</Arguments></Exec></Actions></Task></Tasks>",
    "KIOSK-07/bits_jobs.csv": "DisplayName,OwnerAccount,JobState,CreationTime,ModificationTime,RemoteName,LocalName,Description\n"
    "fetch,KIOSK-07\\guest,Transferred,2023-06-02 22:10:00,2023-06-02 22:12:30,http://203.0.113.9/agent.bin,C:\\Users\\Public\\agent.exe,\n",
    "BACK-2/services.csv": f"Name,DisplayName,PathName,StartMode,State\nrmmsvc,Remote help,{SERVICE},Auto,Running\nSpooler,Print,C:\\Windows\\System32\\spoolsv.exe,Auto,Running\n",
    "BACK-2/amcache_files.csv": "RegistryKey,Path,FileName,Hash,ProductName,Publisher,ProgramId,FirstObservedTime,ExecutedTime,ParserNote\n"
    f"Root\\0,{SERVICE},agent.exe,{TOOL},,,id0,,2023-06-02 22:41:00,\n",
    "BACK-2/logon_sessions.csv": "ObservedAtUtc,StartTime,LogonId,User,Domain,Sid,LogonType,LogonTypeName,AuthenticationPackage,LogonProcessName\n"
    "2023-06-03 06:00:00,2023-06-02 22:38:19,0x9f,svc_help,BACK-2,S-1-5-21-5,10,RemoteInteractive,Negotiate,User32\n",
    "BACK-2/EventLogs/System_filtered.csv": "TimeCreated,EventId,LevelDisplayName,ProviderName,Computer,UserId,TaskDisplayName,Message,EventData\n"
    f'2023-06-02 22:40:02,7045,Information,Service Control Manager,BACK-2,S-1-5-18,,"A service was installed.","ServiceName=rmmsvc | ImagePath={SERVICE} | AccountName=LocalSystem"\n',
    "LEDGER/server_connections.csv": "ObservedAtUtc,ComputerName,UserName,ShareName,ActiveTimeSec,IdleTimeSec,ConnectionId,NumberOfFiles\n"
    "2023-06-02 23:05:44,\\\\BACK-2,SVC_HELP,D$,40,3,1,2\n2023-06-02 23:06:00,\\\\DESK-3,amara,reports,9,1,2,1\n",
    "LEDGER/EventLogs/Security_filtered.csv": "TimeCreated,EventId,LevelDisplayName,ProviderName,Computer,UserId,TaskDisplayName,Message,EventData\n"
    '2023-06-02 23:20:00,1102,Information,Eventlog,LEDGER,S-1-5-21-5,Log clear,"Cleared.","SubjectUserName=svc_help | SubjectDomainName=BACK-2"\n',
}
SEED = f"hash:{TOOL.lower()}"


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("evidence")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    reports.facts_of_folder(spark, str(root)).write.parquet(str(root / "facts"))
    return spark.read.parquet(str(root / "facts"))


def named(row):
    """Distinct references of a fact: key -> (type, spelling)."""
    out = {}
    for r in row["entity_refs"]:
        if r["value"] and r["value"].strip():
            out.setdefault(f"{r['type']}:{r['value'].strip()}".lower(), (r["type"], r["value"].strip()))
    return out


def test_facts(facts):
    n = {(r["host"], r["source"]): r["count"] for r in facts.groupBy("host", "source").count().collect()}
    assert n == {
        ("KIOSK-07", "Process"): 2, ("KIOSK-07", "ScheduledTask"): 1, ("KIOSK-07", "BITS"): 1, ("BACK-2", "Service"): 2, ("BACK-2", "Amcache"): 1,
        ("BACK-2", "LogonSession"): 1, ("BACK-2", "EventLog:System"): 1, ("LEDGER", "ServerConnection"): 2, ("LEDGER", "EventLog:Security"): 1,
    }
    assert facts.select("case_id", "fact_ord").distinct().count() == 12
    job = facts.where("source = 'BITS'").first()
    assert {(r["type"], r["value"]) for r in job["entity_refs"]} >= {("RemoteIP", "203.0.113.9"), ("User", "KIOSK-07\\guest"), ("Path", "C:\\Users\\Public\\agent.exe")}
    assert job["raw_ref"] == "bits_jobs.csv:2" and job["collection_step"] == "Execution Artifacts"
    assert facts.where("source = 'EventLog:System'").first()["action"] == "ServiceInstalled"


def test_hunts(facts):
    got = defaultdict(set)
    for r in hunt.evaluate(facts).collect():
        got[r["host"]].add(r["rule"])
    assert got == {
        "KIOSK-07": {"GH-BITS-001", "GH-TASK-001", "GH-EXEC-SUSPATH-001"},
        "BACK-2": {"GH-RDP-001", "GH-SVC-001", "GH-EXEC-SUSPATH-001"},
        "LEDGER": {"GH-SMB-001", "GH-LOGCLEAR-001"},
    }


def test_shared(facts):
    seen = defaultdict(list)
    for f in facts.collect():
        for k in named(f):
            seen[k].append(f["host"])
    want = {k: (len(set(v)), len(v)) for k, v in seen.items() if len(set(v)) > 1 and k.split(":")[0] in ("path", "hash", "user")}
    got = {r["entity_key"]: (r["hosts"], r["facts"]) for r in pivot.shared(model.fact_entities(facts)).collect()}
    assert got == want and set(want) == {SEED, "user:svc_help"}


@pytest.mark.parametrize(("seed", "depth"), [(SEED, 1), (SEED, 2), ("user:svc_help", 3)])
def test_graph(facts, seed, depth):
    rows = [(f["host"], named(f)) for f in facts.collect()]
    depths, edges, frontier = {seed: 0}, set(), [seed]
    for d in range(1, depth + 1):
        found = []
        for s in frontier:
            near = defaultdict(list)
            for h, e in rows:
                if s in e:
                    for k in e:
                        if k != s:
                            near[k].append(h)
            for k, hosts in near.items():
                edges.add((s, k, len(set(hosts)), len(hosts), d))
                if k not in depths:
                    depths[k] = d
                    found.append(k)
        frontier = found
    n, e = graph.expand(model.fact_entities(facts), seed, depth)
    assert {r["entity_key"]: r["depth"] for r in n.collect()} == depths
    assert {(r["seed"], r["entity_key"], r["hosts"], r["facts"], r["depth"]) for r in e.collect()} == edges and len(edges) > 3


def test_pivots_shuffle_no_fact(facts):
    """The references of a fact are told apart without a shuffle, and a seed's neighbours found without one of facts."""
    plan = model.fact_entities(facts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
