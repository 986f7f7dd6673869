"""Folders of evidence: names of hosts, equal inner folders, depth, spoilt files, large files, documents."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tracelake import model
from tracelake.operators import pivot
from tracelake.plans import reports
from tracelake.sources import intake, tables

HEAD = "PID,Name,Path,CommandLine,StartTime,User,SHA256\n"
ROW = "4,a.exe,C:\\t\\a.exe,,2025-01-02 03:04:05,kim," + "ab" * 16 + "\n"


def put(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("evidence")
    for case in ("case a+b", "caseB"):  # equal inner folders, names on file
        put(r, f"{case}/IR_Output_1/process_list.csv", HEAD + ROW)
    put(r, "case a+b/IR_Output_1/system_info.txt", "OS: x\nHostname: DESK-1\n")
    put(r, "caseB/IR_Output_1/deep/er/System_Info.TXT", "Hostname:  SRV-2 \n")
    put(r, "caseB/IR_Output_1/deep/er/EventLogs/Security_filtered.csv", "TimeCreated,EventId,Message\n2025-01-02 03:04:05,1102,m\n")
    put(r, "c[1]/x/prefetch.csv", "Executable,RunTimes,ReferencedFiles,RunCount\nA.EXE,2025-01-02 03:04:05;2025-02-02 03:04:05,\\WINDOWS\\a;\\USERS\\k\\b.dll,2\n")
    put(r, "c[1]/x/collection_coverage.json", json.dumps({"collection_mode_profile": " forensicstrict ", "is_administrator": True, "overall_status": "complete", "steps": []}))
    put(r, "bad/process_list.csv", HEAD + ROW)
    put(r, "bad/services.csv", "Name,PathName\nsvc,C:\\caf\xe9.exe\n".encode("latin-1"))
    put(r, "bad/bits_jobs.csv", b"DisplayName,JobState\njob,x\n" + b"\0" * 4096)
    put(r, "bad/memory_acquisition.json", '{"Status": "complete", "EndedAt": "2025')
    put(r, "bad/scheduled_tasks.xml", "<Tasks><Task><Actions><Exec><Command>a</Command></Exec></Actions></Task><Task><Actions>")
    put(r, "bad/deep/process_list.csv", "not chosen, as one lies at the top\n")
    put(r, "empty/readme.bin", b"\x00\x01")
    put(r, "process_list.csv", HEAD + ROW)  # in no case
    return r


@pytest.fixture(scope="module")
def taken(spark, root):
    return reports.evidence(spark, str(root))


@pytest.fixture(scope="module")
def facts(spark, taken, root):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/facts-of-intake"
    reports.facts_of(taken).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_hosts_and_cases(facts, taken):
    got = {(r["case_id"], r["host"], r["source"], r["n"]) for r in facts.groupBy("case_id", "host", "source").agg(F.count("*").alias("n")).collect()}
    assert got == {("case a+b", "DESK-1", "Process", 1), ("caseB", "SRV-2", "Process", 1), ("caseB", "SRV-2", "EventLog:Security", 1), ("c[1]", "c[1]", "Prefetch", 2), ("bad", "bad", "Process", 1)}
    c = {r["case_id"]: r for r in taken.cases().collect()}
    assert {k: r["host"] for k, r in c.items()} == {"case a+b": "DESK-1", "caseB": "SRV-2", "c[1]": "c[1]", "bad": "bad", "empty": "empty"}
    assert {k for k, r in c.items() if not r["ready"]} == {"empty"} and c["c[1]"]["collection_mode_profile"] == "ForensicStrict" and c["bad"]["collection_mode_profile"] == ""


def test_shared_entities_of_equal_inner_folders(facts):
    s = pivot.shared(model.fact_entities(facts), ("Hash",)).collect()
    assert [(r["hosts"], r["facts"], r["host_list"]) for r in s] == [(3, 3, ["DESK-1", "SRV-2", "bad"])]


def test_spoilt_files_are_left_out_with_a_warning_each(taken):
    w = {r["rel"]: r["warning"] for r in taken.warnings().collect()}
    assert set(w) == {"services.csv", "bits_jobs.csv", "memory_acquisition.json", "scheduled_tasks.xml"}
    assert "badly encoded" in w["services.csv"] and "zero byte" in w["bits_jobs.csv"] and "torn" in w["memory_acquisition.json"] and "no end" in w["scheduled_tasks.xml"]
    c = {r["case_id"]: r["load_warnings"] for r in taken.cases().collect()}
    assert sorted(c["bad"]) == sorted(w.values()) and c["caseB"] == [] and c["empty"] == ["no readable evidence"]


def test_a_file_that_goes_away_is_unreadable(spark, tmp_path):
    put(tmp_path, "a/x.csv", "k\n")
    rows = spark.createDataFrame([(f"file:{tmp_path}/a/{n}", "a", n, n, 2) for n in ("x.csv", "y.csv")], "file string, host string, rel string, name string, size long")
    got = {r["rel"]: r for r in intake.probed(rows).collect()}
    assert got["x.csv"]["reason"] is None and got["x.csv"]["sha256"] == hashlib.sha256(b"k\n").hexdigest()
    assert got["y.csv"]["reason"].startswith("unreadable") and got["y.csv"]["sha256"] is None


def test_files_larger_than_a_task_s_memory_are_hashed_in_chunks(tmp_path, monkeypatch):
    big = tmp_path / "memory.raw"
    with open(big, "wb") as f:  # 2.5 GB, most of it a hole
        f.seek(2_500_000_000)
        f.write(b"end")
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    size, sha, reason = intake._probe(f"file:{big}", "memory.raw", os.path.getsize(big))
    assert size == 2_500_000_003 and reason is None and len(sha) == 64
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB
    h = hashlib.sha256()
    with open(big, "rb") as f:
        while b := f.read(1 << 24):
            h.update(b)
    assert sha == h.hexdigest()
    monkeypatch.setattr(intake, "CHUNK", 3)  # characters cut by chunks are whole again
    put(tmp_path, "c/t.csv", "é🙂" * 9)
    assert intake._probe(str(tmp_path / "c/t.csv"), "t.csv", 1)[2] is None
    put(tmp_path, "c/u.csv", "é🙂".encode()[:-1])
    assert "badly encoded" in intake._probe(str(tmp_path / "c/u.csv"), "u.csv", 1)[2]


def test_documents_carry_warnings_profile_notes_and_totals(spark, taken, facts, tmp_path):
    cases = taken.cases()
    s = {r["case_id"]: r for r in reports.summaries(facts, cases=cases, evidence=taken.files.where("sha256 IS NOT NULL").withColumn("case_id", F.col("host"))).collect()}
    assert len(s["bad"]["load_warnings"]) == 4 and s["c[1]"]["collection_mode_profile"] == "ForensicStrict" and s["caseB"]["load_warnings"] == []
    assert len(s["bad"]["evidence"]) == 6 and s["bad"]["evidence_digest"] and "GH-PF-SIDELOAD-001" in {r["id"] for r in s["c[1]"]["guided_hunt"]["rule_matches"]}
    reports.correlate(facts, str(tmp_path / "c.json"), cases=cases)
    c = json.loads((tmp_path / "c.json").read_text())
    assert (c["ready_hosts"], c["skipped_hosts"], c["total_shared_entities"]) == (4, 1, len(c["shared_entities"])) and c["total_shared_entities"] == 3
    reports.full_log(facts.withColumn("source", F.when(F.col("host") == "bad", "MFT").otherwise(F.col("source"))), cases, str(tmp_path / "f.json"))
    f = json.loads((tmp_path / "f.json").read_text())
    assert len(f["load_warnings"]) == 5 and {"note": "bad: " + reports.NOTES["MFT"]} in f["parser_notes"]


def test_totals_are_counted_before_the_limit(spark):
    e = spark.range(600).select(F.explode(F.array(F.lit("h1"), F.lit("h2"))).alias("host"), F.concat(F.lit("C:\\"), "id").alias("v"), "id")
    f = model.conform(e.select(F.col("host").alias("case_id"), "host", F.col("id").alias("fact_ord"), F.array(F.struct(F.lit("Path").alias("type"), F.col("v").alias("value"))).alias("entity_refs")))
    whole = pivot.shared(model.fact_entities(f), most=None)
    assert whole.count() == 600 and pivot.first_shared(whole).count() == pivot.LIMIT
    n = {k: v.first()[0] for k, v in pivot.readiness(f, spark.createDataFrame([("h1",), ("h2",), ("h3",)], "case_id string")).items()}
    assert n == {"ready_hosts": 2, "skipped_hosts": 1}


def test_nothing_to_read(spark, tmp_path):
    put(tmp_path, "a/x.bin", b"1")
    with pytest.raises(reports.store.StoreError):
        reports.facts_of_folder(spark, str(tmp_path))
    assert tables.listing(spark, str(tmp_path)).count() == 1
