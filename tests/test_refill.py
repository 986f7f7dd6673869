"""A store follows a folder of evidence: unchanged cases are not opened, changed ones replace their facts."""

import os

import pytest
from pyspark.sql import functions as F

from tracelake import demo
from tracelake.plans import refill, reports
from tracelake.sources import snapshots

HEAD = "PID,Name,Path,CommandLine,StartTime,User,SHA256\n"


def case(root, name, *programs, host=None):
    folder = root / name / "IR_Output_1"
    os.makedirs(folder, exist_ok=True)
    (folder / "process_list.csv").write_text(HEAD + "".join(f"1,,C:\\x\\{p}.exe,,2024-01-01 00:00:00,u,\n" for p in programs))
    if host:
        (folder / "system_info.txt").write_text(f"Hostname: {host}\n")


def seen(s):
    paths = F.transform(F.filter("entity_refs", lambda r: r["type"] == "Path"), lambda r: F.replace(r["value"], F.lit("C:\\x\\"), F.lit("")))
    return sorted((r["case_id"], r["host"], r["p"]) for r in s.facts().select("case_id", "host", F.explode(paths).alias("p")).collect())


def indexed(s):
    return sorted((r["case_id"], r["value_norm"]) for r in s.entities().where("entity_type = 'Path'").collect())


def cases(done):
    return sorted(tuple(r) for r in done.cases.select("case_id", "added", "changed", "removed").collect())


@pytest.fixture
def filled(spark, tmp_path):
    root, path = tmp_path / "evidence", f"file://{tmp_path}/store"
    case(root, "A", "one", "two", host="KIM")
    case(root, "B", "one")
    return root, path, refill.refill(spark, str(root), path)


def test_first_refill_takes_all(filled):
    _, _, done = filled
    assert cases(done) == [("A", 2, 0, 0), ("B", 1, 0, 0)]
    assert seen(done.snapshot) == [("A", "KIM", "one.exe"), ("A", "KIM", "two.exe"), ("B", "B", "one.exe")]


def test_unchanged_folder_opens_no_file(spark, filled, monkeypatch):
    root, path, first = filled
    monkeypatch.setattr(reports, "evidence", lambda *a: pytest.fail("files were read"))
    done = refill.refill(spark, str(root), path)
    assert done.snapshot.version == first.snapshot.version and cases(done) == []


def test_changed_case_replaces_its_facts(spark, filled, monkeypatch):
    root, path, first = filled
    last = first.snapshot.facts().agg(F.max("fact_ord")).first()[0]
    case(root, "A", "three", host="LEE")
    case(root, "C", "four")
    opened, take = [], reports.evidence
    monkeypatch.setattr(reports, "evidence", lambda *a: opened.append(take(*a)) or opened[-1])
    done = refill.refill(spark, str(root), path)
    assert cases(done) == [("A", 0, 2, 0), ("C", 1, 0, 0)]
    assert {r["host"] for r in opened[0].files.select("host").collect()} == {"A", "C"}
    assert seen(done.snapshot) == [("A", "LEE", "three.exe"), ("B", "B", "one.exe"), ("C", "C", "four.exe")]
    assert indexed(done.snapshot) == [("A", r"c:\x\three.exe"), ("B", r"c:\x\one.exe"), ("C", r"c:\x\four.exe")]
    assert [r["case_id"] for r in done.snapshot.entities([r"path:c:\x\one.exe"]).collect()] == ["B"]
    assert done.snapshot.facts().where("case_id = 'A'").agg(F.min("fact_ord")).first()[0] > last
    assert seen(first.snapshot) == [("A", "KIM", "one.exe"), ("A", "KIM", "two.exe"), ("B", "B", "one.exe")]  # the version a reader holds


def test_removed_file_empty_case_and_moved_folder(spark, filled, tmp_path):
    root, path, _ = filled
    os.remove(root / "A" / "IR_Output_1" / "process_list.csv")
    os.rename(root / "B", tmp_path / "closed")
    done = refill.refill(spark, str(root), path)
    assert cases(done) == [("A", 0, 0, 1)]
    assert seen(done.snapshot) == [("B", "B", "one.exe")]
    case(root, "A", "back", host="KIM")
    assert seen(refill.refill(spark, str(root), path).snapshot) == [("A", "KIM", "back.exe"), ("B", "B", "one.exe")]


def test_other_facts_and_compaction(spark, filled):
    root, path, _ = filled
    other = demo.events(spark, "/root/testdata/sf0.001").limit(3).withColumn("case_id", F.lit("A"))
    n = other.count()
    snapshots.append(other, path)
    snapshots.append(other, path)
    case(root, "A", "three", host="KIM")
    refill.refill(spark, str(root), path)
    case(root, "A", "five", host="KIM")
    before = refill.refill(spark, str(root), path).snapshot
    after = snapshots.compact(spark, path, small=1 << 40)
    assert len(after.parts) == 2 < len(before.parts) and not after.having("hidden")
    for s in (before, after):
        assert s.facts().count() == 2 + 2 * n
        assert s.facts().groupBy("case_id", "fact_ord").count().where("count > 1").isEmpty()
        assert seen(s.__class__(spark, s.path, s.version, s.having("ledger"), {}, s.more)) == [("A", "KIM", "five.exe"), ("B", "B", "one.exe")]
    assert refill.refill(spark, str(root), path).snapshot.version == after.version  # the ledger was carried over
    case(root, "A", "six", host="KIM")
    assert refill.refill(spark, str(root), path).snapshot.facts().count() == 2 + 2 * n


def test_empty_root(spark, tmp_path):
    os.makedirs(tmp_path / "none" / "A")
    done = refill.refill(spark, str(tmp_path / "none"), f"file://{tmp_path}/store")
    assert done.snapshot.version == 0 and cases(done) == []
