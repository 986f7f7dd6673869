"""What writing a part of the store costs: steps that all cores share, rows that are not worked out or sorted twice."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelake import demo, model, queries
from tracelake.sources import snapshots
from tracelake.streaming import live

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_index_rows_of_odd_references(spark, tmp_path):
    refs = "CASE i WHEN 0 THEN array(named_struct('type', 'User', 'value', ' Kim'), named_struct('type', 'user', 'value', 'KIM'), named_struct('type', 'Path', 'value', ' ')) "
    refs += "WHEN 1 THEN array(named_struct('type', 'Path', 'value', CAST(NULL AS string)), NULL, named_struct('type', NULL, 'value', 'x'), named_struct('type', 'Hash', 'value', 'A')) WHEN 2 THEN array() END"
    facts = model.conform(spark.range(4).selectExpr("id AS i").select(F.lit("c").alias("case_id"), F.lit(" ").alias("host"), F.col("i").alias("fact_ord"), F.col("i").cast("string").alias("fact_id"), F.expr(refs).alias("entity_refs")))
    got, want = snapshots.save(facts, str(tmp_path / "s")).entities(), model.fact_entities(facts)
    assert rows(got.select(want.columns)) == rows(want) and want.count() == 2


def test_facts_from_one_task_are_put_in_order_by_several(spark, tmp_path, monkeypatch):
    """a file that one task reads, such as a stream's batch, does not leave the index to that task."""
    monkeypatch.setattr(snapshots, "STAGED", 100, raising=False)
    read, ranged = [], snapshots._ranged
    monkeypatch.setattr(snapshots, "_ranged", lambda df, *a: (read.append(len(df.inputFiles())), ranged(df, *a))[1])
    facts = demo.events(spark, SF)
    s = snapshots.save(facts.coalesce(1), str(tmp_path / "s"))
    assert len(read) == 2 and min(read) >= 10 and rows(s.facts().select("fact_id")) == rows(facts.select("fact_id"))


def test_rows_of_less_than_a_file_are_dealt_to_all_cores(spark):
    df = spark.range(1000)
    cores = spark.sparkContext.defaultParallelism
    files = lambda n: snapshots._ranged(df, n, 1_000_000, "id").rdd.getNumPartitions()
    assert files(10) == files(0) == 1 and files(900_000) == cores and files(1_000_000 * cores + 1) == 2 * cores


def test_zones_sort_no_rows(spark, tmp_path):
    s = snapshots.save(demo.events(spark, SF), str(tmp_path / "s"))
    for kind, schema, key in (("facts", snapshots.FACT_ROWS, "primary_key"), ("entities", snapshots.INDEX_ROWS, "entity_key")):
        z = snapshots._zones(spark, f"{s.path}/parts/{s.parts[0]}", s.parts[0], kind, schema, key)
        assert "SortAggregate" not in z._jdf.queryExecution().executedPlan().toString()
        kept = s.zones().where(F.col("kind") == kind).collect()
        assert rows(z.select(s.zones().columns)) == sorted(map(str, kept)) and {(r["source_lo"], r["source_hi"]) for r in kept} == {("Events", "Events")}


def test_compaction_works_out_nothing_anew(spark, tmp_path, monkeypatch):
    path, facts = str(tmp_path / "s"), demo.events(spark, SF)
    snapshots.save(facts.where("action = 'click'"), path)
    before = snapshots.append(facts.where("action <> 'click'"), path)

    def anew(*_, **__):
        raise AssertionError

    monkeypatch.setattr(snapshots, "write_part", anew)
    after = snapshots.compact(spark, path)
    assert len(after.parts) == 1 and rows(after.facts()) == rows(before.facts())
    assert rows(after.entities()) == rows(before.entities()) == rows(model.fact_entities(before.facts()).select(before.entities().columns))
    for least in (1, 50):
        assert rows(after.frequent(least, 5_000)) == rows(before.frequent(least, 5_000))


def test_files_of_a_stream_can_be_read_by_several_tasks(spark, monkeypatch):
    """each of the three batches is one file still, of several row groups when it is large."""
    many = demo.events(spark, SF).crossJoin(spark.range(600).select("id")).withColumn("fact_ord", F.col("fact_ord") + 1000 * F.col("id")).withColumn("fact_id", F.concat(F.lit("Events_"), "fact_ord")).drop("id")
    monkeypatch.setattr(demo, "events", lambda *_: many)

    def arrived(spark, folder, *_, **options):
        files = spark.read.parquet(folder).inputFiles()
        assert options == {"maxFilesPerTrigger": "1"} and len(files) == 3
        raise InterruptedError(min(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in files))

    monkeypatch.setattr(live, "append_facts", arrived)
    with pytest.raises(InterruptedError) as told:
        queries.QUERIES["stream_store"](spark, SF)
    assert told.value.args[0] > 1


def test_first_facts_of_a_store_are_not_joined(spark, tmp_path, monkeypatch):
    """the first batch of a stream was shuffled by case, of which there are few, to look for places that nobody used."""
    path, plans, real = str(tmp_path / "s"), [], snapshots.write_part
    monkeypatch.setattr(snapshots, "write_part", lambda f, *a, **k: (plans.append(f._jdf.queryExecution().executedPlan().toString()), real(f, *a, **k))[1])
    facts = demo.events(spark, SF)
    for _ in range(2):
        s = snapshots.append(facts, path)
    assert "Join" not in plans[0] and "Join" in plans[1]
    assert s.facts().select("case_id", "fact_ord").distinct().count() == 2 * facts.count()
