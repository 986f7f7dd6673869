"""What the store shuffles and writes of a fact: rows in compressed blocks, ids without their numbers; whatever the rows are, they come back."""

import pytest
from pyspark.sql import functions as F

from tracelake import demo, model
from tracelake.sources import snapshots

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def shuffled_by(spark, act):
    """Bytes that act's stages shuffled."""
    sc = spark.sparkContext._jsc.sc()
    first = sc.dagScheduler().nextStageId()
    act()
    return sum(sc.statusStore().lastStageAttempt(i).shuffleWriteBytes() for i in range(first, sc.dagScheduler().nextStageId()))


def test_rows_are_shuffled_in_blocks(spark, tmp_path):
    """They were shuffled one by one, with all that their fact says: here 71 bytes of each fact, and 7 in blocks."""
    many = demo.lines(spark, SF).crossJoin(spark.range(20).select("id")).withColumn("fact_ord", F.col("fact_ord") + F.col("id")).withColumn("fact_id", F.concat(F.lit("LineItem_"), "fact_ord")).drop("id")
    many.write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    n = facts.count()
    shuffled = shuffled_by(spark, lambda: snapshots.save(facts, f"{tmp_path}/s"))
    assert n > 100_000 and 0 < shuffled < 20 * n


@pytest.mark.parametrize("room", [1, 20_000, 1 << 27])
def test_ranges_lose_nothing(spark, monkeypatch, room):
    monkeypatch.setattr(snapshots, "ROOM", room)
    key = F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL WHEN id % 7 = 0 THEN 'é' ELSE concat('k', id % 50) END")
    time = F.expr("CASE WHEN id % 11 = 0 THEN NULL ELSE timestamp_millis(id * 977) - INTERVAL '400' YEAR END")
    df = spark.range(3_000).select(key.alias("k"), time.alias("t"), "id", F.expr("CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN array() ELSE array(NULL, named_struct('type', 'a', 'value', NULL), named_struct('type', NULL, 'value', '')) END").alias("refs"))
    out = snapshots._ranged(df, 3_000, 200, "k", "t", "id").withColumn("file", F.spark_partition_id())
    assert rows(out.select(df.columns)) == rows(df)
    files = {}
    for r in out.collect():
        files.setdefault(r["file"], []).append(r)
    order = lambda r: (r["k"] is not None, (r["k"] or "").encode(), r["t"] is not None, r["t"] and r["t"].timestamp(), r["id"])
    assert len(files) >= 10 and max(map(len, files.values())) < 900  # a third of all rows has one key
    assert [r["id"] for f in sorted(files) for r in files[f]] == [r["id"] for r in sorted((r for f in files.values() for r in f), key=order)]


IDS = ["Events_17", "17", "0", "x007", "a0", "", None, "none", "n_123456789012345678901234567890", "Ünï_12", "12_", "-5", "e_9223372036854775807", "e_999999999999999999"]


def test_odd_ids_come_back(spark, tmp_path):
    places = [0, 17, -1, None, -(1 << 63), (1 << 63) - 1]
    facts = [("c", "h", o, i, [("Key", f"k{o}")]) for i in IDS for o in places]
    f = model.conform(spark.createDataFrame(facts, "case_id string, host string, fact_ord long, fact_id string, entity_refs array<struct<type: string, value: string>>"))
    s = snapshots.save(f, str(tmp_path / "s"))
    told = ["fact_ord", "fact_id"]
    assert rows(s.facts().select(told)) == rows(s.entities().select(told)) == rows(f.select(told))


def test_files_hold_ids_without_their_numbers(spark, tmp_path):
    """Ids that follow from the places of a source take no room, those of facts that were appended behind others included."""
    path, f = str(tmp_path / "s"), demo.events(spark, SF)
    snapshots.save(f, path)
    s = snapshots.append(f, path)
    for kind in ("facts", "entities"):
        kept = spark.read.parquet(*s.files(kind))
        assert {r[0] for r in kept.select("fact_id").distinct().collect()} == {"Events_"}
        assert kept.select("case_id", "id_more").distinct().count() == 2 * f.select("case_id").distinct().count()
    assert rows(s.facts().select("fact_id")) == rows(f.unionByName(f).select("fact_id"))


def test_parts_of_an_earlier_release_are_read(spark, tmp_path, monkeypatch):
    """Their files have whole ids and no id_more."""
    s = snapshots.save(demo.events(spark, SF), str(tmp_path / "s"))
    want = rows(s.facts()), rows(s.entities())
    base = f"{s.path}/parts/{s.parts[0]}"
    for kind, schema in (("facts", snapshots.FACT_ROWS), ("entities", snapshots.INDEX_ROWS)):
        old = snapshots.whole_ids(spark.read.schema(schema).parquet(f"{base}/{kind}")).drop("id_more")
        old.write.parquet(f"{tmp_path}/{kind}")
    monkeypatch.setattr(snapshots.Snapshot, "_read", lambda self, kind, schema: self.spark.read.schema(schema).parquet(f"{tmp_path}/{kind}"))
    assert (rows(s.facts()), rows(s.entities())) == want
