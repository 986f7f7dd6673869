"""The versioned store: isolation of readers, conflicting writers, pruning by key and time, compaction, sketches."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracelake import demo, model
from tracelake.operators import graph, pivot
from tracelake.sources import snapshots

SF = "/root/testdata/sf0.001"
SMALL = {"per_file": (100, 300)}


@pytest.fixture(scope="module")
def facts(spark):
    f = demo.facts(spark, SF)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/facts-of-snapshots"
    f.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def store(spark, facts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    snapshots.save(facts.where("source <> 'Events'"), path, **SMALL)
    return snapshots.append(facts.where("source = 'Events'"), path, **SMALL)


def ids(df):
    return sorted((r["host"], r["fact_id"]) for r in df.select("host", "fact_id").collect())


def test_a_version_holds_what_was_committed(spark, facts, store):
    assert ids(store.facts()) == ids(facts)
    assert ids(snapshots.load(spark, store.path, 1)) == ids(facts.where("source <> 'Events'"))
    again = store.facts()
    assert again.select("case_id", "fact_ord").distinct().count() == again.count()
    cols = ["host", "fact_id", "entity_key", "value_display"]
    assert sorted(map(tuple, store.entities().select(cols).collect())) == sorted(map(tuple, model.fact_entities(facts).select(cols).collect()))


def test_lookups_open_only_files_that_hold_their_keys(spark, facts, store):
    all_files = store.files("entities")
    assert len(all_files) > 30
    for key in ("customer:7", "Part:12", "key:42", "eventtype:click", "no:such"):
        e = store.entities([key])
        want = model.fact_entities(facts).where(F.col("entity_key") == key.lower())
        assert ids(e) == ids(want)
        opened = e.inputFiles()
        assert len(opened) <= 3 or key == "eventtype:click" and len(opened) < 8, (key, len(opened))
    seeds = spark.createDataFrame([("Customer:7",), ("supplier:3",), (None,)], "entity_key string")
    assert len(store.entities(seeds).inputFiles()) <= 6
    assert ids(store.entities(seeds)) == ids(pivot.search_many(model.fact_entities(facts), seeds))


def test_more_seeds_than_are_matched_by_name(spark, facts, store, monkeypatch):
    seeds = facts.select(F.concat(F.lit("part:"), F.col("entity_refs")[0]["value"]).alias("entity_key")).where("entity_key IS NOT NULL")
    want = ids(store.entities(seeds))
    monkeypatch.setattr(snapshots, "KEYS", 5)
    assert want and ids(store.entities(seeds)) == want


def test_each_hop_reads_the_index(facts, store):
    read = []

    def rows(seeds):
        e = store.entities(seeds)
        read.append(len(e.inputFiles()))
        return e

    whole = graph.expand(model.fact_entities(facts), "supplier:1", 2, fan_out=5)
    for lookup in (rows, pivot.rows_of(facts)):
        found = graph.expand(lookup, "supplier:1", 2, fan_out=5)
        for a, b in zip(whole, found, strict=True):
            assert sorted(map(str, a.drop("place").collect())) == sorted(map(str, b.drop("place").collect()))
    assert len(read) == 2 and all(n <= 8 < len(store.files("entities")) / 4 for n in read)


def test_common_keys_are_reached_but_not_followed(spark, facts):
    e = model.fact_entities(facts.where("source = 'Events'"))
    common = spark.createDataFrame([("eventtype:click",), ("eventtype:view",), ("x:y",)], "entity_key string")
    n, g = graph.expand(e, "key:7", 2, common=common)
    followed = {r["seed"] for r in g.where("depth = 2").collect()}
    assert followed and not followed & {"eventtype:click", "eventtype:view"}
    assert {r["entity_key"] for r in graph.unfollowed(n, common, 2).collect()} == {"eventtype:click", "eventtype:view"}


def test_time_ranges_open_only_files_they_meet(facts, store):
    start, end = "2024-01-03 00:00:00", "2024-01-03 06:00:00"
    some = store.facts(start, end)
    want = facts.where(F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    assert ids(some) == ids(want) and want.count()
    assert 0 < len(some.inputFiles()) < len(store.files("facts")) / 5
    assert ids(store.facts(start=start)) == ids(facts.where(F.col("time") >= F.lit(start).cast("timestamp")))
    assert ids(store.facts(source="Orders")) == ids(facts.where("source = 'Orders'"))
    assert store.facts("1970-01-01", "1970-01-02").count() == 0


def test_a_commit_that_fails_half_way_changes_nothing(spark, facts, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    snapshots.save(facts.where("source = 'Orders'"), path)
    before = ids(snapshots.load(spark, path))
    held = snapshots.snapshot(spark, path)

    def torn(*_, **__):
        raise OSError("lost")

    monkeypatch.setattr(snapshots, "publish", torn)
    for act in (snapshots.save, snapshots.append):
        with pytest.raises(OSError):
            act(facts.where("source = 'Events'"), path)
        assert ids(snapshots.load(spark, path)) == before
    monkeypatch.undo()
    snapshots.save(facts.where("source = 'Events'"), path)  # a reader keeps the version it opened
    assert ids(held.facts()) == before != ids(snapshots.load(spark, path))
    assert snapshots.vacuum(spark, path) == 2 and snapshots.vacuum(spark, path, keep=1) == 1
    assert ids(snapshots.load(spark, path)) == ids(facts.where("source = 'Events'"))


def test_writers_in_each_others_way(spark, facts, tmp_path):
    path = str(tmp_path / "s")
    base = snapshots.save(facts.where("source = 'Orders'"), path)
    snapshots.publish(base, base.parts)
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(base, base.parts)
    some = facts.where("source = 'Events'")
    with ThreadPoolExecutor(3) as pool:  # appends start over until each is in
        list(pool.map(lambda k: snapshots.append(some.where(f"fact_ord % 3 = {k}"), path, tries=9), range(3)))
    out = snapshots.load(spark, path)
    assert ids(out) == ids(facts.where("source <> 'LineItem'"))
    assert out.select("case_id", "fact_ord").distinct().count() == out.count()


def test_compaction(spark, facts, tmp_path):
    path = str(tmp_path / "s")
    snapshots.save(facts.where("source = 'LineItem'"), path)
    for k in range(3):
        snapshots.append(facts.where(f"source = 'Events' AND fact_ord % 3 = {k}"), path)
    before = snapshots.snapshot(spark, path)
    after = snapshots.compact(spark, path, small=900)
    assert (len(before.parts), len(after.parts)) == (4, 2) and ids(after.facts()) == ids(before.facts()) == ids(before.facts())
    assert snapshots.compact(spark, path, small=900).version == after.version
    assert after.ends().collect() and sorted(map(tuple, after.ends().collect())) == sorted(map(tuple, before.ends().collect()))


def test_a_batch_of_a_stream_is_added_once(spark, facts, tmp_path):
    path, some = str(tmp_path / "s"), facts.where("source = 'Orders'").limit(9)
    for number, n in ((0, 9), (0, 9), (1, 18), (0, 18), (1, 18)):
        snapshots.append(some, path, ("a", number))
        assert snapshots.load(spark, path).count() == n
    snapshots.append(some, path, ("b", 0))
    assert snapshots.load(spark, path).count() == 27


def test_sketches_of_parts_merge(facts, store):
    want = {r["entity_key"]: r["n"] for r in model.fact_entities(facts).groupBy("entity_key").agg(F.count("*").alias("n")).collect()}
    got = {r["entity_key"]: r["facts"] for r in store.frequent(200).collect()}
    slack = 3.5 / snapshots.TRACKED * sum(want.values())
    assert got and all(abs(n - want[k]) <= slack for k, n in got.items())
    assert {k for k, n in want.items() if n >= 200 + slack} <= set(got)


def test_odd_stores(spark, facts, tmp_path):
    with pytest.raises(snapshots.StoreError):
        snapshots.load(spark, str(tmp_path / "none"))
    snapshots.save(facts.limit(0), str(tmp_path / "empty"))
    with pytest.raises(snapshots.StoreError):
        snapshots.load(spark, str(tmp_path / "empty"))
    empty = snapshots.snapshot(spark, str(tmp_path / "empty"))
    assert empty.facts().count() == 0 and empty.entities(["a:b"]).count() == 0 and empty.frequent(1).count() == 0
    snapshots.append(facts.limit(3).withColumn("time", F.lit(None).cast("timestamp")), str(tmp_path / "empty"))
    assert snapshots.load(spark, str(tmp_path / "empty")).count() == 3
    snapshots.save(facts.limit(3).withColumn("schema_version", F.lit(9)), str(tmp_path / "new"))
    with pytest.raises(snapshots.StoreError):
        snapshots.load(spark, str(tmp_path / "new"))
    with pytest.raises(snapshots.StoreError):
        snapshots.snapshot(spark, str(tmp_path / "new"), 7)
