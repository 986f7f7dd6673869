"""The stream reads its table as one file or as a folder of part files."""

import os
import time

from tracelake import queries
from tracelake.streaming import live

SF = "/root/testdata/sf0.001"


def test_stream_of_a_folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got, want = (sorted(map(tuple, queries.stream_shared(spark, d).collect())) for d in (str(tmp_path), SF))
    assert got and got == want
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert any(os.path.isdir(f"{shared}/{d}/checkpoint/state") for d in os.listdir(shared) if d.startswith("stream_shared-"))


def test_stream_of_nothing(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert queries.stream_shared(spark, str(tmp_path)).count() == 0


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, "entity_key string, host string, n int").coalesce(1).write.mode("append").parquet(folder)


def told(spark, tmp_path):
    rows = spark.readStream.schema("entity_key string, host string, n int").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    with live.keeping(spark):
        return live.completed(live.second_hosts(rows), "second", folder=f"file://{tmp_path}/out")


def test_second_hosts_are_told_once_across_restarts(spark, tmp_path):
    arrive(spark, f"{tmp_path}/in", [("a", "H1", 1), ("a", "h1", 2), ("b", "H1", 3), (None, "H1", 4), ("c", None, 5)])
    arrive(spark, f"{tmp_path}/in", [("b", "H1", 6), ("d", "H3", 7), ("d", "H2", 8), ("d", "H1", 9)])
    one = sorted(map(tuple, told(spark, tmp_path).select("entity_key", "hosts").collect()))
    assert [k for k, _ in one] == ["d"] and len(one[0][1]) == 2
    arrive(spark, f"{tmp_path}/in", [("a", "H2", 10), ("d", "H9", 11), ("c", "H1", 12)])
    arrive(spark, f"{tmp_path}/in", [("a", "H3", 13), ("b", "h1", 14), ("c", "H2", 15)])
    two = told(spark, tmp_path).select("entity_key", "hosts").orderBy("entity_key").collect()
    assert [tuple(r) for r in two if r[0] != "d"] == [("a", ["h1", "h2"]), ("c", ["h1", "h2"])] and len(two) == 3


def test_once_keeps_the_first_of_repeated_rows(spark, tmp_path):
    for rows in ([("a", "x", 1), ("b", "x", 2)], [("a", "late", 3), ("c", None, 4)], [("b", "late", 5), (None, "x", 6), (None, "y", 7)]):
        arrive(spark, f"{tmp_path}/in", rows)
    rows = spark.readStream.schema("entity_key string, host string, n int").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    with live.keeping(spark):
        got = live.completed(live.once(rows, "entity_key"), "once").orderBy("n").collect()
    keys = [r["entity_key"] for r in got]
    assert sorted(k or "" for k in keys) == ["", "a", "b", "c"]


def test_once_forgets_after_its_bound(spark, tmp_path):
    source = f"{tmp_path}/in"
    arrive(spark, source, [("a", "x", 1)])
    rows = spark.readStream.schema("entity_key string, host string, n int").parquet(source)
    out, seen = f"{tmp_path}/out", lambda: sorted(r["n"] for r in spark.read.schema(rows.schema).parquet(out).collect()) if os.path.isdir(out) else []
    with live.keeping(spark):
        q = live.once(rows, "entity_key", hours=4 / 3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint").start()
    try:
        for wanted, n in (([1], 2), ([1, 2], None)):
            end = time.time() + 60
            while seen() != wanted and time.time() < end:
                time.sleep(0.5)
            assert seen() == wanted
            if n:
                time.sleep(5)
                arrive(spark, source, [("a", "x", n)])
    finally:
        q.stop()
