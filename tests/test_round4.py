"""Findings of round 3: queries over tables that the given ones have no case of, against their SQL."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tracelake import queries


def same(spark, tmp_path, query, **tables):
    """The rows of a query over small tables, after a look at what its SQL gives."""
    con = duckdb.connect()
    for name, rows in tables.items():
        pq.write_table(rows, f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as from '{tmp_path}/{name}.parquet'")
    got = queries.QUERIES[query](spark, str(tmp_path)).toPandas()
    want = con.sql(queries.SQL[query]).df()
    order = lambda df: sorted(map(tuple, df[sorted(want.columns)].astype(str).values.tolist()))
    assert order(got) == order(want)
    return got


def events(rows):
    """rows: (event_id, time, type, key)"""
    return pa.table({
        "event_id": pa.array([r[0] for r in rows], pa.int64()), "ts": pa.array([r[1] for r in rows], pa.timestamp("us")), "user_id": pa.array([r[0] % 7 for r in rows], pa.int64()),
        "event_type": [r[2] for r in rows], "value": [1.0] * len(rows), "props": ['{"k": %s}' % r[3] for r in rows],
    })


def test_bucket_ends_with_its_last_second(spark, tmp_path):
    at = dt.datetime(2024, 1, 10, 12, 30, 0, 400_000)
    got = same(spark, tmp_path, "bucket_drill_down", events=events([(1, at, "click", 7), (2, at.replace(second=1), "click", 7), (3, at.replace(minute=0), "click", 7)]))
    assert sorted(got["fact_ord"]) == [1, 3]


@pytest.mark.parametrize("query", ["time_range", "pruned_time_range"])
def test_range_ends_with_its_last_second(spark, tmp_path, query):
    at = dt.datetime(2024, 1, 4, 0, 0, 0, 400_000)
    assert len(same(spark, tmp_path, query, events=events([(1, at, "view", 7), (2, at.replace(second=1), "view", 7)]))) == 1


def test_view_takes_facts_of_one_second_by_place(spark, tmp_path):
    at = dt.datetime(2024, 1, 10, 12)
    got = same(spark, tmp_path, "facts_view", events=events([(i, at.replace(microsecond=1000 * i), "view", 7) for i in range(1, 60)]))
    assert len(got) == 40


def test_sign_of_a_balance_of_minus_zero(spark, tmp_path):
    names = [f"Customer#{i:09d}" for i in range(4)]
    c = pa.table({"c_custkey": pa.array(range(4), pa.int64()), "c_name": names, "c_nationkey": pa.array([0] * 4, pa.int32()), "c_acctbal": [-0.0, 0.0, -1.5, 2.0], "c_mktsegment": [""] * 4})
    assert list(same(spark, tmp_path, "text_functions", customer=c).sort_values("c_custkey")["cell"]) == ["'x", "x", "'x", "x"]


def test_an_events_data_are_parsed_once(spark):
    from pyspark.sql import functions as F

    from tracelake.operators import timeline

    row = spark.range(1).select(F.lit("1").alias("i"), F.lit("m").alias("m"), F.concat(F.lit("A="), F.col("id").cast("string")).alias("d"))
    for c in (timeline.event_indicator(F.col("i"), F.lit("p"), F.col("m"), F.col("d")), timeline.sample_text(F.col("i"), F.col("m"), F.col("d"))):
        assert row.select(c).columns and str(c).count("split(") == 1


def test_once_for_good_calls_no_python(spark, tmp_path):
    from tracelake.streaming import live

    spark.range(4).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    with live.keeping(spark):
        once = live.once(rows, "id")
        assert "InPandas" not in once._jdf.queryExecution().analyzed().toString()
        assert live.completed(once, "once").count() == 4


def test_blocks_of_a_file_that_is_read_in_splits(spark, tmp_path):
    from tracelake.sources import tables

    with open(f"{tmp_path}/kerberos_tickets.txt", "w") as f:
        f.write("observedatutc: 2024-01-01 00:00:00\n" + "".join(f"#{i}>     Client: u{i} @ CORP\r\n        Server: cifs/s{i}\r\n\r\n" for i in range(300)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "1000")
        b = tables.kerberos(spark, str(tmp_path))
        assert "wholetext" not in b._jdf.queryExecution().toString().lower() and "Window" in b._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r["block"], r["observed"], r["f"]["client"], r["f"]["server"]) for r in b.collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == [(i, "2024-01-01 00:00:00", f"u{i} @ CORP", f"cifs/s{i}") for i in range(300)]


def test_index_holds_no_column_that_follows_from_others(spark, tmp_path):
    from tracelake import demo, model
    from tracelake.sources import snapshots

    f = demo.events(spark, "/root/testdata/sf0.001")
    s = snapshots.save(f, f"{tmp_path}/store")
    assert spark.read.parquet(*s.files("entities")).columns == snapshots.INDEX_ROWS.names
    assert not {"ref_keys", "value_norm", "value_display", "entity_type"} & set(snapshots.INDEX_ROWS.names)
    rows = lambda e: sorted(map(str, e.select(*snapshots.ENTITY_ROWS.names).collect()))
    assert rows(s.entities(["key:7"])) == rows(model.fact_entities(f).where("entity_key = 'key:7'"))


def test_credential_pairs_are_not_grouped_again(spark, tmp_path):
    from tracelake.operators import hunt

    at = dt.datetime(2024, 1, 10)
    got = same(spark, tmp_path, "credential_pairs", events=events([(i, at, "signup" if i % 2 else "purchase", i % 3) for i in range(210)]))
    assert got["shared"].str.contains(",").any() and not got.duplicated(["case_id", "credential", "remote"]).any()
    f = queries._credentials(spark, str(tmp_path))
    plan = hunt.credential_pairs(f)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
