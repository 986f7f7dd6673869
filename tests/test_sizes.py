"""What findings of round 3 say of large tables: steps whose cost must not grow with more than their input."""

import re

from pyspark.sql import functions as F

from tracelake import record_queries
from tracelake.functions import expr as X
from tracelake.operators import pivot

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_common_names_sorts_no_repeated_rows(spark):
    rows = [("A", "h1", "x.exe"), ("A", "h1", "x.exe"), ("A", "h1", "X.exe"), ("B", "h2", "x.exe"), ("B", "h2", " "), ("B", "h2", None), ("C", "h3", "X.exe"), ("A", "h0", "y"), ("A", "h1", "y")]
    g = pivot.common_names(spark.createDataFrame(rows * 50, "case_id string, host string, name string"))
    assert sorted(tuple(r) for r in g.select("name", "cases", F.array_join("hosts", ",")).collect()) == [("X.exe", 2, "h1,h3")]
    lowest = re.findall(r"(\w*Aggregate)\(", planned(g))[-1]
    assert lowest == "HashAggregate"


def test_records_parse_a_time_once_a_row(spark):
    plan = planned(record_queries.records_of_programs(spark, SF))
    assert plan.count("gettimestamp(") <= 10 * len(X.TIME_FORMATS)  # eight times, of which filters may repeat some


def test_times_are_parsed_as_by_trying_every_format(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02t03:04:05.123", "2024-01-02T03:04:05.1234567+02:00", "2024-01-02 03:04:05", " 2024-01-02 03:04:05.123456 ", "2024/1/2 3:04:05", "2024/1/2 3:04", "1/2/2024 3:04:05", "1/2/2024 3:04:05 pm", "1/2/2024",
             "2024-01-02", "", " ", None, "n/a", "a/b c:d", "2024", "-5", "2024-13-45", "2024-01-02 03:04", "T", "12024-01-02", "+12024-01-02 03:04:05", "2024-01-02  03:04:05", "1/2/2024 3:04:05 PM", "x 1/2/2024"]
    s = F.trim("s")
    plain = F.coalesce(*(F.try_to_timestamp(s, F.lit(f)) for f in X.TIME_FORMATS))
    local = ~s.rlike(r"(?:[Zz]|[+-]\d\d:?\d\d)$")
    want = F.when(F.length(s) == 0, None).when(local, F.to_utc_timestamp(plain, "Asia/Tokyo")).otherwise(plain)
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", X.parse_time(F.col("s"), "Asia/Tokyo").cast("string").alias("a"), want.cast("string").alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and sum(r["a"] is not None for r in got) >= 12
