"""The driver's tables seen as evidence: facts and artifact rows derived from them, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import conform


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its times, which have no zone, are taken in the session's."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def _refs(**values):
    return F.array(*(F.struct(F.lit(k).alias("type"), v.cast("string").alias("value")) for k, v in values.items()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each event; hosts are five, users stay on one, keys are seen on many."""
    e = read(spark, sf_dir, "events").withColumn("host", F.concat(F.lit("H"), (F.col("user_id") % 5).cast("string")))
    key = F.get_json_object("props", "$.k")
    return conform(e.select(F.col("host").alias("case_id"), "host", F.col("event_id").alias("fact_ord"), F.concat(F.lit("Events_"), "event_id").alias("fact_id"), F.col("ts").alias("time"), F.lit("Events").alias("source"), F.col("event_type").alias("action"), _refs(User=F.col("user_id"), Key=key, EventType=F.col("event_type")).alias("entity_refs"), F.lit(False).alias("fallback_used")))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, o_custkey, o_orderdate, o_orderstatus, o_orderpriority, n_name) of every order."""
    o = read(spark, sf_dir, "orders")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = nations(spark, sf_dir)
    return conform(o.select(F.col("n_name").alias("case_id"), F.col("n_name").alias("host"), F.col("o_orderkey").alias("fact_ord"), F.concat(F.lit("Orders_"), "o_orderkey").alias("fact_id"), F.col("o_orderdate").alias("time"), F.lit("Orders").alias("source"), F.col("o_orderstatus").alias("action"), _refs(Customer=F.col("o_custkey"), Priority=F.col("o_orderpriority")).alias("entity_refs"), F.lit(False).alias("fallback_used")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No columns of a line are its key, so its place is 60 bits of a hash of all that tells lines apart.
    cents = lambda c: F.floor(F.col(c) * 100 + 0.5)
    parts = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    parts += [cents(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [F.unix_seconds("l_shipdate")]
    place = F.conv(F.left(F.md5(F.concat_ws("/", *parts).cast("binary")), F.lit(15)), 16, 10).cast("long")
    # It is worked out before the join, which then shuffles it and not what it is made of.
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", place.alias("place"))
    li = li.join(nations(spark, sf_dir).select("o_orderkey", "n_name"), F.col("l_orderkey") == F.col("o_orderkey"))
    return conform(li.select(F.col("n_name").alias("case_id"), F.col("n_name").alias("host"), F.col("place").alias("fact_ord"), F.concat(F.lit("LineItem_"), "place").alias("fact_id"), F.col("l_shipdate").alias("time"), F.lit("LineItem").alias("source"), F.col("l_returnflag").alias("action"), _refs(Part=F.col("l_partkey"), Supplier=F.col("l_suppkey"), Order=F.col("l_orderkey")).alias("entity_refs"), F.lit(False).alias("fallback_used")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).unionByName(orders(spark, sf_dir)).unionByName(lines(spark, sf_dir))


def artifact(rows: DataFrame, name: str, host, order, **values) -> DataFrame:
    """Rows as an artifact table gives them: file, host, i, f."""
    m = F.map_from_arrays(F.array(*(F.lit(k.lower()) for k in values)), F.array(*(v.cast("string") for v in values.values())))
    return rows.select(F.lit(f"/x/{name}").alias("file"), host.alias("host"), order.cast("long").alias("i"), m.alias("f"))
