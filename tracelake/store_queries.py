"""Registered queries of the versioned store and its entity index: the driver's tables are saved and appended as facts, then asked by key, time and version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import demo, model
from .evidence_queries import _E, facts_by_second
from .operators import graph, pivot
from .queries import _ENTS
from .queries import SQL as _SQL
from .queries import _pivoted, stamp
from .session import checkpoint_dir
from .sources import snapshots
from .streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def kept(spark: SparkSession, name: str, *commits: DataFrame) -> snapshots.Snapshot:
    """A new store of facts, saved and then appended."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    first, *more = commits
    s = snapshots.save(first, path)
    for facts in more:
        s = snapshots.append(facts, path)
    return s


@query(_SQL["entity_search"])
def indexed_entity_search(spark, sf_dir):
    """A key's facts from the index, of three commits"""
    s = kept(spark, "search", demo.orders(spark, sf_dir), demo.events(spark, sf_dir), demo.lines(spark, sf_dir))
    return pivot.search(s.entities(["customer:1"]), "customer:1").select("host", "fact_ord", "source", "action", stamp("time").alias("time"))


@query(_SQL["entity_search_many"])
def indexed_search_many(spark, sf_dir):
    """J01 for a table of seeds, from the index"""
    s = kept(spark, "seeds", demo.lines(spark, sf_dir))
    seeds = demo.read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("entity_key"))
    return s.entities(seeds).groupBy("entity_key").agg(F.count("*").alias("facts"))


@query(_SQL["related_entities"])
def indexed_related(spark, sf_dir):
    """Entities that share facts with a seed, from the seed's rows of the index"""
    s = kept(spark, "related", demo.lines(spark, sf_dir))
    return _pivoted(pivot.related(s.entities(["part:1"]), "part:1"))


@query(_SQL["graph_two_hops"])
def indexed_two_hops(spark, sf_dir):
    """Each hop reads the files of the index that hold its keys"""
    s = kept(spark, "hops", demo.lines(spark, sf_dir))
    n, _ = graph.expand(s.entities, "supplier:1", 2)
    return n.select("entity_key", "depth")


@query(f"""WITH {_ENTS} SELECT key AS entity_key FROM en GROUP BY key HAVING count(*) >= 0.02 * (SELECT count(*) FROM en)""")
def frequent_keys(spark, sf_dir):
    """The keys of a fiftieth of all references or more, by the merged sketches of the commits"""
    s = kept(spark, "frequent", demo.orders(spark, sf_dir), demo.events(spark, sf_dir), demo.lines(spark, sf_dir))
    total = s.zones().where("kind = 'entities'").agg(F.sum("rows")).first()[0]
    return s.frequent(int(0.02 * total)).select("entity_key")


@query(f"""{_E} SELECT i AS event_id FROM e WHERE tm::TIMESTAMP BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04'""")
def pruned_time_range(spark, sf_dir):
    """A time range from the files whose zones meet it"""
    start, end = "2024-01-03 00:00:00", "2024-01-04 00:00:00"
    s = kept(spark, "range", facts_by_second(spark, sf_dir))
    return pivot.in_range(s.facts(start, end), start, end).select(F.col("fact_ord").alias("event_id"))


@query(f"""{_E}, v AS (SELECT 1 AS version, h, t FROM e WHERE t IN ('click', 'view') UNION ALL SELECT 2, h, t FROM e UNION ALL SELECT 3, h, t FROM e UNION ALL SELECT 4, h, t FROM e WHERE t = 'error')
SELECT version, h AS host, count(*) AS facts, count(DISTINCT t) AS actions FROM v GROUP BY 1, 2""")
def store_versions(spark, sf_dir):
    """What readers of each version see after a save, an append, a compaction and a save that replaces all"""
    f = demo.events(spark, sf_dir)
    early = F.col("action").isin("click", "view")
    path = kept(spark, "versions", f.where(early), f.where(~early)).path
    snapshots.compact(spark, path, small=1 << 40)
    snapshots.save(f.where("action = 'error'"), path)
    out = None
    for v in (1, 2, 3, 4):
        one = snapshots.load(spark, path, v).groupBy("host").agg(F.count("*").alias("facts"), F.count_distinct("action").alias("actions")).select(F.lit(v).alias("version"), "host", "facts", "actions")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{_E} SELECT h AS host, t AS action, count(*) AS facts, count(DISTINCT i) AS places FROM e GROUP BY ALL")
def stream_store(spark, sf_dir):
    """The events read as a stream, appended to a store batch by batch, and loaded"""
    folder = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    f = demo.events(spark, sf_dir)
    f.repartition(3).write.option("parquet.block.size", str(1 << 20)).parquet(f"{folder}/in")  # a batch is one file, which several tasks can read
    live.append_facts(spark, f"{folder}/in", f.schema, lambda d: d, f"{folder}/store", f"{folder}/checkpoint", maxFilesPerTrigger="1").awaitTermination()
    return snapshots.load(spark, f"{folder}/store").groupBy("host", "action").agg(F.count("*").alias("facts"), F.count_distinct("fact_id").alias("places"))


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The events as facts on a stream of six batches in random order, every fact twice."""
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    f = demo.events(spark, sf_dir)
    f.unionByName(f).repartition(6, F.rand(7)).write.parquet(folder)
    return spark.readStream.schema(f.schema).option("maxFilesPerTrigger", "1").parquet(folder)


@query(f"{_E} SELECT h AS host, t AS action, count(*) AS facts, count(DISTINCT i) AS places FROM e GROUP BY ALL")
def stream_once(spark, sf_dir):
    """Facts that arrive twice, in any order and batch, are taken once"""
    with live.keeping(spark):
        f = live.completed(live.once(arriving(spark, sf_dir, "twice"), "case_id", "fact_id"), "stream_once")
    return f.groupBy("host", "action").agg(F.count("*").alias("facts"), F.count_distinct("fact_ord").alias("places"))


@query(f"""WITH {_ENTS} SELECT key AS entity_key, 1 AS told, 2 AS hosts FROM en WHERE source = 'Events' GROUP BY key HAVING count(DISTINCT host) > 1""")
def stream_second_hosts(spark, sf_dir):
    """Each entity is told once, when its second host arrives, across batches in any order"""
    with live.keeping(spark):
        s = live.completed(live.second_hosts(model.fact_entities(arriving(spark, sf_dir, "shuffled"))), "stream_second_hosts")
    return s.groupBy("entity_key").agg(F.count("*").alias("told"), F.max(F.size(F.array_distinct("hosts"))).cast("long").alias("hosts"))
