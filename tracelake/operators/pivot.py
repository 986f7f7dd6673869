"""Questions over fact_entities: search, shared, temporal and related entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..model import ROW, exploded, fact_entities

LIMIT = 250
#: Entity types that are pivoted by default.
TYPES = ("Path", "Hash", "User", "IP", "AppId")


def options(df: DataFrame, source: str | None = None, confidence: str | None = None, start=None, end=None) -> DataFrame:
    """Source prefix, exact confidence, inclusive time range in either order; a bound asks for a usable time."""
    if source:
        df = df.where(F.lower("source").startswith(source.lower()))
    if confidence:
        df = df.where(F.lower("time_confidence") == confidence.lower())
    if start is not None or end is not None:
        lo, hi = (F.lit(x).cast("timestamp") for x in (start, end))
        lo, hi = F.when(lo > hi, hi).otherwise(lo), F.when(lo > hi, lo).otherwise(hi)
        df = df.where(X.usable(F.col("time")) & F.coalesce(F.col("time") >= lo, F.lit(start is None)) & F.coalesce(F.col("time") <= hi, F.lit(end is None)))
    return df


def on_hosts(df: DataFrame, part: str | None) -> DataFrame:
    """P02"""
    return df.where(F.lower("host").contains(part.strip().lower())) if part and part.strip() else df


def of_type(entities: DataFrame, kind: str, part: str | None = None) -> DataFrame:
    """Entities of a type whose spelling has the part. Ledger: each host's first spelling is tested, so one host may drop out."""
    e = entities.where(F.lower("entity_type") == kind.lower())
    if not part:
        return e
    shown = e.groupBy("host", "entity_key").agg(F.min_by("value_display", "fact_ord").alias("shown")).where(F.lower("shown").contains(part.lower()))
    return e.join(shown.select("host", "entity_key"), ["host", "entity_key"], "left_semi")


def in_range(facts: DataFrame, start, end) -> DataFrame:
    """P04"""
    return facts.where(F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy(F.desc("time"), "case_id", "fact_ord")


def search(entities: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Facts that name an entity: host, timed first, newest first, source, action."""
    hits = entities.where(F.col("entity_key") == key.lower())
    out = hits.orderBy("host", X.usable(F.col("time")).desc(), F.desc("time"), "source", "action", "fact_ord")
    return out.limit(most) if most else out


#: Keys that are looked for within the facts' own arrays; more are left to joins behind the explode.
KEYS = 2_000


def rows_of(facts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A lookup without an index: from seeds (entity_key) to the entity rows of facts that name one, filtered before references are exploded."""

    def of(seeds: DataFrame) -> DataFrame:
        keys = [r[0] for r in seeds.select("entity_key").distinct().limit(KEYS + 1).collect()]
        return fact_entities(facts, keys if len(keys) <= KEYS else None)

    return of


def search_many(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """J01 for a table of seeds (entity_key)."""
    return entities.join(seeds.select(F.lower("entity_key").alias("entity_key")).distinct(), "entity_key", "left_semi")


def grouped(df: DataFrame, *by: str) -> DataFrame:
    """What is said of an entity in each group `by`, counted up before anything else is asked.

    The first step takes plain counts and least and greatest numbers of each host, case, source, action and
    spelling, which tasks add up before they shuffle; so a very common entity comes to few rows. These are
    dealt by the group once, and both later steps (each host, then all hosts) find them in place.
    W04, display: each host's first spelling; of those the longest, a tie going to the earlier case.
    """
    timed = F.when(X.usable(F.col("time")), F.col("time"))
    one = df.groupBy(*by, "host", "case_id", "source", "action", "entity_type", "value_display").agg(
        F.count("*").alias("n"), F.min("fact_ord").alias("ord"), F.min(timed).alias("first"), F.max(timed).alias("last"),
        F.min(F.when(F.col("time").isNotNull(), F.col("fact_ord"))).alias("ord_timed"),
    )
    met = F.struct("host", F.col("ord_timed").isNull(), F.coalesce("ord_timed", "ord"))
    host = one.repartition(*by).groupBy(*by, "host").agg(
        F.sum("n").alias("n"), F.collect_set("source").alias("sources"), F.collect_set("action").alias("actions"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("case_id").alias("case_id"),
        F.min_by("value_display", F.struct("case_id", "ord")).alias("spelling"), F.min(F.struct(met, "value_display")).alias("met"),
        F.min(F.struct("case_id", "ord", "entity_type")).alias("typed"), F.max(F.struct(F.length("value_display"), "value_display")).alias("long"),
    )
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    g = host.groupBy(*by).agg(
        F.sum("n").alias("facts"), F.array_sort(F.collect_set("host")).alias("host_list"), merged("sources").alias("sources"), merged("actions").alias("actions"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.min_by("spelling", F.struct(-F.length("spelling"), F.col("case_id"), F.col("host"))).alias("display"),
        F.min("met").alias("met"), F.min("typed").alias("typed"), F.max("long").alias("long"),
    )
    hosts = F.size(F.array_distinct(F.transform("host_list", lambda h: F.lower(h))))
    return g.withColumns({"hosts": hosts, "met": F.col("met.value_display"), "type_met": F.col("typed.entity_type"), "longest": F.col("long.value_display")}).drop("typed", "long")


def _top(df: DataFrame, order: list[Column], most: int | None, per: tuple[str, ...] = ("entity_type",)) -> DataFrame:
    if most is None:
        return df
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("rank") <= most)


def _typed(g: DataFrame) -> DataFrame:
    return g.withColumn("entity_type", F.substring_index("entity_key", ":", 1))


SEEN = ("hosts", "facts", "host_list", "sources", "first_seen", "last_seen")


def shared(entities: DataFrame, types=TYPES, least: int = 2, most: int | None = LIMIT) -> DataFrame:
    """Entities on several hosts, all types in one grouping, the limit taken for each type."""
    e = entities.where(F.lower("entity_type").isin(*(t.lower() for t in types)))
    g = _typed(grouped(e, "entity_key").where(F.col("hosts") >= least).select("entity_key", *SEEN, "display"))
    return first_shared(g, most)


def first_shared(g: DataFrame, most: int | None = LIMIT) -> DataFrame:
    """The first of shared(most=None), for each type."""
    return _top(g, [F.desc("hosts"), F.desc("facts"), F.lower("display"), F.col("entity_key")], most)


def readiness(facts: DataFrame, cases: DataFrame | None = None) -> dict[str, DataFrame]:
    """ready_hosts, cases with an entity to pivot on, and skipped_hosts, the others of all cases taken in; each a one-row frame."""
    named = facts.where(F.exists("entity_refs", lambda r: ~X.blank(r["value"]))).select("case_id").distinct()
    every = (facts if cases is None else cases).select("case_id").distinct()
    skipped = every.join(named, "case_id", "left_anti")
    return {"ready_hosts": named.agg(F.count("*").alias("n")), "skipped_hosts": skipped.agg(F.count("*").alias("n"))}


def temporal(entities: DataFrame, minutes: int, types=TYPES, least: int = 2, most: int | None = LIMIT) -> DataFrame:
    """As shared(), within each time bucket; usable times only."""
    e = entities.where(F.lower("entity_type").isin(*(t.lower() for t in types)) & X.usable(F.col("time"))).withColumn("bucket", X.bucket_start(F.col("time"), minutes))
    g = _typed(grouped(e, "entity_key", "bucket").where(F.col("hosts") >= least).select("entity_key", "bucket", *SEEN, "display"))
    return first_temporal(g.withColumn("bucket_end", X.bucket_end(F.col("bucket"), minutes)), most)


def first_temporal(g: DataFrame, most: int | None = LIMIT) -> DataFrame:
    """The first of temporal(most=None), for each type."""
    return _top(g, [F.desc("hosts"), F.desc("facts"), F.desc("bucket"), F.lower("display"), F.col("entity_key")], most)


def neighbours(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, and the other entities of each fact that names it). seeds: (entity_key).

    Each row of entities carries what else its fact names, so rows are filtered by the seeds and nothing else is joined.
    Whether the seeds are broadcast is left to Spark, which knows their size.
    """
    s = seeds.select(F.lower("entity_key").alias("seed")).distinct()
    hit = entities.join(s, F.col("entity_key") == F.col("seed")).select("seed", *ROW, "entity_refs", "ref_keys")
    return exploded(hit).where("entity_key <> seed").drop("entity_refs", "ref_keys")


def related(entities: DataFrame, seed: str, most: int | None = LIMIT) -> DataFrame:
    """Entities that share facts with the seed, longest spelling."""
    n = neighbours(entities, entities.sparkSession.createDataFrame([(seed,)], "entity_key string"))
    g = _typed(grouped(n, "entity_key").select("entity_key", *SEEN, F.col("longest").alias("display")))
    return _top(g, [F.desc("hosts"), F.desc("facts"), F.col("entity_type"), F.lower("display"), F.col("entity_key")], most, ())


def edges(entities: DataFrame, seeds: DataFrame, fan_out: int | None = LIMIT) -> DataFrame:
    """Edges from each seed with actions and the first spelling met; the fan-out is taken for each seed."""
    g = grouped(neighbours(entities, seeds), "seed", "entity_key")
    g = g.select("seed", "entity_key", *SEEN, "actions", F.col("met").alias("display"), F.col("type_met").alias("entity_type"))
    return _top(g, [F.desc("hosts"), F.desc("facts"), F.col("entity_type"), F.lower("display"), F.col("entity_key")], fan_out, ("seed",))


def edge_facts(entities: DataFrame, edge: DataFrame, only_hosts: bool = True) -> DataFrame:
    """Facts of the edges' targets (entity_key, host_list), on the edges' hosts."""
    wanted = edge.select("entity_key", F.explode("host_list").alias("host")).distinct()
    return entities.join(wanted, ["entity_key", "host"] if only_hosts else ["entity_key"], "left_semi")


def bucket_facts(entities: DataFrame, key: str, bucket, minutes: int) -> DataFrame:
    """Facts of an entity from a bucket's start to its end."""
    lo = F.lit(bucket).cast("timestamp")
    return search(entities.where(F.col("time").between(lo, X.bucket_end(lo, minutes))), key)


def source_counts(facts: DataFrame, unknown: str = "Unknown") -> DataFrame:
    """A05"""
    return facts.groupBy(F.when(X.blank(F.col("source")), unknown).otherwise(F.col("source")).alias("source")).agg(F.count("*").alias("facts"))


def type_counts(facts: DataFrame) -> DataFrame:
    """References by type; one that a fact names twice counts twice."""
    return facts.select(F.explode("entity_refs").alias("r")).where(~X.blank(F.col("r.value"))).groupBy(F.col("r.type").alias("entity_type")).agg(F.count("*").alias("refs"))


def common_names(files: DataFrame) -> DataFrame:
    """Names (case_id, host, name) in several cases; cases are counted once for each spelling whatever its case within them, names are grouped as spelled.

    Repeated rows go first, by hash: the least of texts is found by sorting, which else holds every row of a task. They are
    counted, since Spark leaves out a distinct() below an aggregate that gives the same without it.
    """
    once = files.where(~X.blank(F.col("name"))).groupBy("case_id", "host", "name").agg(F.count("*").alias("n")).where("n > 0")
    one = once.groupBy("case_id", F.lower("name").alias("low")).agg(F.min("name").alias("name"), F.min("host").alias("host"))
    return one.groupBy("name").agg(F.count("*").alias("cases"), F.array_sort(F.collect_list("host")).alias("hosts")).where("cases > 1")


def host_summaries(facts: DataFrame, cases: DataFrame) -> DataFrame:
    """A16"""
    per = facts.groupBy("case_id", "source").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.sum("n").alias("facts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("by_source"))
    return cases.join(per, "case_id", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))
