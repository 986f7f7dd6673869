"""Registered queries of the evidence engine over the driver's tables, with the SQL that gives the same rows.

Arrays come out as sorted comma-joined strings and times as text, so that both engines hash alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import demo, model
from .functions import expr as X
from .operators import enrich, graph, hunt, normalize, pivot, quality, timeline
from .sources import store
from .streaming import live

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: str):
    return F.array_join(F.array_sort(F.col(c)), ",")


# The facts and entities in SQL.
_NATIONS = "SELECT o.*, n_name FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_CENTS = ", ".join(f"floor({c} * 100 + 0.5)::BIGINT" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
_PLACE = f"""('0x' || left(md5(concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CENTS}, epoch(l_shipdate)::BIGINT)), 15))::BIGINT"""
_EVENTS = "SELECT 'H' || (user_id % 5) AS host, event_id AS ord, ts AS time, 'Events' AS source, event_type AS action, user_id, json_extract_string(props, '$.k') AS k FROM events"
_FACTS = f"""ev AS ({_EVENTS}), od AS (SELECT n_name AS host, o_orderkey AS ord, o_orderdate AS time, 'Orders' AS source, o_orderstatus AS action, o_custkey, o_orderpriority FROM ({_NATIONS})),
li AS (SELECT n_name AS host, {_PLACE} AS ord, l_shipdate AS time, 'LineItem' AS source, l_returnflag AS action, l_partkey, l_suppkey, l_orderkey FROM lineitem JOIN ({_NATIONS}) ON l_orderkey = o_orderkey)"""
_ENTS = f"""{_FACTS},
en AS (SELECT host, ord, time, source, action, unnest(['user:' || user_id, 'key:' || k, 'eventtype:' || event_type]) AS key FROM (SELECT *, action AS event_type FROM ev)
UNION ALL SELECT host, ord, time, source, action, unnest(['customer:' || o_custkey, 'priority:' || lower(o_orderpriority)]) FROM od
UNION ALL SELECT host, ord, time, source, action, unnest(['part:' || l_partkey, 'supplier:' || l_suppkey, 'order:' || l_orderkey]) FROM li)"""
_AGG = "count(DISTINCT host) AS hosts, count(*) AS facts, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last_seen"
_TYPES = ("Part", "Supplier", "Key", "User", "Customer")
_IN = "('part', 'supplier', 'key', 'user', 'customer')"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.fact_entities(demo.facts(spark, sf_dir))


def _pivoted(df: DataFrame, *more: str) -> DataFrame:
    return df.select("entity_key", *more, F.col("hosts").cast("long"), "facts", joined("sources").alias("sources"), stamp("first_seen").alias("first_seen"), stamp("last_seen").alias("last_seen"))


@query(f"""WITH {_ENTS}, g AS (SELECT key AS entity_key, {_AGG} FROM en WHERE split_part(key, ':', 1) IN {_IN} GROUP BY key HAVING count(DISTINCT host) > 1)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY split_part(entity_key, ':', 1) ORDER BY hosts DESC, facts DESC, split_part(entity_key, ':', 2), entity_key) <= 250""")
def shared_entities(spark, sf_dir):
    """A01, T01"""
    return _pivoted(pivot.shared(entities(spark, sf_dir), _TYPES))


def _temporal_sql(b: int) -> str:
    return f"""WITH {_ENTS}, g AS (SELECT key AS entity_key, date_trunc('hour', time) + to_minutes(CAST(minute(time) // {b} * {b} AS INT)) AS b, {_AGG} FROM en WHERE split_part(key, ':', 1) IN ('eventtype', 'key') GROUP BY 1, 2 HAVING count(DISTINCT host) > 1),
t AS (SELECT *, row_number() OVER (PARTITION BY split_part(entity_key, ':', 1) ORDER BY hosts DESC, facts DESC, b DESC, split_part(entity_key, ':', 2), entity_key) AS r FROM g)
SELECT entity_key, strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, strftime(b + INTERVAL {b} MINUTE, '%Y-%m-%d %H:%M:%S') AS bucket_end, hosts, facts, sources, first_seen, last_seen FROM t WHERE r <= 250"""


def _temporal(spark, sf_dir, b):
    t = pivot.temporal(entities(spark, sf_dir), b, ("EventType", "Key"))
    return _pivoted(t.withColumns({"bucket": stamp("bucket"), "bucket_end": stamp("bucket_end")}), "bucket", "bucket_end")


@query(_temporal_sql(30))
def temporal_shared_30(spark, sf_dir):
    """A02, T02, F13"""
    return _temporal(spark, sf_dir, 30)


@query(_temporal_sql(25))
def temporal_shared_25(spark, sf_dir):
    """A02 with a bucket size that does not divide an hour"""
    return _temporal(spark, sf_dir, 25)


_RELATED = f"WITH {_ENTS}, f AS (SELECT DISTINCT host, ord, source FROM en WHERE key = 'part:1'), r AS (SELECT en.* FROM en JOIN f USING (host, ord, source) WHERE key <> 'part:1')"


@query(f"""{_RELATED} SELECT key AS entity_key, {_AGG} FROM r GROUP BY key
QUALIFY row_number() OVER (ORDER BY count(DISTINCT host) DESC, count(*) DESC, split_part(key, ':', 1), split_part(key, ':', 2), key) <= 250""")
def related_entities(spark, sf_dir):
    """J03, A03, T03"""
    return _pivoted(pivot.related(model.fact_entities(demo.lines(spark, sf_dir), ["part:1"]), "part:1"))


@query(f"""{_RELATED} SELECT 'part:1' AS seed, key AS entity_key, string_agg(DISTINCT action, ',' ORDER BY action) AS actions, count(DISTINCT host) AS hosts, count(*) AS facts FROM r GROUP BY key
QUALIFY row_number() OVER (ORDER BY count(DISTINCT host) DESC, count(*) DESC, split_part(key, ':', 1), split_part(key, ':', 2), key) <= 40""")
def graph_edges(spark, sf_dir):
    """A04, G01, W05"""
    e = pivot.edges(model.fact_entities(demo.lines(spark, sf_dir), ["part:1"]), spark.createDataFrame([("part:1",)], "entity_key string"), 40)
    return e.select("seed", "entity_key", joined("actions").alias("actions"), F.col("hosts").cast("long"), "facts")


@query(f"""WITH {_ENTS}, l AS (SELECT * FROM en WHERE source = 'LineItem'),
e1 AS (SELECT l2.key, count(DISTINCT l2.host) AS h, count(*) AS n FROM l JOIN l l2 USING (host, ord) WHERE l.key = 'supplier:1' AND l2.key <> 'supplier:1' GROUP BY 1),
r1 AS (SELECT *, row_number() OVER (ORDER BY h DESC, n DESC, split_part(key, ':', 1), split_part(key, ':', 2), key) AS place FROM e1 QUALIFY place <= 40),
e2 AS (SELECT r1.place, l2.key, count(DISTINCT l2.host) AS h, count(*) AS n FROM r1 JOIN l ON l.key = r1.key JOIN l l2 USING (host, ord) WHERE l2.key <> r1.key GROUP BY r1.place, r1.key, l2.key),
r2 AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY h DESC, n DESC, split_part(key, ':', 1), split_part(key, ':', 2), key) AS rank FROM e2 QUALIFY rank <= 40),
k2 AS (SELECT *, row_number() OVER (ORDER BY place, rank) AS o FROM r2 QUALIFY o <= 3000 - (SELECT count(*) FROM r1))
SELECT entity_key, min(depth)::INT AS depth FROM (SELECT 'supplier:1' AS entity_key, 0 AS depth UNION ALL SELECT key, 1 FROM r1 UNION ALL SELECT key, 2 FROM k2) GROUP BY 1""")
def graph_two_hops(spark, sf_dir):
    """G02"""
    n, _ = graph.expand(pivot.rows_of(demo.lines(spark, sf_dir)), "supplier:1", 2)
    return n.select("entity_key", "depth")


@query(f"WITH {_ENTS} SELECT host, ord AS fact_ord, source, action, strftime(time, '%Y-%m-%d %H:%M:%S') AS time FROM en WHERE key = 'customer:1'")
def entity_search(spark, sf_dir):
    """J01, J02"""
    return pivot.search(model.fact_entities(demo.facts(spark, sf_dir), ["customer:1"]), "customer:1").select("host", "fact_ord", "source", "action", stamp("time").alias("time"))


@query(f"WITH {_ENTS} SELECT key AS entity_key, count(*) AS facts FROM en WHERE key IN (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def entity_search_many(spark, sf_dir):
    """J01 for many seeds"""
    seeds = demo.read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("entity_key"))
    return pivot.search_many(entities(spark, sf_dir), seeds).groupBy("entity_key").agg(F.count("*").alias("facts"))


@query(f"""{_RELATED}, g AS (SELECT key, host FROM r), e AS (SELECT key FROM g GROUP BY key QUALIFY row_number() OVER (ORDER BY count(DISTINCT host) DESC, count(*) DESC, split_part(key, ':', 1), split_part(key, ':', 2), key) <= 5)
SELECT en.key AS entity_key, count(*) AS facts FROM en WHERE source = 'LineItem' AND (key, host) IN (SELECT key, host FROM g WHERE key IN (SELECT key FROM e)) GROUP BY 1""")
def edge_facts(spark, sf_dir):
    """J04, P11"""
    e = model.fact_entities(demo.lines(spark, sf_dir))
    top = pivot.edges(e, spark.createDataFrame([("part:1",)], "entity_key string"), 5)
    return pivot.edge_facts(e, top).groupBy("entity_key").agg(F.count("*").alias("facts"))


@query(f"WITH {_FACTS} SELECT source, count(*) AS facts FROM (SELECT source FROM ev UNION ALL SELECT source FROM od UNION ALL SELECT source FROM li) GROUP BY 1")
def source_counts(spark, sf_dir):
    """A05"""
    return pivot.source_counts(demo.facts(spark, sf_dir))


@query(f"""WITH {_ENTS} SELECT CASE split_part(key, ':', 1) WHEN 'eventtype' THEN 'EventType' ELSE upper(key[1]) || split_part(key, ':', 1)[2:] END AS entity_type, count(*) AS refs FROM en GROUP BY 1""")
def type_counts(spark, sf_dir):
    """A06"""
    return pivot.type_counts(demo.facts(spark, sf_dir))


@query(f"""WITH {_ENTS} SELECT key AS entity_key, host, source, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS facts FROM en
WHERE source = 'Events' AND split_part(key, ':', 1) = 'key' AND host LIKE '%H1%' AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY ALL""")
def pivot_options(spark, sf_dir):
    """P01, P02, P03, P13"""
    e = pivot.on_hosts(pivot.options(entities(spark, sf_dir), "event", None, "2024-01-20 00:00:00", "2024-01-05 00:00:00"), "h1")
    return pivot.of_type(e, "Key").groupBy("entity_key", "host", "source").agg(stamp(F.min("time")).alias("first_seen"), F.count("*").alias("facts"))


@query(f"""WITH ev AS ({_EVENTS}), i AS (SELECT host, time, lower(action) || '/' || k AS indicator FROM ev)
SELECT indicator, strftime(date_trunc('hour', time) + to_minutes(CAST(minute(time) // 5 * 5 AS INT)), '%Y-%m-%d %H:%M') AS bucket, count(DISTINCT host) AS hosts, count(*) AS events, 'Events' AS sources FROM i GROUP BY 1, 2 HAVING count(DISTINCT host) >= 2 ORDER BY 1, 2 LIMIT 200""")
def indicator_correlation(spark, sf_dir):
    """A08, F19"""
    e = demo.read(spark, sf_dir, "events")
    rows = e.select(F.concat(F.lit("H"), (F.col("user_id") % 5).cast("string")).alias("host"), F.col("ts").alias("time"), F.lit("Events").alias("source"), X.indicator(F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")), F.lit("")).alias("indicator"))
    g = timeline.indicators(rows)
    return g.select("indicator", "bucket", "hosts", "events", joined("sources").alias("sources"))


@query(f"""WITH c AS (SELECT DISTINCT n_name, p_name FROM lineitem JOIN ({_NATIONS}) ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT p_name AS name, count(*) AS cases, string_agg(n_name, ',' ORDER BY n_name) AS hosts FROM c GROUP BY 1 HAVING count(*) > 1""")
def common_names(spark, sf_dir):
    """A07"""
    n = demo.nations(spark, sf_dir).select("o_orderkey", "n_name")
    files = demo.read(spark, sf_dir, "lineitem").join(n, F.col("l_orderkey") == F.col("o_orderkey")).join(demo.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = pivot.common_names(files.select(F.col("n_name").alias("case_id"), F.col("n_name").alias("host"), F.col("p_name").alias("name")))
    return g.select("name", "cases", joined("hosts").alias("hosts"))


_LABELS = {"error": "Errors", "signup": "Sign-ups", "purchase": "Purchases"}


@query("""WITH l(place, kind, label) AS (VALUES (0, 'error', 'Errors'), (1, 'signup', 'Sign-ups'), (2, 'purchase', 'Purchases')),
e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events JOIN l ON event_type = kind)
SELECT place::INT AS place, kind, label, count(*) AS events, string_agg(CASE WHEN r <= 3 THEN user_id::VARCHAR END, ' || ' ORDER BY r) AS samples FROM e GROUP BY 1, 2, 3""")
def highlights(spark, sf_dir):
    """A09, W02"""
    return timeline.highlights(demo.read(spark, sf_dir, "events"), "event_type", "event_id", "user_id", _LABELS)


@query("""SELECT event_id, event_type, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r, max(ts) OVER (PARTITION BY event_type) AS m FROM events)
WHERE ts >= m - INTERVAL 3 DAY AND r <= 500""")
def anchored_recency(spark, sf_dir):
    """P08, W03"""
    return timeline.recent(demo.read(spark, sf_dir, "events"), "event_type", "ts", 3, 500, "event_id").select("event_id", "event_type", F.col("rank").cast("long").alias("rank"))


@query("""SELECT doc_id, source FROM documents WHERE (lower(coalesce(text, '')) LIKE '%the%' OR lower(coalesce(source, '')) LIKE '%the%') AND NOT (lower(coalesce(text, '')) LIKE '%idiot%' OR lower(coalesce(source, '')) LIKE '%idiot%')
AND (lower(coalesce(text, '')) LIKE '%src1%' OR lower(coalesce(source, '')) LIKE '%src1%')""")
def include_exclude(spark, sf_dir):
    """P07"""
    return timeline.keywords(demo.read(spark, sf_dir, "documents"), [(True, "the"), (False, "IDIOT"), (True, "src1")], ["text", "source"]).select("doc_id", "source")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-03 10:15:00' AND ts < TIMESTAMP '2024-01-09 08:31:00'""")
def timeline_window(spark, sf_dir):
    """P05, P13, U02"""
    e = demo.events(spark, sf_dir).withColumn("source", F.col("action"))
    t = timeline.window(timeline.of_facts(e), "click", "2024-01-09 08:30:10", "2024-01-03 10:15:45")
    return t.select(F.col("fact_ord").alias("event_id"), stamp("time").alias("time"))


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def timeline_focus(spark, sf_dir):
    """Events that reference a key"""
    t = timeline.of_facts(demo.events(spark, sf_dir)).withColumns({"entities": F.lit(""), "details": F.lit("")})
    return timeline.focused(t, "Key:7").select(F.col("fact_ord").alias("event_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(spark, sf_dir):
    """T07"""
    return timeline.page(demo.read(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 50).select("o_orderkey", "o_totalprice")


def _credentials(spark, sf_dir) -> DataFrame:
    """Sign-ups as leads of credentials and purchases as remote access."""
    e = demo.events(spark, sf_dir).where("action IN ('signup', 'purchase')")
    refs = F.array(F.struct(F.lit("User").alias("type"), F.get("entity_refs", F.lit(0))["value"].alias("value")), F.struct(F.lit("TargetServer").alias("type"), F.get("entity_refs", F.lit(1))["value"].alias("value")))
    return e.withColumns({"source": F.when(F.col("action") == "purchase", "NetworkResource").otherwise("Events"), "action": F.when(F.col("action") == "signup", "ExplicitCredentialUsed").otherwise("x"), "entity_refs": refs})


@query(f"""WITH ev AS ({_EVENTS}), c AS (SELECT DISTINCT host, ord, unnest(['principal=' || user_id, 'target=' || k]) AS v FROM ev WHERE action = 'signup'), r AS (SELECT DISTINCT host, ord, unnest(['principal=' || user_id, 'target=' || k]) AS v FROM ev WHERE action = 'purchase')
SELECT c.host AS case_id, c.ord AS credential, r.ord AS remote, string_agg(c.v, ',' ORDER BY c.v) AS shared FROM c JOIN r USING (host, v) GROUP BY 1, 2, 3""")
def credential_pairs(spark, sf_dir):
    """J05, U05"""
    return hunt.credential_pairs(_credentials(spark, sf_dir)).select("case_id", "credential", "remote", F.array_join("shared", ",").alias("shared"))


@query(f"""WITH ev AS ({_EVENTS}), v AS (SELECT host, action, unnest([('principal', user_id::VARCHAR), ('target', k)]) AS p FROM ev WHERE action IN ('signup', 'purchase')), n AS (SELECT host AS case_id, p[1] AS kind, p[2] AS value, count(*) FILTER (action = 'signup') AS credentials, count(*) FILTER (action = 'purchase') AS remotes FROM v GROUP BY ALL)
SELECT *, credentials * remotes AS pairs FROM n WHERE credentials > 0 AND remotes > 0""")
def credential_links(spark, sf_dir):
    """What both sides share, with the counts of either, without pairs"""
    return hunt.credential_links(_credentials(spark, sf_dir))


@query("""SELECT strftime(max(greatest(CASE WHEN o_orderdate < TIMESTAMP '2001-01-02' THEN o_orderdate END, CASE WHEN l_shipdate < TIMESTAMP '2001-01-02' THEN l_shipdate END)), '%Y-%m-%d %H:%M:%S') AS latest FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def latest_time(spark, sf_dir):
    """A12"""
    j = demo.read(spark, sf_dir, "orders").join(demo.read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return quality.latest_time(j, ["o_orderdate", "l_shipdate"], F.lit("2001-01-01").cast("timestamp")).select(stamp("latest").alias("latest"))


def _redact_sql() -> str:
    x = "coalesce(text, '')"
    for p, to in (*X.LITERALS, *X.PATHS):
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return f"SELECT doc_id, md5({x}) AS masked, ({x} <> coalesce(text, '')) AS changed FROM documents"


@query(_redact_sql())
def redaction(spark, sf_dir):
    """Q01, F24"""
    d = quality.redacted(demo.read(spark, sf_dir, "documents").withColumn("masked", X.text(F.col("text"))), "Basic", ("masked",))
    return d.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("masked"), (F.col("masked") != X.text(F.col("text"))).alias("changed"))


@query("""WITH m AS (SELECT coalesce(source, '') AS host, 'doc_' || doc_id || '.txt' AS rel, sha256(coalesce(text, '')) AS h FROM documents)
SELECT host, sha256(string_agg(rel || chr(9) || h || chr(10), '' ORDER BY lower(rel), rel)) AS digest, count(*) AS files FROM m GROUP BY 1""")
def manifest_digest(spark, sf_dir):
    """Q06, A15, F27"""
    d = demo.read(spark, sf_dir, "documents").select(X.text(F.col("source")).alias("host"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("rel"), X.text(F.col("text")).cast("binary").alias("content"))
    return quality.digest(quality.manifest(d))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS record, p_partkey // 4 AS parent, p_name AS name FROM part),
w AS (SELECT record, CASE WHEN record = parent THEN NULL ELSE parent END AS up, CASE WHEN record = parent THEN '' ELSE chr(92) || name END AS path FROM p
UNION ALL SELECT w.record, CASE WHEN p.record = p.parent THEN NULL ELSE p.parent END, CASE WHEN p.record = p.parent THEN '' ELSE chr(92) || p.name END || w.path FROM w JOIN p ON w.up = p.record)
SELECT record, CASE WHEN path = '' THEN chr(92) ELSE path END AS path FROM w WHERE up IS NULL""")
def parent_path(spark, sf_dir):
    """J09"""
    p = demo.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("record"), F.expr("p_partkey div 4").alias("parent"), F.col("p_name").alias("name"))
    return graph.parent_paths(p, root=-1).select("record", "path")


@query("""WITH r AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/?#]*/[a-z]{2}') AS root FROM pages WHERE page_id % 3 = 0), u AS (SELECT DISTINCT url FROM pages),
m AS (SELECT u.url, arg_max(r.root, length(r.root)) AS root FROM u JOIN r ON r.root <> '' AND (lower(u.url) = lower(r.root) OR starts_with(lower(u.url), lower(r.root) || '/')) GROUP BY 1)
SELECT page_id, coalesce(md5(m.root), '') AS "user" FROM pages LEFT JOIN m USING (url)""")
def user_of_path(spark, sf_dir):
    """Longest known root that is a prefix"""
    p = demo.read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    roots = p.where("page_id % 3 = 0").select(F.regexp_extract("path", r"^[a-z]+://[^/?#]*/[a-z]{2}", 0).alias("root")).where("root <> ''").distinct().withColumn("user", F.md5(F.col("root").cast("binary")))
    return quality.user_of_path(p, roots).select("page_id", "user")


@query(f"""WITH o AS (SELECT DISTINCT n_name, o_orderstatus, o_orderpriority FROM ({_NATIONS}) WHERE o_totalprice > 300000), e AS (SELECT n_name, s, p FROM nation, (SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders)),
g AS (SELECT e.n_name AS host, e.s AS step, count(o.n_name) AS present, count(*) - count(o.n_name) AS missing FROM e LEFT JOIN o ON o.n_name = e.n_name AND o_orderstatus = s AND o_orderpriority = p GROUP BY 1, 2)
SELECT host, step, present, missing, CASE WHEN present > 0 AND missing = 0 THEN 'complete' WHEN present > 0 THEN 'partial' ELSE 'missing' END AS status FROM g""")
def coverage(spark, sf_dir):
    """Q02, J12, A13, U06"""
    n = demo.nations(spark, sf_dir)
    kinds = n.select(F.col("o_orderstatus").alias("step"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("artifact")).distinct()
    hosts = demo.read(spark, sf_dir, "nation").select(F.col("n_name").alias("host"))
    expected = kinds.withColumn("x", F.lit(1)).join(hosts.withColumn("x", F.lit(1)), "x").drop("x")  # 25 hosts and 15 kinds
    have = n.where("o_totalprice > 300000").select(F.col("n_name").alias("host"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("artifact"))
    return quality.coverage(expected, have).select("host", "step", "present", "missing", "status")


@query("""WITH s AS (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1)
SELECT c_custkey AS host, CASE WHEN c_acctbal < 0 THEN 'not_present' WHEN newest IS NULL THEN 'unknown' WHEN newest > TIMESTAMP '2001-01-01' + INTERVAL 1 SECOND THEN 'stale' ELSE 'current' END AS freshness FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def freshness(spark, sf_dir):
    """J13, Q05"""
    c = demo.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("host"), F.when(F.col("c_acctbal") >= 0, F.lit("2001-01-01").cast("timestamp")).alias("snapshot"))
    return quality.freshness(c, demo.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("host"), F.col("o_orderdate").alias("modified"))).select("host", "freshness")


@query(f"WITH ev AS ({_EVENTS}), h AS (SELECT DISTINCT host, action FROM ev WHERE ord < 8) SELECT host, action, count(*) AS facts FROM ev WHERE (host, action) NOT IN (SELECT host, action FROM h) GROUP BY 1, 2")
def refill_sources(spark, sf_dir):
    """S20, J08"""
    e = demo.events(spark, sf_dir).withColumn("source", F.col("action"))
    return store.missing_sources(e.where("fact_ord < 8"), e).groupBy("host", "action").agg(F.count("*").alias("facts"))


@query("""WITH d AS (SELECT DISTINCT source, lang FROM documents WHERE trim(coalesce(lang, '')) <> ''), t AS (SELECT * FROM d ORDER BY source, lang LIMIT 5)
SELECT (SELECT string_agg(source || ': ' || lang, ' | ' ORDER BY source, lang) FROM t) AS shown, count(*) AS pairs, count(DISTINCT source) AS sources, greatest(count(*) - 5, 0) AS more FROM d""")
def note_summary(spark, sf_dir):
    """A10"""
    return quality.note_summary(demo.read(spark, sf_dir, "documents").select("source", F.col("lang").alias("note")))


@query(f"""WITH ev AS ({_EVENTS}) SELECT host, concat_ws(',', CASE WHEN bool_or(action = 'error') THEN 'errors seen' END, CASE WHEN bool_or(action = 'refund') THEN 'refunds seen' END, CASE WHEN bool_or(action = 'signup') THEN 'sign-ups seen' END) AS notes FROM ev GROUP BY 1""")
def notes_by_source(spark, sf_dir):
    """A17"""
    e = demo.events(spark, sf_dir).withColumn("source", F.col("action"))
    return quality.notes_by_source(e, {"Error": "errors seen", "Refund": "refunds seen", "Signup": "sign-ups seen"}).select("host", F.array_join("notes", ",").alias("notes"))


@query("""WITH t AS (SELECT l_orderkey AS key, list(DISTINCT lower(l_returnflag)) AS names FROM lineitem GROUP BY 1)
SELECT o_orderkey AS key, CASE WHEN list_contains(names, lower(CASE WHEN o_orderstatus = 'F' THEN 'R' WHEN o_orderstatus = 'P' THEN 'N' ELSE 'A' END)) THEN 'match' ELSE 'mismatch' END AS names FROM orders JOIN t ON o_orderkey = key""")
def reconcile(spark, sf_dir):
    """J16"""
    ours = demo.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "P", "N").otherwise("A").alias("name"), F.lit(None).cast("timestamp").alias("stamp"))
    theirs = demo.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("name"), F.lit(None).cast("timestamp").alias("stamp"))
    return quality.reconcile(ours, theirs).select("key", "names")


@query("SELECT count(DISTINCT doc_id) AS reference, count(DISTINCT l) AS found, round(100.0 * count(DISTINCT l) / count(DISTINCT doc_id), 1)::DOUBLE AS percent FROM (SELECT d.doc_id, l.doc_id AS l FROM documents d LEFT JOIN labels l USING (doc_id))")
def recall(spark, sf_dir):
    """A21"""
    ids = lambda t: demo.read(spark, sf_dir, t).select(F.col("doc_id").cast("string").alias("value"))
    return quality.recall(ids("labels"), ids("documents"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS visited FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 5000")
def visits(spark, sf_dir):
    """Times from microseconds since 1601"""
    from .sources import tables

    e = demo.read(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", F.col("event_id").alias("url"), (F.unix_micros("ts") + 11_644_473_600_000_000).alias("raw"))
    return tables.visits(e).select("event_id", stamp("visited").alias("visited"))


_TRUNC = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query(f"""SELECT 'H' || (user_id % 5) AS host, 'Process_' || event_id AS fact_id, {_TRUNC} AS time, CASE WHEN event_type = 'error' THEN 'UnknownTime' ELSE 'EventTime' END AS time_kind, CASE WHEN event_type = 'error' THEN 'Low' ELSE 'High' END AS time_confidence,
'Path=C:\\app\\' || event_type || '.exe | User=u' || user_id || ' | CommandLine=run ' || json_extract_string(props, '$.k') AS entities, 'run ' || json_extract_string(props, '$.k') AS details, event_type = 'error' AS fallback_used, 'process_list.csv:' || (event_id + 2) AS raw_ref
FROM (SELECT * REPLACE (CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts) FROM events)""".replace("\\\\", "\\"))
def normalize_process(spark, sf_dir):
    """N01, F14, F22"""
    e = demo.read(spark, sf_dir, "events")
    host = F.concat(F.lit("H"), (F.col("user_id") % 5).cast("string"))
    rows = demo.artifact(e, "process_list.csv", host, F.col("event_id"), PID=F.col("event_id"), Name=F.col("event_type"), Path=F.concat(F.lit("C:\\app\\"), "event_type", F.lit(".exe")), CommandLine=F.concat(F.lit("run "), F.get_json_object("props", "$.k")), StartTime=F.when(F.col("event_type") == "error", "").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), User=F.concat(F.lit("u"), "user_id"), SHA256=F.lit("[none]"))
    n = normalize.process(rows)
    return n.select("host", "fact_id", stamp("time").alias("time"), "time_kind", "time_confidence", X.summary(F.col("entity_refs")).alias("entities"), "details", "fallback_used", "raw_ref")


_IDS = {"click": "4624", "view": "4688", "purchase": "5145", "signup": "4720", "error": "1102"}


@query("""SELECT event_id, 'EventLog:Security' AS source, CASE event_type WHEN 'click' THEN 'LogonSucceeded' WHEN 'view' THEN 'ProcessCreated' WHEN 'purchase' THEN 'ShareAccessChecked' WHEN 'signup' THEN 'AccountCreated' ELSE 'AuditLogCleared' END AS action,
'u' || user_id AS target, '10.0.0.' || json_extract_string(props, '$.k') AS ip, CASE WHEN event_type IN ('click') THEN 'D' || chr(92) || 'u' || user_id ELSE '' END AS account FROM events""")
def normalize_event_log(spark, sf_dir):
    """N26, F04, F05, F11, F12"""
    e = demo.read(spark, sf_dir, "events")
    ids = F.create_map(*(F.lit(x) for kv in _IDS.items() for x in kv))
    data = F.concat(F.lit("TargetUserName=u"), "user_id", F.lit(" | Target Domain Name=D | IpAddress=10.0.0."), F.get_json_object("props", "$.k"), F.lit(" | targetusername=second | WorkstationName=-"))
    rows = demo.artifact(e, "Security_filtered.csv", F.lit("H"), F.col("event_id"), TimeCreated=F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), EventId=F.try_element_at(ids, "event_type"), ProviderName=F.lit("Audit"), Message=F.lit(""), EventData=data).withColumn("label", F.lit("Security"))
    n = normalize.event_log(rows)
    value = lambda t: X.text(F.get(F.filter("entity_refs", lambda r: r["type"] == t), F.lit(0))["value"])
    return n.select((F.regexp_extract("raw_ref", r":(\d+)$", 1).cast("long") - 2).alias("event_id"), "source", "action", value("User").alias("target"), value("RemoteIP").alias("ip"), value("TargetUser").alias("account"))


def _hunted(spark, sf_dir) -> DataFrame:
    """Events as facts of the sources that the rules look at."""
    e = demo.events(spark, sf_dir)
    k = F.get("entity_refs", F.lit(1))["value"].cast("int")
    path = F.when(k < 20, "C:\\Users\\u\\AppData\\Local\\Temp\\").otherwise("C:\\Program Files\\")
    source = F.when(F.col("action") == "click", "Process").when(F.col("action") == "view", "Autorun").when(F.col("action") == "error", "EventLog:Security").when(F.col("action") == "signup", "BITS").otherwise("NetworkResource")
    refs = F.array(F.struct(F.lit("Path").alias("type"), F.concat(path, F.lit("p"), k, F.lit(".exe")).alias("value")), F.struct(F.lit("EventId").alias("type"), F.when(k % 10 == 0, "1102").otherwise("4624").alias("value")), F.struct(F.lit("ShareName").alias("type"), F.when(k % 4 == 0, "admin$").otherwise("docs").alias("value")))
    return e.withColumns({"entity_refs": refs, "source": source})


@query(f"""WITH ev AS (SELECT *, k::INT AS n FROM ({_EVENTS})), m AS (
SELECT host, 'GH-EXEC-SUSPATH-001' AS rule, n, n < 20 AS odd FROM ev WHERE action = 'click' AND n < 20 UNION ALL SELECT host, 'GH-AUTORUN-001', n, n < 20 FROM ev WHERE action = 'view' AND n < 20
UNION ALL SELECT host, 'GH-LOGCLEAR-001', n, n < 20 FROM ev WHERE action = 'error' AND n % 10 = 0 UNION ALL SELECT host, 'GH-BITS-001', n, n < 20 FROM ev WHERE action = 'signup' UNION ALL SELECT host, 'GH-SMB-001', n, n < 20 FROM ev WHERE action = 'purchase' AND n % 4 = 0)
SELECT host AS case_id, rule, count(*) AS matches, count(DISTINCT CASE WHEN odd THEN n END) AS paths FROM m GROUP BY 1, 2""")
def hunt_rules(spark, sf_dir):
    """H02, H03, H06, H10, H11, A19, F23"""
    return hunt.evaluate(_hunted(spark, sf_dir)).select("case_id", "rule", "matches", "paths")


@query(f"""WITH ev AS (SELECT *, k::INT AS n FROM ({_EVENTS})) SELECT host AS case_id, ord AS fact_ord, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY time DESC, 'Events_' || ord) AS r FROM ev WHERE action = 'signup') WHERE r <= 4""")
def hunt_evidence(spark, sf_dir):
    """W01, F31"""
    m = hunt.evaluate(_hunted(spark, sf_dir), ("GH-BITS-001",))
    e = m.select("case_id", F.posexplode("evidence_ids").alias("p", "id"))
    return e.select("case_id", F.substring_index("id", "_", -1).cast("long").alias("fact_ord"), (F.col("p") + 1).cast("long").alias("rank"))


@query(f"""WITH ev AS ({_EVENTS}), s AS (SELECT action, CASE action WHEN 'click' THEN 'Process' WHEN 'view' THEN 'MFT' WHEN 'error' THEN 'EventLog:x' WHEN 'signup' THEN 'Autorun' ELSE 'Other' END AS source FROM ev)
SELECT source, CASE source WHEN 'Process' THEN 'EventTime' WHEN 'EventLog:x' THEN 'EventTime' WHEN 'MFT' THEN 'MetadataTime' ELSE 'ObservedTime' END AS time_kind, CASE source WHEN 'Process' THEN 'High' WHEN 'EventLog:x' THEN 'High' WHEN 'Autorun' THEN 'Low' ELSE 'Medium' END AS time_confidence,
CASE source WHEN 'Process' THEN 'System Info' WHEN 'MFT' THEN 'MFT' WHEN 'EventLog:x' THEN 'Event Logs' WHEN 'Autorun' THEN 'Persistence' ELSE 'unknown' END AS collection_step, CASE source WHEN 'Process' THEN 'Structured' WHEN 'EventLog:x' THEN 'Structured' WHEN 'MFT' THEN 'MetadataDerived' WHEN 'Autorun' THEN 'RegistryValue' ELSE 'Unknown' END AS parse_level, count(*) AS facts FROM s GROUP BY ALL""")
def enrichment(spark, sf_dir):
    """E01 to E08"""
    a = F.col("action")
    e = demo.events(spark, sf_dir).withColumns({"source": F.when(a == "click", "Process").when(a == "view", "MFT").when(a == "error", "EventLog:x").when(a == "signup", "Autorun").otherwise("Other"), "time_kind": F.lit(None).cast("string"), "time_confidence": F.lit(""), "parse_level": F.lit("?")})
    return enrich.with_provenance(enrich.with_time_defaults(e)).groupBy("source", "time_kind", "time_confidence", "collection_step", "parse_level").agg(F.count("*").alias("facts"))


@query("""SELECT page_id, coalesce(bool_or(length(p) = length(r) OR starts_with(p[length(r) + 1:], '/')), false) AS allowed FROM
(SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS p FROM pages) LEFT JOIN (VALUES ('https://ththre.example.com/en'), ('http://tionsh.example.net'), ('https://tionsh.example.net/de')) v(r) ON starts_with(p, r) GROUP BY page_id""")
def allow_list(spark, sf_dir):
    """P12"""
    rules = spark.createDataFrame([("https://ththre.example.com/en/",), ("http://tionsh.example.net",), ("https://tionsh.example.net/de",)], "url string")
    return quality.allowed(demo.read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "allowed")


@query("SELECT o_orderkey AS \"order\", coalesce(c_name, o_custkey::VARCHAR) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def decoded_names(spark, sf_dir):
    """J07"""
    names = demo.read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return quality.decoded(demo.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("id")), names).select("order", "name")


@query("""WITH f AS (SELECT p_brand AS host, p_type || '/' || p_name AS rel FROM part), p AS (SELECT DISTINCT p_brand AS host, unnest(['ECON*', '*ring', 'small ????', 'none*']) AS pattern FROM part)
SELECT p.host, p.pattern, count(DISTINCT rel) AS matched FROM p LEFT JOIN f ON f.host = p.host AND (regexp_matches(rel, '^' || replace(replace(pattern, '*', '.*'), '?', '.') || '$', 'i') OR regexp_matches(split_part(rel, '/', 2), '^' || replace(replace(pattern, '*', '.*'), '?', '.') || '$', 'i')) GROUP BY 1, 2""")
def required_outputs(spark, sf_dir):
    """J11"""
    p = demo.read(spark, sf_dir, "part")
    files = p.select(F.col("p_brand").alias("host"), F.concat_ws("/", "p_type", "p_name").alias("rel"))
    patterns = p.select(F.col("p_brand").alias("host")).distinct().select("host", F.explode(F.array(*map(F.lit, ("ECON*", "*ring", "small ????", "none*")))).alias("pattern"))
    return quality.required_outputs(patterns, files)


@query("""WITH r AS (SELECT DISTINCT lower(p_type) AS k FROM part WHERE p_size < 25), d AS (SELECT DISTINCT lower(p_type) AS k FROM part WHERE p_brand = 'Brand#1')
SELECT (SELECT count(*) FROM (SELECT k FROM r UNION SELECT k FROM d)) AS labels, coalesce((SELECT string_agg(upper(k), ',' ORDER BY k) FROM (SELECT k FROM r EXCEPT SELECT k FROM d)), '') AS raw_only, CASE WHEN EXISTS (SELECT k FROM r EXCEPT SELECT k FROM d) OR EXISTS (SELECT k FROM d EXCEPT SELECT k FROM r) THEN 'partial' ELSE 'complete' END AS status""")
def log_labels(spark, sf_dir):
    """J14, A22, U06"""
    p = demo.read(spark, sf_dir, "part").withColumn("label", F.col("p_type"))
    return quality.log_labels(p.where("p_size < 25"), p.where("p_brand = 'Brand#1'")).select("labels", joined("raw_only").alias("raw_only"), "status")


@query(f"""WITH c AS (SELECT n_name AS host, o_orderstatus AS status FROM ({_NATIONS})), g AS (SELECT host, count(*) FILTER (status = 'F') AS complete, count(*) FILTER (status = 'P') AS partial, count(*) FILTER (status = 'O') AS failed, count(*) AS steps FROM c GROUP BY 1)
SELECT host, complete, partial, failed, steps, CASE WHEN complete = steps THEN 'complete' WHEN complete + partial > 0 THEN 'partial' ELSE 'failed' END AS overall FROM g""")
def overall_status(spark, sf_dir):
    """A13"""
    s = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("failed")
    return quality.overall(demo.nations(spark, sf_dir).select(F.col("n_name").alias("host"), s.alias("status"))).select("host", "complete", "partial", "failed", "steps", "overall")


@query("""SELECT c_custkey, translate(c_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS turned, CASE WHEN regexp_matches(c_acctbal::VARCHAR, '^-') THEN '''x' ELSE 'x' END AS cell, CASE WHEN length(c_name) > 12 THEN c_name[1:9] || '...' ELSE c_name END AS short, split_part(c_name, '#', -1) AS base FROM customer""")
def text_functions(spark, sf_dir):
    """F14, F15, F18, F25"""
    c = demo.read(spark, sf_dir, "customer")
    sign = F.when(F.col("c_acctbal").cast("string").startswith("-"), "-x").otherwise("x")  # a balance of -0.0 has its sign
    return c.select("c_custkey", X.rot13(F.col("c_name")).alias("turned"), F.replace(X.neutral(sign), F.lit("-"), F.lit("")).alias("cell"), X.truncate(F.col("c_name"), 12).alias("short"), X.base_name(F.replace("c_name", F.lit("#"), F.lit("\\"))).alias("base"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%Y-%m-%d %H:%M:%S') AS b, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events""")
def time_functions(spark, sf_dir):
    """F03, F16, F17"""
    e = demo.read(spark, sf_dir, "events").withColumn("u", F.unix_micros("ts"))
    return e.select("event_id", F.date_format(X.epoch((F.col("u") + 11_644_473_600_000_000) * 10), "yyyy-MM-dd HH:mm:ss").alias("a"), F.date_format(X.epoch(F.expr("u div 1000000")), "yyyy-MM-dd HH:mm:ss").alias("b"), F.date_format(X.parse_time(F.date_format("ts", "M/d/yyyy H:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("c"), X.iso(F.col("ts")).alias("iso"))


@query(f"WITH {_FACTS} SELECT host AS case_id, count(*) AS facts FROM (SELECT host FROM ev UNION ALL SELECT host FROM od UNION ALL SELECT host FROM li) GROUP BY 1")
def host_summaries(spark, sf_dir):
    """A16"""
    f = demo.facts(spark, sf_dir)
    return pivot.host_summaries(f, f.select("case_id").distinct()).select("case_id", "facts")


@query("""SELECT conv_id AS case_id, string_agg(DISTINCT upper(role), ',' ORDER BY upper(role)) AS tags FROM conversations GROUP BY 1""")
def annotated_cases(spark, sf_dir):
    """J15, F30, U04"""
    c = demo.read(spark, sf_dir, "conversations")
    notes = c.groupBy(F.col("conv_id").alias("case_id")).agg(F.array_join(F.collect_list(F.upper("role")), "; ").alias("tags"))
    return quality.annotated(c.select(F.col("conv_id").alias("case_id")).distinct(), notes).select("case_id", joined("tags").alias("tags"))


@query("SELECT count(*) FILTER (trim(coalesce(lang, '')) = '') AS unlabeled, string_agg(DISTINCT lang, ',' ORDER BY lang) AS profiles FROM documents")
def profile_mix(spark, sf_dir):
    """A18"""
    return quality.profile_mix(demo.read(spark, sf_dir, "documents").withColumn("collection_mode_profile", F.col("lang"))).select("unlabeled", joined("profiles").alias("profiles"))


@query(f"""WITH {_ENTS}, w AS (SELECT key AS entity_key, time_bucket(INTERVAL 30 MINUTE, time) AS b, count(DISTINCT host) AS hosts, count(*) AS facts FROM en WHERE source = 'Events' GROUP BY 1, 2 HAVING count(DISTINCT host) > 1)
SELECT entity_key, strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, hosts, facts FROM w""")
def stream_shared(spark, sf_dir):
    """The events table read as a stream, to completion"""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # as a pattern it may be a file or a folder
    refs = F.explode(F.array(*(F.concat(F.lit(f"{k}:"), F.lower(v.cast("string"))) for k, v in (("user", F.col("user_id")), ("key", F.get_json_object("props", "$.k")), ("eventtype", F.col("event_type")))))).alias("entity_key")
    rows = e.select(F.col("ts").cast("timestamp").alias("time"), F.concat(F.lit("H"), (F.col("user_id") % 5).cast("string")).alias("host"), refs)
    return live.completed(live.live_shared(rows, 30), "stream_shared", "complete").select("entity_key", stamp("bucket").alias("bucket"), F.col("hosts").cast("long").alias("hosts"), "facts")


# Kept apart for their number.
from . import evidence_queries, folder_queries, record_queries, store_queries  # noqa: E402

QUERIES |= evidence_queries.QUERIES | record_queries.QUERIES | store_queries.QUERIES | folder_queries.QUERIES
SQL |= evidence_queries.SQL | record_queries.SQL | store_queries.SQL | folder_queries.SQL
