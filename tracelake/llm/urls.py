"""URL filters: a rule list, then host reputation by empirical Bayes.

Labelled pages count as good or bad. A host's rate of bad pages is shrunk towards its registered
domain's, that towards its suffix's, and that towards the rate of all, each by a beta-binomial
prior whose strength is estimated from how much the rates of that level vary (method of moments).
A host is blocked when the lower bound of its posterior rate,
its mean less 1.645 of its standard deviations, passes a limit. Only DataFrame
functions are used; three strengths and one rate are all that reaches the driver.

Pages are counted up to hosts before anything is joined, so a host with very many pages sends one
row a task; its pages meet its verdict in a plain join, which Spark splits when it is skewed.

Cases: a null url or one without `://` has an empty host and path, no rule, and the verdict of the
empty host; pages without a label count for nothing; without any label all hosts are allowed;
repeated pages are judged one by one, each label row counting for each; an empty table gives an
empty result; extra columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Suffixes of two labels. Others have one.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Highest rate of bad pages that a host's lower bound may reach, and the bound's distance from the mean in deviations.
LIMIT, DEVIATIONS = 0.3, 1.645
#: Bounds of the within-level correlation: a prior counts for 49 labelled pages at most, and for a hundredth of one at least.
LEAST, MOST = 0.02, 0.99


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def ruled(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of a row's host and path: the longest rule that fits, else null."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))

    def fits(r):
        return ((F.col("host") == r[0]) | F.col("host").endswith("." + r[0])) & F.col("path").startswith(r[1])

    def chain(value):
        return reduce(lambda c, r: c.when(fits(r), value(r)), order[1:], F.when(fits(order[0]), value(order[0])))

    return (chain(lambda r: r[0] + r[1]), chain(lambda r: r[2])) if order else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def levels(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """hosts with suffix and domain: the suffix's one or two last labels, and one label more."""
    two = F.substring_index("host", ".", -2)
    suffix = F.when(two.isin(*suffixes), two).otherwise(F.substring_index("host", ".", -1))
    hosts = hosts.withColumn("suffix", suffix)
    return hosts.withColumn("domain", F.when(F.col("suffix") == two, F.substring_index("host", ".", -3)).otherwise(two))


def strength(t: DataFrame) -> float:
    """Prior strength of rows (n, bad, prior: the mean expected): pseudo-counts worth of belief in the prior."""
    q = F.col("prior") * (1 - F.col("prior"))
    use = t.where((F.col("n") > 0) & (q > 0))
    r = use.agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) / q).alias("s"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k")).first()
    if not r["k"]:
        return 1 / MOST - 1
    free = r["n"] - r["nn"] / r["n"] - (r["k"] - 1)
    rho = (r["s"] - (r["k"] - 1)) / free if free > 0 else LEAST
    return 1 / min(MOST, max(LEAST, rho)) - 1


def reputation(outcomes: DataFrame, limit: float = LIMIT, deviations: float = DEVIATIONS, suffixes=SUFFIXES) -> DataFrame:
    """outcomes (host, bad: 0, 1 or null) -> host, n, bad, rate, bound, blocked."""
    hosts = levels(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), suffixes)
    hosts = cut(hosts, "hosts")  # the strengths and rates of all levels come from this one table
    domains = cut(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total["n"]:
        return hosts.select("host", "n", "bad", F.lit(0.0).alias("rate"), F.lit(0.0).alias("bound"), F.lit(False).alias("blocked"))

    def shrunk(t: DataFrame) -> tuple[DataFrame, float]:
        m = strength(t)
        return t.withColumn("rate", (F.col("bad") + m * F.col("prior")) / (F.col("n") + m)), m

    tops, _ = shrunk(tops.withColumn("prior", F.lit(total["bad"] / total["n"])))
    domains, _ = shrunk(domains.join(tops.select("suffix", F.col("rate").alias("prior")), "suffix"))
    hosts, m = shrunk(hosts.join(domains.select("domain", F.col("rate").alias("prior")), "domain"))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + m + 1))
    hosts = hosts.withColumn("bound", F.col("rate") - deviations * spread)
    return hosts.select("host", "n", "bad", "rate", "bound", (F.col("bound") > limit).alias("blocked"))


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id", url: str = "url", rules=RULES, **how) -> DataFrame:
    """key, host, path, rule, verdict of every page, and its host's n (labelled pages), rate and bound, to nine digits. labels: label_key and quality; pages and labels share their ids, and a quality of 0 is a bad outcome."""
    p = parsed(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))).select("page_id", "host", "path")
    marks = labels.where("quality IS NOT NULL").select(F.col(label_key).alias("k"), (F.col("quality") == 0).cast("long").alias("bad"))
    known = p.join(marks, F.col("page_id") == F.col("k"), "left").select("host", "bad")
    nine = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c)
    hosts = reputation(known, **how).select("host", "blocked", F.col("n").cast("long").alias("n"), nine("rate"), nine("bound"))
    rule, verdict = ruled(rules)
    own = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return p.join(hosts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n", "rate", "bound")


def _sql() -> str:
    """The same in SQL, at the standard parameters."""
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    case = lambda value: "CASE " + " ".join(f"WHEN (p.host = '{h}' OR ends_with(p.host, '.{h}')) AND starts_with(p.path, '{q}') THEN '{value(h, q, v)}'" for h, q, v in order) + " END"
    last = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
    two = ", ".join(f"'{s}'" for s in SUFFIXES)

    def level(name, source):
        return f"""{name}m AS (SELECT 1 / least({MOST}, greatest({LEAST}, (s - (k - 1)) / nullif(n - nn / n - (k - 1), 0))) - 1 AS m FROM
 (SELECT sum(n * (bad / n - prior) ** 2 / (prior * (1 - prior))) AS s, sum(n) AS n, sum(n * n) AS nn, count(*) AS k FROM {source} WHERE n > 0 AND prior * (1 - prior) > 0)),
{name} AS (SELECT {source}.*, m, (bad + m * prior) / (n + m) AS rate FROM {source}, {name}m)"""

    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h1 AS (SELECT host, count(quality)::DOUBLE AS n, coalesce(sum((quality = 0)::INT), 0)::DOUBLE AS bad FROM p LEFT JOIN labels ON page_id = doc_id GROUP BY host),
h2 AS (SELECT *, CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM h1),
h3 AS (SELECT *, CASE WHEN suffix = {last(2)} THEN {last(3)} ELSE {last(2)} END AS domain FROM h2),
d1 AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h3 GROUP BY domain),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d1 GROUP BY suffix),
s2 AS (SELECT *, sum(bad) OVER () / sum(n) OVER () AS prior FROM s1),
{level('s3', 's2')},
d2 AS (SELECT d1.*, s3.rate AS prior FROM d1 JOIN s3 USING (suffix)),
{level('d3', 'd2')},
h4 AS (SELECT h3.*, d3.rate AS prior FROM h3 JOIN d3 USING (domain)),
{level('h5', 'h4')},
v AS (SELECT host, n, rate, rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (n + m + 1)) AS bound FROM h5)
SELECT p.page_id, p.host, p.path, {case(lambda h, q, v: h + q)} AS rule,
  coalesce({case(lambda h, q, v: v)}, CASE WHEN coalesce(v.bound > {LIMIT}, false) THEN 'block' ELSE 'allow' END) AS verdict,
  v.n::BIGINT AS n, round(v.rate, 9) AS rate, round(v.bound, 9) AS bound
FROM p LEFT JOIN v ON p.host = v.host
"""


SQL = _sql()
