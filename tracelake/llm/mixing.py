"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources in the order of their names (null last) take
weights in turn and share a total that is a multiple of all sizes; no source gets more than
`most` times its own size, and what it would get beyond is shared among the others by weight.
Within a source each document has the same expected number of copies, target / size of the source.
Documents of a source are put in order, expected copies are summed along it from a random offset,
and a document is taken once for every whole number that its step crosses.

The order goes by size class (eight to each power of two), then by a hash block, then by id, so that
taken words follow the target closely. A document's place is the count of all earlier blocks, a running sum
over block counts, plus its place in its own block; a source with any share of the rows is spread
over thousands of blocks.

Cases: a null text has size 0 and may be taken like any other; a source without a word has target
0 and takes nothing; a null source is a source of its own, last in order; repeated rows are sampled
one by one; null doc_ids sort first; of a very long text all words count, and it is still at most twice its
size; an empty table gives an empty result; the added columns win over columns of
the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, numbered, words

WEIGHTS, TOTAL, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 7
BLOCKS, BLOCK_ROWS = 32, 1 << 22
#: Size class: the number's length in bits, then the three bits after its first.
CLASS = "length(bin(size)) * 8 + shiftright(size, greatest(length(bin(size)) - 4, 0)) % 8"


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """(doc_id, row, source, size)"""
    r = F.col(row) if row else F.lit(0).cast("long")
    return docs.select(F.col(key).cast("long").alias("doc_id"), r.alias("row"), F.col(source).cast("string").alias("source"), F.size(words(F.col(text))).cast("long").alias("size"))


def targets(d: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """Of sizes: a row for each source: source, place, source_size, target. The windows without a key run over one row a source."""
    s = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    s = s.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights)).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    every = Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("level", (total * F.sum("source_size").over(every) - F.col("capped")) / F.col("open"))
    # Sources stop at their cap in this order until the level that is left for the others fits under the next cap.
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("source", "place", "source_size", "target", F.sum("n").over(every).alias("rows"))


def digits(text):
    """A number below 2^32 from the MD5 of a text column."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def sample(d: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED) -> DataFrame:
    """sizes(...) with source_size, target, copies and taken (copies times size)."""
    t = targets(d, weights, total, most)
    blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col("rows") / BLOCK_ROWS))
    t = t.select(F.col("source").alias("s"), "place", "source_size", "target", blocks.alias("blocks"))
    d = d.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = d.withColumn("class", F.expr(CLASS)).withColumn("block", F.pmod(digits(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")), F.col("blocks")))
    group = ["place", "class", "block"]
    before = Window.partitionBy("place").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(group).agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    d = d.withColumn("at", F.row_number().over(Window.partitionBy(group).orderBy(F.col("doc_id").asc_nulls_first(), "row"))).join(base, group)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = digits(F.concat(F.lit(f"{seed}:"), F.col("place").cast("string"))) / 4294967296.0
    end = F.col("base") + F.col("at")
    d = d.withColumn("rate", rate).withColumn("offset", offset)
    crossed = F.floor(end * F.col("rate") + F.col("offset")) - F.floor((end - 1) * F.col("rate") + F.col("offset"))
    d = d.withColumn("copies", F.least(crossed, F.ceil("rate")).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return d.select("doc_id", "row", "source", "size", "source_size", "target", "copies", "taken")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None, **how) -> DataFrame:
    """sample() of docs, whose texts are read once."""
    return sample(cut(sizes(docs, key, text, source, row), "sizes"), **how)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs with each row as often as it is taken. docs must give the same rows in the same order when read again, as a table does."""
    row, n = fresh(docs, "_row", "_n")
    keyed = numbered(docs, row)
    copies = plan(keyed, key, text, source, row, **how).where("copies > 0").select(F.col("row").alias(row), F.col("copies").alias(n))
    often = keyed.join(copies, row).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    return often.select(docs.columns)


#: The same in SQL, at the standard parameters.
SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - capped) / open AS own FROM c),
t AS (SELECT *, least(cap, coalesce(max(CASE WHEN own * weight <= cap THEN own END) OVER () * weight, cap)) AS target,
  greatest({BLOCKS}, ceil(sum(n) OVER () / {BLOCK_ROWS}.0))::BIGINT AS blocks FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.place, length(bin(d.size)) * 8 + (d.size >> greatest(length(bin(d.size)) - 4, 0)) % 8 AS class,
  ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT % t.blocks AS block FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY class, block, doc_id) AS e,
  CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('{SEED}:' || place::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS o FROM j)
SELECT doc_id, size, source_size, target, (least(floor(e * rate + o) - floor((e - 1) * rate + o), ceil(rate)) * size)::BIGINT AS taken FROM r
"""
