"""Connected components of a graph given as links, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root), one row for each node that has a link.

    Each round points every node at the smallest of itself and its neighbours, and replaces each
    link by one between what its ends point at, until only loops are left. With ids in no order
    (hashes), the links left fall by a factor each round. Neighbours are only ever aggregated, so a
    node with very many links is no hot spot; nothing is collected.

    Cases: links of a node with itself or with a null end are left out; repeated links, either way round, count once;
    other columns are ignored; no links give an empty result.
    """
    e = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    parents = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "parents")
        parents.append(p)
        pa, pb = p.select(F.col("node").alias("a"), F.col("up").alias("ua")), p.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        ends = e.join(pa, "a").join(pb, "b").where("ua <> ub")
        e = cut(ends.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
    if not parents:
        return links.sparkSession.createDataFrame([], "node long, root long")

    def onto(later: DataFrame, p: DataFrame) -> DataFrame:
        up = later.select(F.col("node").alias("up"), "root")
        return p.join(up, "up", "left").select("node", F.coalesce("root", "up").alias("root"))

    last = parents[-1].select("node", F.col("up").alias("root"))
    return reduce(onto, reversed(parents[:-1]), last)
