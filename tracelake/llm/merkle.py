"""A Merkle manifest of a dataset, with nested-interval labels.

Every row is a leaf; each group (source) is a tree of its own, and the trees' roots are the leaves of
the tree above. Within a tree leaves have ranks, and each node is labelled with the interval [lo, hi) of the
ranks below it, so an ancestor is a node whose interval contains another's. Nodes of level l lie in
buckets of FAN^l ranks. A containment join therefore compares a node with the one node in its bucket
of the level above, and a node's siblings are what is left of its parent's interval without its own.

Ranks come from a range partitioning by (group, key), counts of each partition's groups, and their prefix
sums, so a group with a third of all rows is ranked and hashed by many tasks. A run of children is at most
FAN rows; texts are hashed where they are read and never shuffled. Siblings are gathered from the top
down, once for each run: what lies above a run is handed to it as one row.

Cases: a null value is the mark `-`, an empty one `0:`; rows with a null group form one tree, which comes
first, as null keys come first within a tree; rows of equal key are in order of their digests, and
repeated rows are equal leaves; a very long text is hashed whole; a tree of one leaf is that leaf;
an empty table has no nodes and gives an empty result. Columns that are not named are ignored, whatever
their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Children of a node at most.
FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(*values: Column) -> Column:
    """The digest (binary) of a row's values, each with its length so that no two rows read alike."""

    def one(v: Column) -> Column:
        s = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(one(v) for v in values)).cast("binary"), 256))


def ranked(leaves: DataFrame) -> DataFrame:
    """leaves (grp, key, digest, ...) with tree (the group's rank), lo (the rank within it), hi, size (of the tree) and height."""
    extra = [c for c in leaves.columns if c not in ("grp", "key", "digest")]
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("row")]
    rows = leaves.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(leaves.sparkSession), *order).sortWithinPartitions(*order)
    rows = cut(rows.drop("row").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "ranked")
    of, within = Window.partitionBy("grp").orderBy("part"), Window.partitionBy("part").orderBy(F.col("grp").asc_nulls_first())
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    held = cut(rows.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("at").alias("first")), "held")
    held = held.select("*", F.coalesce(F.sum("n").over(past(of)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("size"), (F.row_number().over(of) == 1).cast("long").alias("fresh"))
    held = held.withColumn("seen", F.sum("fresh").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = held.groupBy("part").agg(F.sum("fresh").alias("m")).select(F.col("part").alias("p"), F.coalesce(F.sum("m").over(past(Window.orderBy("part"))), F.lit(0)).alias("base"))
    held = held.join(parts, F.col("part") == F.col("p"))
    held = held.select(F.col("part").alias("p"), F.col("grp").alias("g"), "first", "before", "size", (F.col("base") + F.col("seen") - 1).alias("tree"))
    lo = F.col("at") - F.col("first") + F.col("before")
    out = rows.join(held, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return out.select("tree", lo.alias("lo"), (lo + 1).alias("hi"), "size", height(F.col("size")).alias("height"), "grp", "key", "digest", *extra)


def height(size: Column) -> Column:
    """Levels above the leaves of a tree: the least h with FAN^h >= size."""
    return sum(((size > F.lit(FAN**k)).cast("int") for k in range(1, 15)), (size > 1).cast("int"))


def bucket(level: int) -> Column:
    return F.expr(f"lo div {FAN**level}")


def levels(leaves: DataFrame, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """Nodes above the leaves, level by level: tree, lo, hi, size, height, digest and kids (lo, hi, digest and, of leaves, the carried columns) in order."""
    top = leaves.agg(F.max("height")).first()[0] or 0
    out, nodes = [], leaves
    for level in range(1, top + 1):
        kid = F.struct("lo", "hi", "digest", *(carried if level == 1 else ()))
        runs = nodes.where(F.col("height") >= level).groupBy("tree", bucket(level).alias("bucket")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("size").alias("size"), F.first("height").alias("height"), F.array_sort(F.collect_list(kid)).alias("kids")
        )
        told = F.array_join(F.transform("kids", lambda k: _hex(k["digest"])), "")
        nodes = cut(runs.drop("bucket").withColumn("digest", F.unhex(F.sha2(told.cast("binary"), 256))), f"level{level}")
        out.append(nodes)
    return out


def roots(leaves: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, digest, height) of each tree's root."""
    out = leaves.where("height = 0").select("tree", "digest", "height")
    for level, nodes in enumerate(above, 1):
        out = out.unionByName(nodes.where(F.col("height") == level).select("tree", "digest", "height"))
    return out


PATH = "array<struct<left:string,right:string>>"


def _beside(kid: Column, kids: Column) -> Column:
    """The siblings of a node: what its parent's interval has before and behind its own, as hex text."""
    text = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda k: _hex(k["digest"])), "")
    return F.struct(text(lambda k: k["hi"] <= kid["lo"]).alias("left"), text(lambda k: k["lo"] >= kid["hi"]).alias("right"))


def paths(leaves: DataFrame, above: list[DataFrame], start: DataFrame, carried: tuple[str, ...]) -> DataFrame:
    """Each leaf's tree, lo, digest and carried columns, with path (siblings from its own level up to the root) and what start has of its tree.

    start: (tree, height, path, ...) of every tree's root; path goes on above the tree.
    """
    more = [c for c in start.columns if c not in ("tree", "height", "path")]
    reached = None
    for level in range(len(above), 0, -1):
        here = start.where(F.col("height") == level).select("tree", F.lit(0).cast("long").alias("lo"), F.lit(1 << 62).cast("long").alias("hi"), "path", *more)
        here = here if reached is None else reached.unionByName(here)
        node = here.select(F.col("tree").alias("t"), bucket(level).alias("b"), F.col("lo").alias("from"), F.col("hi").alias("to"), "path", *more)
        runs = above[level - 1].select("tree", "lo", "hi", bucket(level).alias("bucket"), "kids")
        held = (F.col("tree") == F.col("t")) & (F.col("bucket") == F.col("b")) & (F.col("lo") >= F.col("from")) & (F.col("hi") <= F.col("to"))
        each = runs.join(node, held).select("tree", F.explode("kids").alias("kid"), "kids", "path", *more)
        own = F.concat(F.array(_beside(F.col("kid"), F.col("kids"))), "path").alias("path")
        if level == 1:
            reached = each.select("tree", "kid.lo", "kid.digest", *(F.col(f"kid.{c}").alias(c) for c in carried), own, *more)
        else:
            reached = cut(each.select("tree", "kid.lo", "kid.hi", own, *more), f"path{level}")
    single = leaves.where("height = 0").select("tree", "lo", "digest", *carried).join(start.where("height = 0").select("tree", "path", *more), "tree")
    return single if reached is None else reached.unionByName(single)


@dataclass
class Manifest:
    """The trees of a dataset: its leaves, the nodes above them, and the tree over the trees' roots."""

    leaves: DataFrame
    above: list[DataFrame]
    heads: DataFrame
    over: list[DataFrame]

    def nodes(self) -> DataFrame:
        """(part, tree, level, lo, hi, digest) of every node: part `rows` for the groups' trees, `groups` for the one above them, whose ranks are those of groups."""
        cols = ("tree", "lo", "hi", "digest")
        out = None
        for part, found in (("rows", [self.leaves, *self.above]), ("groups", [self.heads, *self.over])):
            for level, nodes in enumerate(found):
                one = nodes.select(F.lit(part).alias("part"), "tree", F.lit(level).alias("level"), "lo", "hi", _hex(F.col("digest")).alias("digest"))
                out = one if out is None else out.unionByName(one)
        return out.select("part", "level", *cols)

    def root(self) -> DataFrame:
        """One row (root), none for an empty dataset."""
        return roots(self.heads, self.over).select(_hex(F.col("digest")).alias("root"))

    def proofs(self) -> DataFrame:
        """For each row: key, grp, leaf, other, subroot, root and path, the siblings that prove it against the root."""
        top = roots(self.heads, self.over).select("tree", "height", F.array().cast(PATH).alias("path"), _hex(F.col("digest")).alias("root"))
        groups = paths(self.heads, self.over, top, ("key", "high"))
        start = cut(groups.select(F.col("key").alias("tree"), F.col("high").alias("height"), "path", _hex(F.col("digest")).alias("subroot"), "root"), "start")
        found = paths(self.leaves, self.above, start, ("grp", "key", "other"))
        return found.select("key", "grp", _hex(F.col("digest")).alias("leaf"), _hex(F.col("other")).alias("other"), "subroot", "root", "path")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", columns: tuple[str, ...] = COLUMNS, other: Column | None = None) -> Manifest:
    """The manifest of docs; other: a second digest to carry with each row, such as that of a changed copy."""
    none = F.lit(None).cast("binary") if other is None else other
    leaves = cut(docs.select(F.col(group).alias("grp"), F.col(key).cast("long").alias("key"), leaf(*(F.col(c) for c in columns)).alias("digest"), none.alias("other")), "leaves")
    leaves = cut(ranked(leaves), "labelled")
    above = levels(leaves, ("grp", "key", "other"))
    subroots = cut(roots(leaves, above), "subroots")
    n = subroots.count()
    lo = F.col("tree").cast("long")
    heads = subroots.select(
        F.lit(0).cast("long").alias("tree"), lo.alias("lo"), (lo + 1).alias("hi"), F.lit(n).cast("long").alias("size"), height(F.lit(n)).alias("height"),
        lo.alias("key"), F.col("height").alias("high"), "digest",
    )
    return Manifest(leaves, above, heads, levels(heads, ("key", "high")))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give, both as hex text."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """A proof's siblings as one text, level by level."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def verify(found: DataFrame) -> DataFrame:
    """proofs() with folded_root, from `other` where there is one, else from the leaf, and verified."""
    f = found.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return f.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", text: str = "text") -> Column:
    """The digest of a row whose text had A-Z lower-cased, for each fifth row by crc32 of its key; else null."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, leaf(*(lower if c == text else F.col(c) for c in columns)))


def check(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row, with the rows of tampered() changed after the manifest was made."""
    v = verify(manifest(docs, other=tampered()).proofs())
    return v.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


def sql(rows: int = 5, groups: int = 4) -> str:
    """check() in DuckDB's SQL, for groups of at most FAN**rows rows and FAN**groups groups; levels are written out."""
    fields = lambda text: " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (*COLUMNS[:-1], text))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""
crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) AS r(n)),
keyed AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS c FROM documents, crc),
hashed AS (SELECT doc_id, source, sha256({fields("text")}) AS h, CASE WHEN c % 5 = 0 THEN sha256({fields(lower)}) END AS other FROM keyed),
a0 AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS lo, count(*) OVER (PARTITION BY source) AS cnt FROM hashed)"""]  # fmt: skip

    def grown(a: str, n: int) -> str:
        """Levels a1.. over a0, with what stands before (l) and behind (r) each node in its run; gives a{n}."""
        for k in range(n):
            w = "OVER (PARTITION BY tree, lo // 16 ORDER BY lo ROWS BETWEEN {})"
            before, behind = w.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), w.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            parts.append(f"{a}s{k} AS (SELECT tree, lo, cnt, coalesce(string_agg(h, '') {before}, '') AS l, coalesce(string_agg(h, '') {behind}, '') AS r FROM {a}{k})")
            parts.append(f"{a}{k + 1} AS (SELECT tree, lo // 16 AS lo, (any_value(cnt) + 15) // 16 AS cnt, CASE WHEN any_value(cnt) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY lo)) END AS h FROM {a}{k} GROUP BY tree, lo // 16)")
        return f"{a}{n}"

    subroots = grown("a", rows)
    parts.append(f"b0 AS (SELECT 0 AS tree, tree AS lo, count(*) OVER () AS cnt, h FROM {subroots})")
    root = grown("b", groups)
    found = f"SELECT doc_id, a0.h AS leaf, s.h AS subroot, t.h AS root, a0.tree AS top, a0.lo AS lo, coalesce(other, a0.h) AS f, '' AS proof FROM a0 JOIN {subroots} s USING (tree) CROSS JOIN {root} t"
    parts.append(f"f0 AS ({found})")
    for k in range(rows + groups):
        s, on = (f"as{k}", f"s.tree = top AND s.lo = f.lo // {FAN**k}") if k < rows else (f"bs{k - rows}", f"s.lo = top // {FAN ** (k - rows)}")
        parts.append(f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.cnt = 1 THEN f ELSE sha256(l || f || r) END AS f, proof || l || r AS proof) FROM f{k} f JOIN {s} s ON {on})")
    return f"WITH {','.join(parts)}\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{rows + groups}"
