"""The Merkle manifest against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracelake.llm import merkle
from tracelake.llm.common import cut

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, lo int, digest string, key string"


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def low(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def tree(nodes):
    """(root, for each leaf its [(left, right), ...])"""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
    root, above = tree([H(*r) for r in runs])
    return root, [[("".join(nodes[i - i % 16 : i]), "".join(nodes[i + 1 : i - i % 16 + 16])), *above[i // 16]] for i in range(len(nodes))]


def plain(rows):
    leaf = lambda i, t, la, s, n: H(*(part(v) for v in (i, s, la, n, t)))
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for g in groups:
        own = sorted(((r, leaf(*r)) for r in rows if r[3] == g), key=lambda x: (first(x[0][0]), x[1]))
        made[g] = (own, *tree([x[1] for x in own]))
    root, over = tree([made[g][1] for g in groups]) if groups else (None, [])
    out = []
    for g, top in zip(groups, over, strict=True):
        own, subroot, paths = made[g]
        for (r, digest), path in zip(own, paths, strict=True):
            h = leaf(r[0], low(r[1]), *r[2:]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else digest
            for left, right in (full := [*path, *top]):
                h = H(left, h, right)
            out.append((r[0], digest, subroot, root, H("".join(a + b for a, b in full)), h, h == root))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"Text {i % 700} É🙂", "en", "big", i % 90) for i in range(4500)]
    out += [(i, None if i % 7 == 0 else "", None, "b", None) for i in range(257)] + [(i, "A", "x", None, 1) for i in range(16)]
    out += [(None, "N", "x", "b", 2), (5, "dup", "x", "dup", 3), (5, "dup", "x", "dup", 3), (5, "Dup2", "x", "dup", 3), (1, "one", "x", "", 4), (7, "Ü" * 5000, "x", "é", 4)]
    return out + [(i, f"S{i}", "x", f"s{i % 40}", 1) for i in range(60)]


def table(spark, rows):
    return cut(spark.createDataFrame([(*r, "t", 1, "d", "k") for r in rows], SCHEMA).repartition(5))


def test_check(spark, rows):
    got = sorted((tuple(r) for r in merkle.check(table(spark, rows)).collect()), key=str)
    want = plain(rows)
    assert got == want
    assert 0 < sum(not x[-1] for x in got) < len(rows) / 4


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_sizes(spark, n):
    for rows in ([(i, f"T{i}", "x", "s", 1) for i in range(n)], [(i, f"T{i}", "x", f"s{i}", 1) for i in range(n)]) if n in (0, 1, 17) else ([(i, f"T{i}", "x", "s", 1) for i in range(n)],):
        got = merkle.check(table(spark, rows))
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_nodes_and_root(spark, rows):
    m = merkle.manifest(table(spark, rows))
    nodes = m.nodes().collect()
    big = [x for x in nodes if x["part"] == "rows" and x["hi"] - x["lo"] == 4500]
    assert len(big) == 1 and big[0]["level"] == 4
    for level in range(5):  # the intervals of a level tile each tree
        spans = sorted((x["lo"], x["hi"]) for x in nodes if x["part"] == "rows" and x["tree"] == big[0]["tree"] and x["level"] == level)
        assert spans[0][0] == 0 and spans[-1][1] == 4500 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert [r["root"] for r in m.root().collect()] == [plain(rows)[0][3]]
    assert merkle.manifest(table(spark, [])).root().count() == 0


def test_a_changed_row_is_found(spark, rows):
    d = table(spark, rows)
    changed = F.when(F.col("doc_id") == 123, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.lit(0), F.col("text")))
    v = merkle.verify(merkle.manifest(d, other=changed).proofs())
    assert {(r["key"], r["grp"]) for r in v.where("NOT verified").collect()} == {(i, s) for i, _, _, s, n in rows if i == 123}


def test_query_on_a_table(spark):
    from tracelake.llm.queries import op13_merkle_manifest

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted((tuple(r) for r in op13_merkle_manifest(spark, sf).collect()), key=str) == plain(docs)


def test_sql_says_the_same(spark):
    import duckdb

    from tracelake.llm.queries import SQL

    con = duckdb.connect()
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con.sql(f"create or replace view documents as from '{sf}/documents.parquet'")
        docs = [tuple(r) for r in con.sql("select doc_id, text, lang, source, n_chars from documents").fetchall()]
        assert sorted(con.sql(SQL["op13_merkle_manifest"]).fetchall(), key=str) == plain(docs)
