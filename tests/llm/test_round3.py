"""Encoder on every code point; long runs of fingerprints; what a host's reputation says."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import simhash, tokens, urls
from tracelake.llm.common import cut
from tracelake.llm.components import components
from tracelake.llm.queries import vocabulary


def test_encoder_on_every_code_point():
    e = tokens.Encoder(vocabulary(), most=10_000)
    inside = [c for a, b in e.PLAIN for c in range(a, b + 1) if not 0xD800 <= c < 0xE000]
    known = set(inside)
    assert all(e.odd(chr(c)) for c in range(0x110000) if c not in known and not 0xD800 <= c < 0xE000)
    contexts = ["a{0}'s b", ". {0}{0} {0}.", "a {0}b 1{0} {0}"]
    wanted = e.tok.encode_batch_fast([x.format(chr(c)) for c in inside for x in contexts], add_special_tokens=False)
    texts = (x.format(chr(c)) for c in inside for x in contexts)
    assert all(e.ids(t) == np.array(w.ids, "<u4").tobytes() for t, w in zip(texts, wanted, strict=True))
    for c in (0x558, 0x88F, 0xC5C, 0x208F, 0xA7CE, 0x11DB0, 0x11DE0, 0x16EA0, 0x187F8, 0x2B73A, 0x323B0, 0x3D000):
        for x in contexts:
            assert e.ids(x.format(chr(c))) == e.whole(x.format(chr(c)))


def roots(fps, pairs):
    up = {f: f for f in fps}

    def of(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[of(a)] = of(b)
    groups = {}
    for f in fps:
        groups.setdefault(of(f), set()).add(f)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("longest", [512, 40])
def test_long_runs_are_dealt_anew(spark, monkeypatch, longest):
    monkeypatch.setattr(simhash, "LONG", longest)
    r = random.Random(4)
    centre = r.getrandbits(64)
    free = [b for b in range(64) if simhash.free_bits(4) >> b & 1]
    assert len(free) == 32
    fps = {centre}
    while len(fps) < 1500:  # all under one key, some linked
        x = centre
        for b in r.sample(free, r.randrange(1, 9)):
            x ^= 1 << b
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    a = np.array(fps, np.uint64)
    pairs = [(fps[i], int(f)) for i, x in enumerate(a) for f in a[i + 1 :][np.bitwise_count(a[i + 1 :] ^ x) <= 3]]
    table = cut(spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long"))
    got = [(x["a"] % (1 << 64), x["b"] % (1 << 64)) for x in simhash.links(table).collect()]
    assert all((x ^ y).bit_count() <= 3 for x, y in got)
    want = roots(fps, pairs)
    assert roots(fps, got) == want and 1 < len(want) < len(fps)
    assert components(simhash.links(table)).count() == sum(len(g) for g in want if len(g) > 1)


def test_parts_hold_a_common_one():
    assert sorted(b for p in simhash.parts(simhash.free_bits(7)) for b in range(64) if p >> b & 1) == [b for b in range(64) if simhash.free_bits(7) >> b & 1]
    for flips in combinations(range(12), 3):
        x = sum(1 << f for f in flips)
        assert any(not x & p for p in simhash.parts((1 << 12) - 1))


def test_reputation_is_returned(spark):
    pages = cut(spark.createDataFrame([(i, f"http://{'bad' if i < 40 else 'ok'}.test{i % 2}/x") for i in range(100)], "page_id long, url string"))
    labels = cut(spark.createDataFrame([(i, int(i >= 40)) for i in range(0, 100, 2)], "doc_id long, quality int"))
    got = {r["host"]: r for r in urls.judge(pages, labels).collect()}
    assert got["bad.test0"]["n"] == 20 and got["bad.test0"]["rate"] > 0.9 and got["bad.test0"]["verdict"] == "block" and got["bad.test0"]["bound"] > urls.LIMIT
    assert got["ok.test0"]["n"] == 30 and got["ok.test0"]["rate"] < 0.1 and got["ok.test0"]["verdict"] == "allow"
    assert got["bad.test1"]["n"] == 0 and 0.2 < got["bad.test1"]["rate"] < 0.8
    none = urls.judge(pages, labels.limit(0))
    assert none.where((F.col("n") != 0) | (F.col("rate") != 0)).count() == 0


def test_op5_sql_holds_the_posterior(spark):
    import duckdb

    from tracelake.llm.queries import SQL, op5_urls

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as from '{sf}/{t}.parquet'")
    want = con.sql(SQL["op5_urls"]).df().sort_values("page_id")
    got = op5_urls(spark, sf).toPandas().sort_values("page_id")
    assert list(got.columns) == list(want.columns)
    for c in got.columns:
        assert got[c].fillna("").tolist() == want[c].fillna("").tolist(), c
    assert got["bound"].nunique() > 5
