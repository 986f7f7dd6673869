"""Periodic runs against all lags and places, on small sequences and on a table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracelake.llm import periodic
from tracelake.llm.common import cut


def plain(w):
    """All runs, by every lag and place."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                found[(i, length, q)] = 1
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    r = random.Random(5)
    for k in range(2500):
        n = r.randrange(0, 70)
        w = [r.randrange(r.choice([1, 2, 2, 3, 9])) for _ in range(n)]
        for _ in range(r.randrange(0, 3)):  # a stretch made periodic, perhaps within another
            if n > 8:
                a, p = r.randrange(n - 4), r.randrange(1, 12)
                b = min(n, a + p * r.randrange(2, 9) + r.randrange(3))
                for i in range(a + p, b):
                    w[i] = w[i - p]
        assert periodic.runs(np.array(w, np.int64)) == plain(w), (k, w)


def test_runs_of_long_sequences():
    assert periodic.runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    r = random.Random(1)
    root = [r.randrange(100) for _ in range(5000)]
    w = [7] * 9 + [r.randrange(50) for _ in range(100)] + (root * 5)[:23_456] + [101] * 3 + [1, 2, 3] * 50
    got = periodic.runs(np.array(w, np.int64))
    assert (109, 23_456, 5000) in [(a, n, p) for a, n, p in got] and (0, 9, 1) in got and any(p == 3 and n >= 150 for _, n, p in got)
    # Fibonacci words have as many repetitions as can be, none of them four times over.
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert periodic.runs(np.array(b, np.int64)) == []


def told(i, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    found = plain(w)
    drop = {x for a, length, q in found for x in range(a + q, a + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in found)
    kept = " ".join(x for k, x in enumerate(w) if k not in drop)
    return (i, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


ROWS = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\r\n"), (4, "x"), (5, "la " * 6), (6, "la " * 5), (7, "é 🙂 " * 4 + "é"), (7, "é 🙂 " * 4 + "é"), (8, "a b " * 7), (9, "a b c " * 8 + "d d d d d d")]
SCHEMA = "doc_id long, text string, runs string, n_words int, Collapsed string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    more = [(100 + i, " ".join(r.choice("abcdefghij") for _ in range(r.randrange(0, 120)))) for i in range(150)]
    return cut(spark.createDataFrame([(i, t, "r", 1, "c") for i, t in [*ROWS, *more]], SCHEMA).repartition(3))


def test_report(spark, docs):
    got = sorted((tuple(r) for r in periodic.report(docs).collect()), key=str)
    assert got == sorted((told(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert sum(x[1] > 0 for x in got) > 15
    assert periodic.report(cut(spark.createDataFrame([], SCHEMA))).count() == 0


def test_columns_pass_through(docs):
    found = periodic.with_runs(docs)
    assert found.columns == [*docs.columns, "n_words_", "runs_", "collapsed_"] and found.count() == docs.count()
    got = {r["doc_id"]: r for r in periodic.collapse(docs).collect()}
    assert got[5]["text"] == "la" and got[6]["text"] == "la " * 5 and got[1]["text"] is None and got[9]["text"] == "a b c d" and got[9]["Collapsed"] == "c"


def test_documents_in_groups_are_apart(monkeypatch):
    r = random.Random(9)
    texts = [[str(r.randrange(3)).encode() for _ in range(r.randrange(0, 30))] for _ in range(40)]
    alone = [next(periodic._searched([t])) for t in texts]
    assert list(periodic._searched(texts)) == alone


def test_query_on_a_table(spark):
    from tracelake.llm.queries import op12_periodic_runs

    sf = "/root/testdata/sf0.001"
    short = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 2500").collect()}
    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(got[i] == told(i, t) for i, t in short.items())
