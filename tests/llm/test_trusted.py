"""Every trusted document counts, however many there are."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import quality
from tracelake.llm.common import cut


def test_all_trusted_documents_count(spark):
    r = spark.range(-20, 14_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 97).cast("string"), F.lit(" u"), (F.col("id") % 89).cast("string")).alias("text"))
    docs = cut(r.unionByName(r.where("doc_id = 5")).unionByName(spark.createDataFrame([(None, "x y")], "doc_id long, text string")))
    labels = spark.range(-30, 12_500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 3, 0).otherwise(1).alias("quality"))
    labels = labels.unionByName(labels.limit(40))
    trusted = {i for i in range(-30, 12_500) if i % 50 != 3}
    rows = docs.select("doc_id", quality.features(F.col("text")).alias("f")).collect()
    raw, good = Counter(), Counter()
    for r in rows:
        raw.update(r["f"])
        good.update(r["f"] if r["doc_id"] in trusted else ())
    n = quality.BUCKETS
    ratio = {b: np.log((good[b] + 1) / (good.total() + n)) - np.log((raw[b] + 1) / (raw.total() + n)) for b in raw}
    want = sorted((str(r["doc_id"]), np.mean([ratio[b] for b in r["f"]])) for r in rows)
    got = sorted((str(r["doc_id"]), r["score"]) for r in quality.judge(docs, labels).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_ids_of_any_kind(spark):
    ids = [None, 0, 1, 63, 64, -1, -64, -65, 2**62, -(2**63), 2**63 - 1, 7, 7]
    some = [1, 63, -1, -65, 2**62, -(2**63), 7, 12, 1]
    for kind in ("long", "string"):
        d = spark.createDataFrame([(i,) for i in ids], "id long").select(F.col("id").cast(kind).alias("id"))
        k = spark.createDataFrame([(i,) for i in some], "_k long").select(F.col("_k").cast(kind).alias("_k"))
        for most in (quality.MASKS, 0):
            got = Counter((r["id"] and int(r["id"]), r["g"]) for r in quality.marked(d, k, "id", "g", most).collect())
            assert got == Counter((i, i in some) for i in ids)
