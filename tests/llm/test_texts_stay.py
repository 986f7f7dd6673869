"""Exact dedup looks rows up where their texts are read, so it joins no texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracelake.llm import exact
from tracelake.llm.common import cut


def test_dedup_joins_no_texts_and_compares_hot_groups(spark):
    rows = [(i, "Hot" if i % 2 else f"t{i % 900}") for i in range(5_000)] + [(None, "hot"), (7, None), (8, "")]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    d = exact.dedup(docs)
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
    assert Counter((r["text"] or "").lower() for r in d.collect()) == Counter({(t or "").lower() for _, t in rows})
    keyed = docs.withColumn("at", F.monotonically_increasing_id())
    g = exact.groups(keyed, row="at")
    assert exact.verified(keyed, g.where("group_size > 1"), "text", "at") == g.where("group_size > 1").select("digest").distinct().count()
    with pytest.raises(Exception, match="two texts share the digest"):
        exact.verified(keyed, g.withColumn("digest", F.lit(bytearray(b"same"))), "text", "at")
