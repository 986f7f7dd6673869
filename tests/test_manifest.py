"""The digest of a host's manifest is made batch by batch."""

import hashlib
import random

from tracelake.operators import quality


def test_digest_in_batches(spark):
    r = random.Random(2)
    rows = [(h, r.choice("aAbB") + f"{i % 70}.txt", 1, f"{i:064x}") for i in range(400) for h in [r.choice(["x", "y", "y", "y", None, ""])]]
    m = spark.createDataFrame(rows, "host string, rel string, size long, sha256 string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x["host"]: (x["digest"], x["files"]) for x in quality.digest(m).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for h in {x[0] for x in rows}:
        own = sorted((x[1].lower(), x[1], x[3]) for x in rows if x[0] == h)
        assert got.pop(h) == (hashlib.sha256("".join(f"{p}\t{s}\n" for _, p, s in own).encode()).hexdigest(), len(own))
    assert not got and quality.digest(m.limit(0)).count() == 0
    plan = quality.digest(m)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
