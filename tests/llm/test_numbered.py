"""Rows are known by their place in the scan, whatever cores Spark has at the next read."""

from collections import Counter

import pytest

from tracelake.llm import exact, mixing, simhash, substrings
from tracelake.llm.common import table

SF = "/root/testdata/sf0.001"
CUT = ("spark.sql.files.minPartitionNum", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")


def spans(docs):
    return substrings.report(docs).select("doc_id", "n_removed")


@pytest.mark.parametrize("stage", [exact.dedup, simhash.dedup, mixing.mix, spans])
def test_rows_stay_when_an_executor_is_lost_between_two_reads(spark, stage):
    """a file that was cut anew had other row numbers, so what was noted of its rows was found for none, or for others."""
    kept = {k: spark.conf.get(k, None) for k in CUT}
    docs = table(spark, SF, "documents")
    rows = lambda df: Counter(map(tuple, df.collect()))
    try:
        spark.conf.unset(CUT[0])
        spark.conf.set(CUT[2], "1000")
        spark.conf.set(CUT[1], "4")
        want = rows(stage(docs))
        spark.conf.unset(CUT[0])
        found = stage(docs)
        spark.conf.set(CUT[1], "2")
        assert rows(found) == want and want
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
