"""What the pipeline's Python workers keep in memory between tasks."""

import subprocess
import sys

from pyspark.sql import functions as F

from tracelake.llm import exact
from tracelake.llm.common import cut


def test_stages_do_without_pandas():
    code = "import sys; from tracelake.llm import exact, packing, simhash; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=exact.__file__.rsplit("/tracelake", 1)[0]).stdout.strip() == "False"


def test_notes_are_found_by_place(spark):
    docs = cut(spark.range(1_000).repartition(3).withColumn("text", F.col("id").cast("string"))).withColumn("row", F.monotonically_increasing_id())
    some = docs.where("id % 7 = 0").select("row", F.encode("text", "UTF-8").alias("v"))
    url = exact._by_scan(some, "row", "notes")
    got = docs.select("id", exact._noted(url, "row", "v")("row").alias("v"), exact._noted(url, "row")("row").alias("there")).collect()
    assert {r["id"]: r["v"] and bytes(r["v"]) for r in got} == {i: str(i).encode() if i % 7 == 0 else None for i in range(1_000)}
    assert all(r["there"] == (r["id"] % 7 == 0) for r in got)
    none = exact._by_scan(some.where("row < 0"), "row", "none")
    assert docs.where(exact._noted(none, "row")("row")).count() == 0 and docs.where(exact._noted(none, "row", "v")("row").isNotNull()).count() == 0
