"""Session defaults."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("tracelake").config(map=DEFAULTS | conf)
    return (b.master(master) if master else b).getOrCreate()


def tuned(spark: SparkSession) -> SparkSession:
    """The defaults that can be set on a running session."""
    for k, v in DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session may do without the setting: it gets a folder of its own; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"tracelake-{spark.sparkContext.applicationId}")
