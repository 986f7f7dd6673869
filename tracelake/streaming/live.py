"""Structured Streaming: appending facts as artifact files arrive, live shared entities by time bucket, and what must be said once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..session import checkpoint_dir
from ..sources import store


def append_facts(spark: SparkSession, folder: str, schema: StructType, to_facts: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **options: str) -> StreamingQuery:
    """Files that arrive are normalised and appended to a versioned store, a commit for each batch.

    The version remembers the stream's last batch, so one that runs again adds nothing; readers see whole batches only,
    and other writers may append meanwhile. Facts get places behind those of their case.
    """
    arriving = spark.readStream.schema(schema).options(**options).format(options.pop("format", "parquet")).load(folder)

    def add(batch: DataFrame, number: int) -> None:
        store.append(to_facts(batch), path, (checkpoint, number))

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str) -> DataFrame:
    return store.load(spark, path)


def live_shared(entities: DataFrame, minutes: int, late: str = "1 hour", least: int = 2) -> DataFrame:
    """Entities on several hosts within each window, of a stream of fact_entities rows. minutes must divide an hour, where window() and bucket_start() agree."""
    if 60 % minutes:
        raise ValueError("bucket size must divide an hour")
    w = entities.withWatermark("time", late).groupBy(F.window("time", f"{minutes} minutes").alias("w"), "entity_key").agg(F.size(F.collect_set(F.lower("host"))).alias("hosts"), F.count("*").alias("facts"))
    return w.where(F.col("hosts") >= least).select(F.col("w.start").alias("bucket"), F.col("w.end").alias("bucket_end"), "entity_key", "hosts", "facts")


class _Once(StatefulProcessor):
    """The first row of each key; the key is forgotten `hours` after it was last seen."""

    def __init__(self, hours: float):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", int(self.hours * 3_600_000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = not self.seen.exists()
        self.seen.update((True,))
        for part in rows:
            if new and len(part):
                new = False
                yield part.head(1)

    def close(self) -> None:
        pass


def once(rows: DataFrame, *key: str, hours: float | None = None) -> DataFrame:
    """A stream without the rows whose key came before; of rows that arrive again, the first stays.

    hours: how long after a key's last arrival it is remembered; without it, for good. The bound is on arrival, so
    no row is lost for its time. A stream with a bound looks for keys to forget in batches without rows, so it runs until it is stopped;
    one that should end when all is read (completed()) has none. Keys should be those of single
    facts; a key's state is one flag. The stream must be started within keeping().

    For good, Spark drops the rows itself, a state row for each key and no call of Python; a bound on arrival calls it for each key of a batch.
    """
    if hours is None:
        return rows.dropDuplicates(list(key))
    return rows.groupBy(*key).transformWithStateInPandas(_Once(hours), rows.schema, "append", "processingTime")


class _SecondHost(StatefulProcessor):
    """A key's first host, until a second one comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "host string, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, told = self.state.get() if self.state.exists() else (None, False)
        before, second = first, None
        for part in rows:
            for host in () if told or second is not None else (*part["lo"], *part["hi"]):
                if first is None:
                    first = host
                elif host != first:
                    second = host
                    break
        if second is not None:
            self.state.update((first, True))
            yield pd.DataFrame({"entity_key": [key[0]], "hosts": [sorted((first, second))]})
        elif before is None:
            self.state.update((first, False))

    def close(self) -> None:
        pass


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of a batch, with the least and greatest of its hosts."""
    for b in batches:
        g = pa.Table.from_batches([b]).group_by("entity_key").aggregate([("host", "min"), ("host", "max")])
        yield from g.select(["entity_key", "host_min", "host_max"]).rename_columns(["entity_key", "lo", "hi"]).combine_chunks().to_batches()


def second_hosts(entities: DataFrame) -> DataFrame:
    """A01 on a stream: (entity_key, hosts) once for each entity, when its second host arrives, however late or in whatever order; hosts: those two.

    A key's state is a host and a flag, kept for good, so the keys told are those of the batch query over all
    rows. Each task brings a key to one row for an Arrow batch before the shuffle, so a very common entity
    comes to few rows. Hosts are compared without case; rows without a key or host are left out. The stream must be
    started within keeping().
    """
    rows = entities.select("entity_key", F.lower("host").alias("host")).where("entity_key IS NOT NULL AND host IS NOT NULL")
    ends = rows.mapInArrow(_ends, "entity_key string, lo string, hi string")
    return ends.groupBy("entity_key").transformWithStateInPandas(_SecondHost(), "entity_key string, hosts array<string>", "append", "none")


@contextmanager
def keeping(spark: SparkSession):
    """While a stream with state of its own is started: the state store that such streams need. A running stream keeps it.

    Every batch commits each partition's state, however little it holds, so a new stream has two partitions for each core
    and not those of a large shuffle, and commits what changed.
    """
    parts, store = "spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore"
    few = min(int(spark.conf.get(parts)), 2 * spark.sparkContext.defaultParallelism)
    wanted = {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
        parts: str(few),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def completed(rows: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What a stream gives until it has read all there is, written with its checkpoint and state to a folder below spark.checkpoint.dir, a new one or one it goes on with.

    In append mode each batch adds the rows that are settled; a batch that runs again
    replaces its own folder. In complete mode the last batch counts.
    """
    spark = rows.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{folder}/result/batch=-1")  # stays if there is no batch

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number if mode == 'append' else 0}")

    rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/result")
