"""A store of facts in versions, with an entity index: readers see one whole version, a commit is one rename.

    <path>/parts/<id>/facts      facts, range-partitioned by time and sorted by time and source
    <path>/parts/<id>/entities   the index: a row for each fact and entity key, range-partitioned and sorted by key, then time,
                                 with Bloom filters on the key; spellings and the keys of references are worked out on reading
    <path>/parts/<id>/zones      a row for each of these files: least and greatest key, time, source and host, schema versions
    <path>/parts/<id>/ends       each case's last place
    <path>/parts/<id>/sketch     a mergeable sketch of how often keys occur
    <path>/parts/<id>/ledger     the source files that the part's cases were built from, if they came from a folder
    <path>/parts/<id>/hidden     cases of earlier parts that this part replaces, if it does
    <path>/versions/<n>.json     the parts of version n

A part is written once and never changed. What a commit adds is invisible until its version file has its name; a
file of that name which is already there means that another writer was faster (`Conflict`). Appends then
start over from the new version, as their places depend on it. A reader keeps the version it opened, so
it never sees half a commit. Ranges of keys and times come from samples, so a key or an hour with a third of
all facts is spread over many files, and files that a question cannot touch are not opened: their names are
picked by a Spark filter over the zones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FACTS, OLDEST_VERSION, REF, SCHEMA_VERSION, conform, entity_key, host_of

#: Rows of a file, about.
FACTS_PER_FILE, ENTITIES_PER_FILE = 1_000_000, 1_000_000
#: Rows of a file of facts that are computed but not in order yet: few, so that all cores read them, whatever wrote them.
STAGED = 100_000
PACKED = {"compression": "zstd"}
#: Bytes of rows that a task holds before it packs them for the tasks that put them in order, and rows drawn of each range to find where it ends.
ROOM, DRAWN = 1 << 27, 100
#: Texts that many rows have in common.
ALIKE = ("case_id", "host", "fact_id", "time_kind", "time_confidence", "source", "action", "entity_refs.list.element.type", "source_file", "collection_step", "collection_status", "collection_privilege", "parse_level", "parser_note")
#: Keys of a lookup that are matched with files by name; more are looked up by a join with the whole index.
KEYS = 2_000
#: Keys that the frequency sketch follows: counts are off by at most 3.5 / TRACKED of all references.
TRACKED = 16_384

#: Of a fact_id that ends with a number, files hold the text before it, and in id_more the number less the fact's place, which is mostly the same for a whole source.
ID_MORE = T.StructField("id_more", T.LongType())
FACT_ROWS = T.StructType([*FACTS.fields, T.StructField("primary_key", T.StringType()), ID_MORE])
ENTITY_ROWS = T.StructType([
    *(FACTS[c] for c in ("case_id", "host", "fact_ord", "fact_id", "time", "source", "action", "time_confidence")),
    *(T.StructField(c, T.StringType()) for c in ("entity_type", "value_display", "value_norm", "entity_key")),
    T.StructField("entity_refs", T.ArrayType(REF)), T.StructField("ref_keys", T.ArrayType(T.StringType())),
])
#: What the index files hold of ENTITY_ROWS; the rest follows from it (named).
INDEX_ROWS = T.StructType([*(ENTITY_ROWS[c] for c in ("case_id", "host", "fact_ord", "fact_id", "time", "source", "action", "time_confidence", "entity_key", "entity_refs")), ID_MORE])
LEDGER, HIDDEN = "case_id string, rel string, size long, modified timestamp, tool string", "part string, case_id string"
ZONES = "part string, kind string, file string, rows long, bytes long, key_lo string, key_hi string, time_lo timestamp, time_hi timestamp, source_lo string, source_hi string, host_lo string, host_hi string, version_lo int, version_hi int"


class StoreError(ValueError):
    """A store that cannot be loaded."""


class Conflict(StoreError):
    """Another writer published the version first."""


def numbered(facts: DataFrame) -> DataFrame:
    """facts with their fact_id parted into fact_id and id_more."""
    number = F.nullif(F.regexp_extract("fact_id", r"([1-9][0-9]{0,17}|0)$", 1), F.lit(""))
    f = facts.withColumn("id_more", F.try_subtract(number.cast("long"), F.col("fact_ord")))
    return f.withColumn("fact_id", F.when(F.col("id_more").isNull(), F.col("fact_id")).otherwise(F.expr("left(fact_id, length(fact_id) - length(fact_ord + id_more))")))


def whole_ids(rows: DataFrame) -> DataFrame:
    """rows of files with their whole fact_id."""
    return rows.withColumn("fact_id", F.concat("fact_id", F.coalesce((F.col("fact_ord") + F.col("id_more")).cast("string"), F.lit(""))))


def named(index: DataFrame) -> DataFrame:
    """ENTITY_ROWS of index rows: what their key stands for is the first reference of the fact that has it."""
    keys = F.transform("entity_refs", lambda r: entity_key(r["type"], r["value"]))
    at = F.get("entity_refs", (F.array_position("ref_keys", F.col("entity_key")) - 1).cast("int"))
    e = whole_ids(index).withColumn("ref_keys", keys).withColumns({"entity_type": at["type"], "value_display": F.trim(at["value"]), "value_norm": F.lower(F.trim(at["value"]))})
    return e.select(*ENTITY_ROWS.names)


@dataclass(frozen=True)
class Snapshot:
    """One version of a store."""

    spark: SparkSession
    path: str
    version: int
    parts: tuple[str, ...]
    streams: dict = field(default_factory=dict, compare=False)
    #: Which parts have a ledger, and which hide cases of earlier parts.
    more: dict = field(default_factory=dict, compare=False)

    def having(self, kind: str) -> tuple[str, ...]:
        """The parts that have a table of this kind, ledger or hidden."""
        return tuple(p for p in self.more.get(kind, ()) if p in self.parts)

    def _read(self, kind: str, schema) -> DataFrame:
        reader = self.spark.read.schema(schema)
        parts = self.having(kind) if kind in ("ledger", "hidden") else self.parts
        return reader.parquet(*(f"{self.path}/parts/{p}/{kind}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def _shown(self, rows: DataFrame) -> DataFrame:
        """Rows read from files of parts, without the cases that a later part replaces, and _at, their part."""
        rows = rows.withColumn("_at", F.regexp_extract("_metadata.file_path", "/parts/([0-9a-f]{32})/[a-z]+/[^/]*$", 1))
        if not self.having("hidden"):
            return rows
        h = self._read("hidden", HIDDEN).select(F.col("part").alias("_part"), F.col("case_id").alias("_case"))
        return rows.join(h, (F.col("_at") == F.col("_part")) & F.col("case_id").eqNullSafe(F.col("_case")), "left_anti")

    def _rows(self, rows: DataFrame) -> DataFrame:
        return self._shown(rows).drop("_at") if self.having("hidden") else rows

    def ledger(self) -> DataFrame:
        """(case_id, rel, size, modified, tool, part): the source files that the store's cases were built from."""
        if not self.having("ledger"):
            return self.spark.createDataFrame([], LEDGER + ", part string")
        return self._shown(self._read("ledger", LEDGER)).withColumnRenamed("_at", "part")

    def zones(self) -> DataFrame:
        return self._read("zones", ZONES)

    def ends(self) -> DataFrame:
        """(case_id, last): the greatest place of each case."""
        return self._read("ends", "case_id string, last long").groupBy("case_id").agg(F.max("last").alias("last"))

    def files(self, kind: str, where: Column | None = None) -> list[str]:
        """The files of one kind (facts, entities) whose zone passes `where`. Only their names reach the driver."""
        z = self.zones().where(F.col("kind") == kind)
        return sorted(f"{self.path}/parts/{r['part']}/{kind}/{r['file']}" for r in (z if where is None else z.where(where)).select("part", "file").collect())

    def _some(self, kind: str, schema, where: Column) -> DataFrame:
        files = self.files(kind, where)
        return self._rows(self.spark.read.schema(schema).parquet(*files)) if files else self.spark.createDataFrame([], schema)

    def facts(self, start=None, end=None, source: str | None = None) -> DataFrame:
        """All facts, or those with a time in [start, end] and of a source; files outside are not opened."""
        if start is None and end is None and source is None:
            return conform(whole_ids(self._rows(self._read("facts", FACT_ROWS))))
        zone, row = F.lit(True), F.lit(True)
        for bound, z, holds in ((start, F.col("time_hi"), Column.__ge__), (end, F.col("time_lo"), Column.__le__)):
            if bound is not None:
                t = F.lit(bound).cast("timestamp")
                zone, row = zone & holds(z, t), row & holds(F.col("time"), t)
        if source is not None:
            zone, row = zone & (F.col("source_lo") <= source) & (F.col("source_hi") >= source), row & (F.col("source") == source)
        return conform(whole_ids(self._some("facts", FACT_ROWS, zone).where(row)))

    def entities(self, keys: list[str] | DataFrame | None = None) -> DataFrame:
        """The index, as model.fact_entities gives it: whole, or the rows of some keys (a list, or a frame of entity_key)."""
        if keys is None:
            return named(self._rows(self._read("entities", INDEX_ROWS)))
        if isinstance(keys, DataFrame):
            wanted = keys.select(F.lower("entity_key").alias("entity_key")).distinct()
            keys = [r[0] for r in wanted.limit(KEYS + 1).collect()]
            if len(keys) > KEYS:
                return named(self._rows(self._read("entities", INDEX_ROWS)).join(wanted, "entity_key", "left_semi"))
        keys = sorted({k.lower() for k in keys if k})
        if not keys:
            return self.spark.createDataFrame([], ENTITY_ROWS)
        held = F.exists(F.array(*map(F.lit, keys)), lambda k: (F.col("key_lo") <= k) & (F.col("key_hi") >= k))
        return named(self._some("entities", INDEX_ROWS, held).where(F.col("entity_key").isin(keys)))

    def frequent(self, least: int, most: int = 1_000) -> DataFrame:
        """(entity_key, facts): keys that at least `least` facts name, by the parts' merged sketches, at most `most` of them, most frequent first.

        Counts are off by at most 3.5 / TRACKED of all references, and hold those of replaced cases until their parts are compacted.
        """
        s = self.spark.read.parquet(*(f"{self.path}/parts/{p}/sketch" for p in self.parts)) if self.parts else None
        if s is None:
            return self.spark.createDataFrame([], "entity_key string, facts long")
        top = s.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED}), {most})").alias("t"))
        return top.select(F.explode("t").alias("t")).select(F.col("t.item").alias("entity_key"), F.col("t.count").alias("facts")).where(F.col("facts") >= least)


def _fs(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark._jsc.hadoopConfiguration()), to


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(folder))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _name(path: str, version: int) -> str:
    return f"{path}/versions/{version:020d}.json"


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest version, or a given one. Version 0 is a store that nobody has written yet."""
    path = path.rstrip("/")
    known = _versions(spark, path)
    at = (known[-1] if known else 0) if version is None else version
    if at == 0:
        return Snapshot(spark, path, 0, ())
    if at not in known:
        raise StoreError(f"no version {at} in {path}")
    told = json.loads(spark.read.text(_name(path, at), wholetext=True).first()[0])
    return Snapshot(spark, path, at, tuple(told["parts"]), told["streams"], told.get("more", {}))


def publish(base: Snapshot, parts: tuple[str, ...], streams: dict | None = None, more: dict | None = None) -> Snapshot:
    """Makes `parts` the version after base, by renaming a finished file to a name that nobody may have taken."""
    spark, number = base.spark, base.version + 1
    streams = base.streams if streams is None else streams
    more = {kind: [p for p in held if p in parts] for kind, held in (base.more if more is None else more).items()}
    fs, to = _fs(spark, _name(base.path, number))
    jvm = spark._jvm
    fs.mkdirs(to.getParent())
    temporary = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(json.dumps({"version": number, "parts": list(parts), "streams": streams, "more": more}).encode())
    out.close()
    kept = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    kept[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(temporary, to, kept)
    except Py4JJavaError as e:
        fs.delete(temporary, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Conflict(f"version {number} of {base.path} was published by another writer") from None
        raise
    return Snapshot(spark, base.path, number, tuple(parts), streams, more)


def _blocks(rows: pa.Table, bounds: pa.Table) -> pa.RecordBatch:
    """(range, block): rows of each range between bounds as a Parquet file, in the order of the bounds' columns, nulls first."""
    by, n = bounds.column_names, bounds.num_rows
    keys = rows.select(by)
    both = pa.concat_tables([bounds.cast(keys.schema), keys]).append_column("_row", pa.array(np.arange(n + len(keys)) >= n).cast(pa.int8())).combine_chunks()
    order = pc.sort_indices(both, sort_keys=[(c, "ascending") for c in (*by, "_row")], null_placement="at_start").to_numpy()
    row = order >= n
    at, rows = np.cumsum(~row)[row], rows.take(order[row] - n)
    leaves = pq.ParquetFile(_file(rows.slice(0, 0))).schema
    texts = [c.path for c in map(leaves.column, range(len(leaves))) if c.physical_type == "BYTE_ARRAY" and c.path not in ALIKE]
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
    how = {"use_dictionary": list(ALIKE), "column_encoding": dict.fromkeys(texts, "DELTA_LENGTH_BYTE_ARRAY")}
    blocks = [_file(rows.slice(a, b - a), **how) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]], pa.int32()), pa.array([memoryview(b) for b in blocks], pa.binary())], ["range", "block"])


def _file(rows: pa.Table, **how) -> pa.Buffer:
    out = pa.BufferOutputStream()
    pq.write_table(rows, out, compression="zstd", write_statistics=False, store_schema=False, **how)
    return out.getvalue()


def _ranged(df: DataFrame, rows: int, per_file: int, *by: str) -> DataFrame:
    """df cut into files by ranges: of per_file rows at most, about, and as many as give each core the same share, down to an eighth of per_file.

    The ranges' bounds come from a sample. Rows are shuffled in compressed blocks, one for each range of what a task holds, which are about a quarter of
    what they are as single rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rounds = -(-rows // (per_file * cores))
    n = max(1, min(rounds * cores, -(-8 * rows // per_file)))
    keys = df.select(*by)
    drawn = (keys.sample(min(1.0, DRAWN * n / rows), 7) if n > 1 else keys.limit(0)).toArrow()
    drawn = drawn.take(pc.sort_indices(drawn, sort_keys=[(c, "ascending") for c in by], null_placement="at_start"))
    bounds = drawn.take(pa.array([i * len(drawn) // n for i in range(1, n) if len(drawn)], pa.int64()))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= ROOM:
                yield _blocks(pa.Table.from_batches(held), bounds)
                held, size = [], 0
        if size:
            yield _blocks(pa.Table.from_batches(held), bounds)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.column(0):
                yield from pq.read_table(pa.BufferReader(block.as_buffer())).to_batches()

    dealt = df.mapInArrow(packed, "range int, block binary").repartitionById(n, F.col("range")).select("block")
    return dealt.mapInArrow(unpacked, df.schema).sortWithinPartitions(*by)


def _index(facts: DataFrame) -> DataFrame:
    """INDEX_ROWS of facts: model.fact_entities without what follows from a key and the references, which need not be carried through the explode."""
    keys = F.array_distinct(F.transform("entity_refs", lambda r: entity_key(r["type"], r["value"])))
    rows = facts.withColumn("host", host_of(F.col("host"))).select("*", F.explode(keys).alias("entity_key"))
    return rows.where("entity_key IS NOT NULL").select(*INDEX_ROWS.names)


def _zones(spark: SparkSession, base: str, part: str, kind: str, schema, key: str) -> DataFrame:
    """A row for each file of a part, from its narrow columns, with a sketch of the keys of an index file.

    Spark counts up by hash beside collect_set or a sketch; least and greatest texts alone would have every row sorted.
    """
    rows = spark.read.schema(schema).parquet(f"{base}/{kind}")
    version, sketch = ("schema_version", []) if kind == "facts" else ("CAST(NULL AS int)", [F.expr(f"approx_top_k_accumulate(entity_key, {TRACKED})").alias("sketch")])
    lo_hi = [f(c).alias(f"{n}_{end}") for n, c in (("key", key), ("time", "time"), ("host", "host")) for f, end in ((F.min, "lo"), (F.max, "hi"))]
    lo_hi += [f(F.collect_set("source")).alias(f"source_{end}") for f, end in ((F.array_min, "lo"), (F.array_max, "hi"))]
    g = rows.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    g = g.agg(F.count("*").alias("rows"), *lo_hi, F.min(F.expr(version)).alias("version_lo"), F.max(F.expr(version)).alias("version_hi"), *sketch)
    return g.withColumns({"part": F.lit(part), "kind": F.lit(kind)})


def write_part(facts: DataFrame, path: str, per_file: tuple[int, int] = (FACTS_PER_FILE, ENTITIES_PER_FILE)) -> str:
    """Writes facts as a new part, which no version has yet; its id. The facts are computed once, whatever they come from."""
    spark, part = facts.sparkSession, uuid.uuid4().hex
    base = f"{path.rstrip('/')}/parts/{part}"
    first = F.get("entity_refs", F.lit(0))
    keyed = conform(facts).withColumns({"primary_key": entity_key(first["type"], first["value"]), "schema_version": F.coalesce("schema_version", F.lit(SCHEMA_VERSION))})
    numbered(keyed).select(*FACT_ROWS.names).write.options(maxRecordsPerFile=STAGED, **PACKED).parquet(f"{base}/staged")
    staged = spark.read.schema(FACT_ROWS).parquet(f"{base}/staged")
    seen = staged.agg(F.count("*"), F.sum(F.size("entity_refs"))).first()
    ends = staged.groupBy("case_id").agg(F.max("fact_ord").alias("last"))
    _write(base, part, staged, _index(staged), (seen[0], seen[1] or 0), ends, per_file)
    fs, to = _fs(spark, f"{base}/staged")
    fs.delete(to, True)
    return part


def _write(base: str, part: str, facts: DataFrame, index: DataFrame, rows: tuple[int, int], ends: DataFrame, per_file: tuple[int, int]) -> None:
    """The tables of a part: of FACT_ROWS and INDEX_ROWS, about so many, that read the same way twice."""
    spark = facts.sparkSession
    _ranged(facts, rows[0], per_file[0], "time", "source", "case_id", "fact_ord").write.options(**PACKED).parquet(f"{base}/facts")
    bloom = {"parquet.bloom.filter.enabled#entity_key": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    _ranged(index, rows[1], per_file[1], "entity_key", "time", "case_id", "fact_ord").write.options(**bloom, **PACKED).parquet(f"{base}/entities")
    ends.write.parquet(f"{base}/ends")
    zones = _zones(spark, base, part, "facts", FACT_ROWS, "primary_key").unionByName(_zones(spark, base, part, "entities", INDEX_ROWS, "entity_key"), allowMissingColumns=True)
    zones.write.parquet(f"{base}/zoned")
    zoned = spark.read.schema(zones.schema).parquet(f"{base}/zoned")
    zoned.select(*T.StructType.fromDDL(ZONES).names).coalesce(1).write.parquet(f"{base}/zones")
    # A part without a key has a sketch too, and no task of the combination may be without one.
    none = spark.range(0).select(F.col("id").cast("string").alias("entity_key")).agg(F.expr(f"approx_top_k_accumulate(entity_key, {TRACKED})").alias("sketch"))
    zoned.where("sketch IS NOT NULL").select("sketch").unionByName(none).coalesce(1).agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch")).write.parquet(f"{base}/sketch")
    fs, to = _fs(spark, f"{base}/zoned")
    fs.delete(to, True)


def after(facts: DataFrame, ends: DataFrame) -> DataFrame:
    """facts with places behind the last one of their case, in the same order. ends: (case_id, last)."""
    used = ends.select(F.col("case_id").alias("_case"), (F.col("last") + 1).alias("_next"))
    moved = facts.join(used, F.col("case_id").eqNullSafe(F.col("_case")), "left").withColumn("fact_ord", F.col("fact_ord") + F.coalesce("_next", F.lit(0)))
    return moved.select(facts.columns)


def _placed(facts: DataFrame, base: Snapshot) -> DataFrame:
    """facts behind those of a version. The first ones of a store keep their places, so they are not joined, which would shuffle them by case."""
    return after(facts, base.ends()) if base.parts else facts


def save(facts: DataFrame, path: str, **how) -> Snapshot:
    """Replaces all facts of a store in one commit. facts may come from the store itself. Conflict if another writer commits meanwhile."""
    base = snapshot(facts.sparkSession, path)
    return publish(base, (write_part(facts, base.path, **how),))


def append(facts: DataFrame, path: str, stream: tuple[str, int] | None = None, tries: int = 5, **how) -> Snapshot:
    """Adds facts behind those of their case, starting over if another writer is faster.

    stream: (name, batch number) of a stream whose batches may run again: a batch that is in the store already is left out.
    """
    spark = facts.sparkSession
    for left in reversed(range(tries)):
        base = snapshot(spark, path)
        if stream and base.streams.get(stream[0], -1) >= stream[1]:
            return base
        part = write_part(_placed(facts, base), base.path, **how)
        try:
            return publish(base, (*base.parts, part), base.streams | ({stream[0]: stream[1]} if stream else {}))
        except Conflict:
            if not left:
                raise
    raise AssertionError


def _noted(base: Snapshot, part: str, **tables: DataFrame | None) -> dict:
    """base.more with these tables (ledger, hidden) of a part that is not published yet, written; tables without a row are left out."""
    more = {kind: list(held) for kind, held in base.more.items()}
    for kind, rows in tables.items():
        if rows is not None and not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{base.path}/parts/{part}/{kind}")
            more.setdefault(kind, []).append(part)
    return more


def replace_cases(facts: DataFrame, ledger: DataFrame, path: str, tries: int = 5, **how) -> Snapshot:
    """Facts take the place of what the cases in `ledger` had from their folders, in one commit; what those cases have from elsewhere stays.

    ledger: LEDGER rows of every case that is replaced, those without a fact included. Places are never used again.
    """
    spark = facts.sparkSession
    cases = ledger.select("case_id").distinct()
    for left in reversed(range(tries)):
        base = snapshot(spark, path)
        part = write_part(_placed(facts, base), base.path, **how)
        old = base.ledger().select("part", "case_id").distinct().join(cases, "case_id", "left_semi").select("part", "case_id")
        try:
            return publish(base, (*base.parts, part), more=_noted(base, part, ledger=ledger, hidden=old))
        except Conflict:
            if not left:
                raise
    raise AssertionError


def compact(spark: SparkSession, path: str, small: int = FACTS_PER_FILE // 2, tries: int = 5, **how) -> Snapshot:
    """Merges parts of at most `small` facts into one, cut anew by time and key, without what later parts replaced.

    Parts from folders, which have a ledger, are merged among themselves, and so are the others. Appends meanwhile
    are kept; a save meanwhile is a Conflict.
    """
    base = snapshot(spark, path)
    sizes = base.zones().where("kind = 'facts'").groupBy("part").agg(F.sum("rows").alias("n"))
    large = {r["part"] for r in sizes.where(F.col("n") > small).select("part").collect()}
    from_folders = set(base.having("ledger"))
    for merged in ([p for p in base.parts if p not in large and (p in from_folders) is ledgered] for ledgered in (False, True)):
        if len(merged) > 1:
            base = _merged(base, merged, tries, **how)
    return base


def _rewritten(own: Snapshot, facts: DataFrame, index: DataFrame, exact: bool, per_file: tuple[int, int] = (FACTS_PER_FILE, ENTITIES_PER_FILE)) -> str:
    """A new part of rows that parts of `own` hold, index rows too, so neither is worked out again. exact: the rows are counted, where zones may count too many."""
    part = uuid.uuid4().hex
    held = {r["kind"]: r["n"] for r in own.zones().groupBy("kind").agg(F.sum("rows").alias("n")).collect()}
    rows = (facts.count(), index.count()) if exact else (held.get("facts", 0), held.get("entities", 0))
    _write(f"{own.path}/parts/{part}", part, facts, index, rows, own.ends(), per_file)
    return part


def _merged(base: Snapshot, merged: list[str], tries: int, **how) -> Snapshot:
    spark, path = base.spark, base.path
    own = Snapshot(spark, path, base.version, tuple(merged), {}, base.more)
    known = base.having("hidden")
    live = lambda kind, schema: base._shown(own._read(kind, schema)).drop("_at")
    part = _rewritten(own, live("facts", FACT_ROWS), live("entities", INDEX_ROWS), exact=bool(known), **how)
    ledger = live("ledger", LEDGER) if own.having("ledger") else None
    hidden = own._read("hidden", HIDDEN).where(~F.col("part").isin(merged)) if own.having("hidden") else None
    for left in reversed(range(tries)):
        if not set(merged) <= set(base.parts) or base.having("hidden") != known:
            break
        try:
            return publish(base, (*(p for p in base.parts if p not in merged), part), more=_noted(base, part, ledger=ledger, hidden=hidden))
        except Conflict:
            if not left:
                raise
            base = snapshot(spark, path)
    raise Conflict(f"parts of {path} were replaced while they were merged")


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Deletes versions before the last `keep`, and parts that no version left names; how many parts. Call it when no commit is under way."""
    path = path.rstrip("/")
    known = _versions(spark, path)
    used = {p for v in known[-keep:] for p in snapshot(spark, path, v).parts}
    for v in known[:-keep]:
        fs, to = _fs(spark, _name(path, v))
        fs.delete(to, False)
    fs, folder = _fs(spark, f"{path}/parts")
    gone = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in used] if fs.exists(folder) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The facts of a version. Raises if there is none, or one has an unsupported schema version; the zones say so without a look at the facts."""
    s = snapshot(spark, path, version)
    z = s.zones().where("kind = 'facts'")
    refuse(z.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.min("version_lo").alias("lo"), F.max("version_hi").alias("hi")).first())
    return s.facts()


def refuse(seen) -> None:
    """Raises for n = 0 facts, or schema versions lo to hi that are not supported."""
    if not seen["n"]:
        raise StoreError("no readable fact")
    if seen["lo"] < OLDEST_VERSION or seen["hi"] > SCHEMA_VERSION:
        raise StoreError(f"unsupported schema version {seen['lo']} to {seen['hi']}")

