"""Taking in folders of evidence: <root>/<case>/..., artifacts by name at any depth, each file judged before it is read.

A case is a folder below the root; its host is what a `Hostname:` line of its system_info.txt says, else the folder's
name. Cases stay apart even where inner folders or hosts have equal names. Every file is hashed in chunks, whatever its
size, and in the same pass judged: a file that cannot be opened or read to its end, a text that is not UTF-8 or
holds zero bytes, and a document cut off in the middle are left out with a warning for their case, and all else stays.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from . import tables

#: Bytes that are read of a file at once.
CHUNK = 4 << 20
#: Sidecars and task documents are parsed to see that they are whole, up to this size; larger ones are not judged for that.
DOCUMENT = 64 << 20
TEXTS = ("csv", "txt", "xml", "json")
HOST_FILE, COVERAGE_FILE = "system_info.txt", "collection_coverage.json"
# Fixed values.
PROFILES = ("Standard", "TriageFast", "ForensicStrict")


def opened(file: str):
    """A stream over a file by its URI or path, local or of any store that Arrow reaches."""
    from pyarrow import fs

    scheme, _, rest = file.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    if "://" not in file:
        return fs.LocalFileSystem().open_input_stream(file)
    system, path = fs.FileSystem.from_uri(file.replace("%", "%25").replace(" ", "%20"))
    return system.open_input_stream(path)


class _Judge:
    """What speaks against a text artifact, chunk by chunk."""

    def __init__(self, kind: str, size: int):
        self.kind, self.reason, self.read = kind, None, 0
        self.decoder = codecs.getincrementaldecoder("utf-8")()
        self.kept: list[str] | None = [] if kind in ("json", "xml") and size <= DOCUMENT else None

    def see(self, chunk: bytes, last: bool = False) -> None:
        if self.reason:
            return
        try:
            text = self.decoder.decode(chunk, last)
        except UnicodeDecodeError as e:
            self.reason = f"badly encoded: no UTF-8 near byte {self.read + e.start}"
            return
        at = chunk.find(b"\0")
        if at >= 0:
            self.reason = f"torn: zero byte at {self.read + at}"
        self.read += len(chunk)
        if self.kept is not None:
            self.kept.append(text)

    def end(self) -> str | None:
        self.see(b"", True)
        if self.reason or self.kept is None:
            return self.reason
        text = "".join(self.kept).removeprefix("\ufeff")
        if self.kind == "json":
            try:
                json.loads(text)
            except ValueError as e:
                return f"torn: {e}"
        elif len(re.findall(r"<Task[\s>]", text)) != text.count("</Task>"):
            return "torn: a task document has no end"
        return None


def _probe(file: str, name: str, size: int) -> tuple[int | None, str | None, str | None]:
    """(bytes read, SHA-256, what speaks against the file) in memory of a chunk; a file that cannot be read has no digest."""
    kind = name.rpartition(".")[2].lower()
    sha, judge, n = hashlib.sha256(), _Judge(kind, size) if kind in TEXTS else None, 0
    try:
        with opened(file) as stream:
            while chunk := stream.read(CHUNK):
                sha.update(chunk)
                n += len(chunk)
                if judge:
                    judge.see(bytes(chunk))
    except (OSError, pa.ArrowException) as e:
        return None, None, f"unreadable: {type(e).__name__}"
    return n, sha.hexdigest(), judge.end() if judge else None


def probed(files: DataFrame) -> DataFrame:
    """tables.listing() with size as read, sha256, and reason, what speaks against a file, else null.

    Files are dealt to tasks at random; a file is one task's work, as a digest needs its bytes in order, but not one row's.
    """
    names = [c for c in files.columns if c != "size"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "size")

    def of(batches):
        for b in batches:
            seen = [_probe(f, n, s or 0) for f, n, s in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("file", "name", "size")), strict=True)]
            size, sha, reason = zip(*seen, strict=True) if seen else ((), (), ())
            cols = [b.column(b.schema.names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(reason, pa.string())], names=[*names, "size", "sha256", "reason"])

    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism).mapInArrow(of, f"{schema}, size long, sha256 string, reason string")


def literal(path: str) -> str:
    """A path whose special characters are not taken for a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def case_of(file: Column, root: str) -> Column:
    """The folder below root that a file lies in, at any depth."""
    tail = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root.rstrip("/")) + "/"
    plain = F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))
    return F.substring_index(F.substring(plain, F.locate(tail, plain) + len(tail), F.lit(1 << 20)), "/", 1)


def profile(raw: Column) -> Column:
    """A recorded profile by its canonical name; blank stays blank, an unknown one is the first."""
    low = F.lower(F.trim(X.text(raw)))
    out = F.when(low == "", "")
    for p in PROFILES[1:]:
        out = out.when(low == p.lower(), p)
    return out.otherwise(PROFILES[0])


@dataclass(frozen=True)
class Intake:
    """files: tables.listing() with sha256 and reason; paths: the chosen files of each artifact, by the name asked for."""

    spark: SparkSession
    root: str
    files: DataFrame
    paths: dict[str, list[str]]

    def at_home(self, rows: DataFrame) -> DataFrame:
        """Rows of a reader with their case's folder as host."""
        return rows.withColumn("host", case_of(F.col("file"), self.root))

    def coverage(self) -> DataFrame | None:
        """Coverage sidecars by case folder (host)."""
        if COVERAGE_FILE not in self.paths:
            return None
        return self.at_home(tables.sidecar(self.spark, self.paths[COVERAGE_FILE], tables.COVERAGE))

    def hosts(self) -> DataFrame:
        """(case_id, host) of every case."""
        cases = self.files.select(F.col("host").alias("case_id")).distinct()
        if HOST_FILE not in self.paths:
            return cases.withColumn("host", F.col("case_id"))
        named = tables.host_name(self.spark, self.paths[HOST_FILE], case_of(F.col("file"), self.root)).select(F.col("folder").alias("case_id"), "host")
        return cases.join(named, "case_id", "left").withColumn("host", F.coalesce("host", "case_id"))

    def warnings(self) -> DataFrame:
        """(case_id, rel, warning): a row for each file that was left out."""
        return self.files.where("reason IS NOT NULL").select(F.col("host").alias("case_id"), "rel", F.concat_ws(": ", "rel", "reason").alias("warning"))

    def cases(self) -> DataFrame:
        """case_id, host, ready, files, load_warnings, collection_mode_profile of every case."""
        c = tables.cases(self.files.where("reason IS NULL").select("host", "name").unionByName(self.files.where("reason IS NOT NULL").select("host", F.lit("").alias("name"))))
        w = self.warnings().groupBy("case_id").agg(F.array_sort(F.collect_list("warning")).alias("left_out"))
        out = c.drop("host").join(self.hosts(), "case_id").join(w, "case_id", "left")
        out = out.withColumn("load_warnings", F.concat("load_warnings", F.coalesce("left_out", F.array().cast("array<string>")))).drop("left_out")
        cover = self.coverage()
        if cover is None:
            return out.withColumn("collection_mode_profile", F.lit(""))
        p = cover.groupBy(F.col("host").alias("case_id")).agg(F.max(profile(F.col("collection_mode_profile"))).alias("collection_mode_profile"))
        return out.join(p, "case_id", "left").withColumn("collection_mode_profile", F.coalesce("collection_mode_profile", F.lit("")))


def take(spark: SparkSession, root: str, names: tuple[str, ...], keep=lambda df: df, cases: DataFrame | None = None) -> Intake:
    """Lists and judges the files below root, and chooses the artifacts `names` (and all `*_filtered.csv`) of each case.

    keep: cuts the lineage of the judged listing, which is used several times. cases: (case_id), the only folders whose files
    are opened, if given. Paths of chosen files reach the driver, as
    those of any files that Spark reads do.
    """
    listed = tables.listing(spark, root).where("file_in_case")
    if cases is not None:
        listed = listed.join(cases.select(F.col("case_id").alias("host")).distinct(), "host", "left_semi")
    files = keep(probed(listed.drop("file_in_case")))
    good = files.where("reason IS NULL")
    wanted = spark.createDataFrame([(n,) for n in sorted({*names, HOST_FILE, COVERAGE_FILE})], "rel string")
    chosen = tables.artifact(good, wanted).select("wanted", "file")
    logs = good.where(F.lower("name").endswith("_filtered.csv")).select(F.lit("*_filtered.csv").alias("wanted"), "file")
    paths: dict[str, list[str]] = {}
    for r in chosen.unionByName(logs).orderBy("wanted", "file").toLocalIterator():
        paths.setdefault(r["wanted"], []).append(literal(r["file"]))
    return Intake(spark, root, files, paths)


def prefetch(spark: SparkSession, path) -> DataFrame:
    """N07's input as an exported table: Executable, RunTimes and ReferencedFiles (each parted by `;`), RunCount, ParserNote."""
    t = tables.table(spark, path)
    parts = lambda n: F.filter(F.transform(F.split(tables.get(n), ";"), lambda x: F.trim(x)), lambda x: x != "")
    times = F.array_sort(F.filter(F.transform(parts("RunTimes"), lambda x: X.parse_time(x)), lambda x: x.isNotNull()), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    return t.select("file", "host", "i", tables.get("Executable").alias("executable"), times.alias("run_times"), parts("ReferencedFiles").alias("referenced"), F.expr("try_cast(f['runcount'] AS int)").alias("run_count"), tables.get("ParserNote").alias("note"))

