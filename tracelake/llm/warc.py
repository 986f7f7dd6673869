"""WARC archives: writing with payload dedup, and a Spark data source that reads them.

Each record is written as a gzip member of its own whose header carries the WARC skip-lengths field
(`sl`: compressed and plain length of the member), so a reader gets from record to record without
inflating what it does not want. Other archives are read too: gzip members without that field are
inflated to find the next, but what is not wanted is not kept or decoded; plain `.warc` files are
stepped through by their content lengths. The source plans partitions of bounded size within gzip
files: a reader starts at the first member that begins in its range and reads as WARC, and takes all
records of the members that begin there. Plain files are a partition each. In all of them a record's
headers are parsed first and held against the pushed-down filters on record type and headers; its
payload is decoded only if it passes, and only if payloads are asked for (option payload) or to be
checked against their digests (option verify). A file without any record is an error.

Of records with equal payloads of at least `least` bytes, that with the largest id is a response
and the others are revisit records that name it. Equal payloads are found by their SHA-1 alone;
payloads are dealt once, to be joined with what they are to become.

Cases: a null html is an empty payload; a null url gives a record without target; of equal largest
ids one record stays a response; null ids count as smallest and are written as such; an empty table writes no record;
extra columns are ignored; a payload of any size is one record (a member too long for the field's 32
bits is written without it); in archives of others, payload_bytes counts the bytes after the HTTP
headers, or all of a block that is not HTTP.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .common import cut, numbered
from .tokens import store

#: A member's first 16 bytes (deflate, extra field, no time, any system, 12 bytes of extra, of which 8 in "sl").
HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SPLIT = 64 << 20
WRITE = "page_id long, url string, html string, refers_to long"
READ = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Columns that hold a header's value, and can be filtered before a payload is touched.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def name_of(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: The same without the extra field.
PLAIN = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
MAGIC, MOST = b"\x1f\x8b\x08", 0xFFFFFFFF


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = len(HEAD) + 8 + len(body) + 8
    # The trailer holds the length modulo 2 ** 32 by definition; the skip-lengths must be exact.
    head = HEAD + struct.pack("<II", size, len(data)) if size <= MOST and len(data) <= MOST else PLAIN
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {clean}"] if clean is not None else []), f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name_of(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Written(WriterCommitMessage):
    def __init__(self, own: str, final: str):
        self.own, self.final = own, final


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file under a name of its own; commit gives the files of the tasks that count their final names."""

    def __init__(self, url: str):
        self.url = url

    def write(self, batches):
        system, folder = store(self.url)
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        final = f"{folder}/part-{task.partitionId():05d}.warc.gz"
        own = f"{folder}/.{task.partitionId()}.{task.taskAttemptId()}"
        with system.open_output_stream(own) as out:
            for b in batches:
                for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    out.write(member(record(page_id, url, (html or "").encode(), refers_to, revisit)))
        return Written(own, final)

    def commit(self, messages):
        system, _ = store(self.url)
        for m in messages:
            if m is not None:
                system.move(m.own, m.final)

    def abort(self, messages):
        system, _ = store(self.url)
        for m in messages:
            if m is not None:
                system.delete_file(m.own)


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, url: str, payload: bool, verify: bool, split: int):
        self.url, self.payload, self.verify, self.split = url, payload, verify, split
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if name in HEADERS and len(f.attribute) == 1:
                have = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & have if name in self.wanted else have
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, folder = store(self.url)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        files = [i for i in sorted(found, key=lambda i: i.path) if i.is_file and i.base_name.endswith((".warc.gz", ".warc")) and i.size]
        return [Part(i.path, at, at + self.split) for i in files for at in range(0, i.size if i.path.endswith(".gz") else 1, self.split)] or [Part("", 0, 0)]

    def read(self, part):
        system, _ = store(self.url)
        if not part.path:
            return
        rows, size = [], 0
        with system.open_input_file(part.path) as f:
            for row in self._gzip(f, part) if part.path.endswith(".gz") else self._records(Plain(f), part.path):
                rows.append(row)
                size += len(row[-1] or b"")
                if len(rows) >= 5000 or size > 16 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
        if rows:
            yield _rows(rows)

    def _gzip(self, f, part):
        at = first_member(f, part.start)
        if at is None and not part.start or (part.start == 0 and at):
            raise ValueError(f"{part.path}: no WARC record at its start")
        while at is not None and at < min(part.end, f.size()):
            member = Member(f, at)
            yield from self._records(member, part.path)
            at = member.next()

    def _records(self, stream, path):
        """Rows of the wanted records of a stream. Goes on to the end unless the stream says that one record is all."""
        while (head := stream.header()) is not None:
            if not head.startswith(b"WARC/"):
                raise ValueError(f"{path}: no WARC record where one should begin")
            fields = dict(parsed(head))
            length = int(fields["content-length"])
            row = [fields.get(h) for h in HEADERS.values()]
            if row[4] is not None:
                row[4] = row[4].removeprefix("sha1:")
            if all(v in self.wanted.get(c, (v,)) for c, v in zip(HEADERS, row, strict=True)):
                yield self._row(stream, fields, row, length)
            elif not stream.single:
                stream.skip(length)
            if stream.single:
                return

    def _row(self, stream, fields, row, length):
        http = fields.get("content-type", "").startswith("application/http")
        whole = (self.payload or self.verify) and row[0] != "revisit"
        block = stream.take(length) if whole else stream.start(length, b"\r\n\r\n") if http else b""
        head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
        if row[0] == "revisit":
            size = int(dict(parsed(head)).get("content-length", 0))
        else:
            size = length - (len(head) + 4 if http else 0)
        if not whole and not stream.single:
            stream.skip(length - len(block))
        if self.verify and whole and row[4] is not None and digest_of(payload) != row[4]:
            raise ValueError(f"payload of {row[1]} differs from its digest")
        return (*row, max(0, size), payload if self.payload and whole else None)


class Stream:
    """Records in turn: a header, then `length` bytes of block that are taken, started or skipped."""

    single = False  # whether a reader knows where the next record is without reading on

    def __init__(self):
        self.held = b""

    def more(self) -> bytes:
        """Next bytes; none at the end."""
        raise NotImplementedError

    def header(self) -> bytes | None:
        """Up to the blank line, which is passed; None at the end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            head, mark, rest = self.held.partition(b"\r\n\r\n")
            if mark:
                self.held = rest
                return head
            if not (data := self.more()):
                if self.held:
                    raise ValueError("the archive ends within a record's headers")
                return None
            self.held += data

    def take(self, length: int) -> bytes:
        parts, n = [self.held], len(self.held)
        while n < length and (data := self.more()):
            parts.append(data)
            n += len(data)
        if n < length:
            raise ValueError("the archive ends within a record")
        block = b"".join(parts)
        self.held = block[length:]
        return block[:length]

    def start(self, length: int, mark: bytes) -> bytes:
        """The block's bytes up to a mark, the mark included, or all of it."""
        while mark not in self.held[:length] and len(self.held) < length and (data := self.more()):
            self.held += data
        at = self.held[:length].find(mark)
        return self.take(length if at < 0 else at + len(mark))

    def skip(self, length: int) -> None:
        while len(self.held) < length:
            length -= len(self.held)
            self.held = self.more()
            if not self.held:
                raise ValueError("the archive ends within a record")
        self.held = self.held[length:]


class Plain(Stream):
    """An uncompressed file."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def more(self):
        return self.f.read(1 << 16)

    def skip(self, length):
        if length <= len(self.held):
            self.held = self.held[length:]
            return
        to = self.f.tell() + length - len(self.held)
        if to > self.f.size():
            raise ValueError("the archive ends within a record")
        self.f.seek(to)
        self.held = b""


class Member(Stream):
    """A gzip member. With skip-lengths it holds one record, and the next member's place is known."""

    def __init__(self, f, at: int):
        super().__init__()
        self.f, self.at = f, at
        f.seek(at)
        first = f.read(4096)
        self.single = first.startswith(HEAD)
        self.size = struct.unpack_from("<I", first, len(HEAD))[0] if self.single else None
        self.z, self.raw, self.fed = zlib.decompressobj(31), first[: self.size], 0

    def more(self):
        while not self.z.eof:
            raw = self.raw or self.f.read(1 << 16 if self.size is None else min(1 << 16, self.size - self.fed))
            if not raw:
                if self.size is None or self.fed < self.size:
                    raise ValueError(f"the member at {self.at} has no end")
                return b""
            self.raw = b""
            self.fed += len(raw)
            if data := self.z.decompress(raw):
                return data
        return b""

    def next(self) -> int | None:
        """Where the next member begins, once all of this one's records are read; None at the end of the file."""
        if self.single:
            return self.at + self.size
        after = self.at + self.fed - len(self.z.unused_data)
        return after if after < self.f.size() else None


def parsed(head: bytes):
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        yield k.strip().lower(), v.strip()


def first_member(f, start: int) -> int | None:
    """Where the first gzip member at or after start begins that holds a WARC record at its start."""
    f.seek(start)
    kept, at = b"", start
    while more := f.read(1 << 16):
        kept += more
        i = kept.find(MAGIC)
        while i >= 0:
            if begins(f, at + i):
                return at + i
            i = kept.find(MAGIC, i + 1)
        f.seek(at + len(kept))
        at += max(0, len(kept) - len(MAGIC) + 1)
        kept = kept[-len(MAGIC) + 1 :]
    return None


def begins(f, at: int) -> bool:
    f.seek(at)
    try:
        return zlib.decompressobj(31).decompress(f.read(4096), 16).lstrip(b"\r\n").startswith(b"WARC/")
    except zlib.error:
        return False


def _rows(rows):
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])


class WarcSource(DataSource):
    """format("warc"): load(folder) with options payload, verify (true or false) and split (bytes); save(folder) of WRITE with a boolean revisit."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ

    def reader(self, schema):
        yes = lambda k: self.options.get(k, "false").lower() == "true"
        return WarcReader(self.options["path"], yes("payload"), yes("verify"), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(pages: DataFrame, url: str, key: str = "page_id", uri: str = "url", html: str = "html", least: int = 0) -> None:
    """Archives pages. pages must give the same rows in the same order when read again, as a table does."""
    register(pages.sparkSession)
    p = numbered(pages.select(F.col(key).cast("long").alias("page_id"), F.col(uri).alias("url"), F.col(html).alias("html")), "row")
    payload = F.coalesce("html", F.lit(""))
    k = cut(p.select("page_id", "row", F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n")), "payloads").where(F.col("n") >= least)
    top = k.groupBy("sha").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", "row")).alias("top"), F.count("*").alias("copies")).where("copies > 1")
    again = k.join(top, "sha").where("row <> top.row").select("row", F.col("top.page_id").alias("refers_to"), F.lit(True).alias("again"))
    out = p.join(again, "row", "left").select("page_id", "url", "html", "refers_to", F.coalesce("again", F.lit(False)).alias("revisit"))
    out.write.format("warc").mode("append").save(url)


def read(spark: SparkSession, url: str, payload: bool = False, verify: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).option("verify", verify).load(url)


def page_of(column: str):
    """The page id in a record id."""
    return F.nullif(F.regexp_extract(column, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
