"""Token ids in flat binary files.

Rows are dealt by ranges of (key, hash of the text, place in the scan), so neither a key nor a text that
very many rows share goes to one task, and each partition encodes its rows in that order and writes
three files: `ids` (the tokens of all its documents, unsigned integers one after the other), `offsets`
(64-bit, one more than documents: where each starts in the partition) and `docs` (64-bit keys).
Partition bases, the tokens in all partitions before, are prefix sums of the partitions' totals, so no
task needs to see another's data. Each attempt of a task writes files of its own; the manifest, written
last, names those that count. The ids are memory-mapped when read.

Cases: a null text counts as empty and still gets its end id; null keys sort first and come back as
null; equal keys keep all their rows, in order of a hash of their texts; very long texts are encoded
whole; an id that the files' integers cannot hold is an error; an empty table writes no partition;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import ChainMap
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions

NO_KEY = np.iinfo(np.int64).min


#: Fixed value: how byte-level BPE files of this kind cut a text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


class Encoder:
    """Little-endian unsigned 32-bit ids of a text, by a byte-level BPE file of the tokenizers library.

    Such a tokenizer first cuts a text into words, none of which reaches over a blank that stands
    before a visible character, and then merges each word by itself. Words recur: texts are cut at
    those blanks, the library's model merges each new word, and up to `most` words of at most LONG
    characters are remembered for as long as the process lives. Texts with other blanks or with one of
    the tokenizer's added tokens in them, and tokenizers of other kinds, are encoded by the library
    as a whole; so are texts with a character outside PLAIN, since the library may class it by an older
    edition of Unicode. A test holds every character of PLAIN against the library.
    """

    PLAIN = ((0x0, 0x52F), (0x590, 0x86F), (0x900, 0xAFF), (0x1E00, 0x206F), (0x20A0, 0x2E7F), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFFFF), (0x1F300, 0x1FAFF))
    BLANKS, LONG, STOPS = re.compile(r" (?:\s|\Z)"), 64, ".,;:!?"
    OTHER = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in PLAIN) + "]")
    _own: dict[str, Encoder] = {}

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        pre = json.loads(self.tok.to_str()).get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and self.tok.normalizer is None
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.largest = max(self.tok.get_vocab(with_added_tokens=True).values(), default=0)
        self.cut = regex.compile(CUT).findall
        self.letters = byte_letters()
        self.merge = self.tok.model.tokenize
        self.stops = {c: self.word(c) for c in self.STOPS} if self.cuts else {}
        self.most = most
        self.known: dict[str, bytes] = {}  # by what follows a blank
        self.inner: dict[str, bytes] = {}  # by words without a blank

    @classmethod
    def of(cls, path: str) -> Encoder:
        """This process's encoder for a file."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def odd(self, text: str) -> bool:
        """Whether a text must be encoded as a whole. Texts of one byte a character, which is most, need no look at each."""
        if self.BLANKS.search(text) or any(t in text for t in self.added):
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.OTHER.search(text) is not None
        return False

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def part(self, p: str) -> bytes:
        """Ids of what stands between two blanks, with the first of them; words, and words before one sign of STOPS, are told at once."""
        if p.isalpha():
            return self.word(" " + p)
        stem = p[:-1]
        if p[-1] in self.STOPS and stem.isalpha():
            ids = self.known.get(stem)
            if ids is None:
                ids = self.word(" " + stem)
                if len(stem) <= self.LONG:
                    self.known[stem] = ids
            return ids + self.stops[p[-1]]
        return self._words(" " + p)

    def _words(self, text: str) -> bytes:
        out = []
        for w in self.cut(text):
            blank = w[0] == " "
            memo, k = (self.known, w[1:]) if blank and len(w) > 1 else (self.inner, w)
            ids = memo.get(k)
            if ids is None:
                ids = self.word(w)
                if len(w) <= self.LONG:
                    memo[k] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cuts or self.odd(text):
            return self.whole(text)
        if len(self.known) + len(self.inner) > self.most:
            self.known.clear()
            self.inner.clear()
        first, *rest = text.split(" ")
        known, own = self.known, {}
        for p in set(rest).difference(known):
            memo = known if len(p) <= self.LONG else own
            memo[p] = self.part(p)
        if own:
            known = known | own if len(known) < len(rest) else ChainMap(own, known)
        return self._words(first) + b"".join([known[p] for p in rest])


def store(url: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    parts = urlparse(url)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(url)


def put(url: str, name: str, write) -> None:
    """A file under its final name once write(stream) has ended."""
    system, folder = store(url)
    system.create_dir(folder, recursive=True)
    task = TaskContext.get()
    own = f"{folder}/.{name}.{task.taskAttemptId() if task else 0}"
    with system.open_output_stream(own) as out:
        write(out)
    system.move(own, f"{folder}/{name}")


def narrowed(ids: bytes, width: str) -> bytes:
    """ids as integers of a width, all of which it must hold."""
    if width == "<u4":
        return ids
    a = np.frombuffer(ids, "<u4")
    if len(a) and a.max() > np.iinfo(width).max:
        raise ValueError(f"id {a.max()} does not fit {width}")
    return a.astype(width).tobytes()


def write(docs: DataFrame, url: str, path: str, end: int, key: str = "doc_id", text: str = "text", n: int | None = None) -> list[dict]:
    """Writes the files; gives a manifest: part, docs, tokens and base (tokens before) of each partition, in key order.

    Ids take two bytes if all of the tokenizer's fit, else four.
    """
    n = n or partitions(docs.sparkSession)
    width = "<u2" if max(Encoder.of(path).largest, end) < 1 << 16 else "<u4"
    last = np.array([end], "<u4").tobytes()

    def save(batches):
        enc, keys, counts = Encoder.of(path), [], []
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"

        def body(out):
            for b in chain([first], batches):
                for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = enc.ids(t.as_py() or "") + last
                    keys.append(NO_KEY if k is None else k)
                    counts.append(len(ids) // 4)
                    out.write(narrowed(ids, width))

        put(url, f"{name}.ids", body)
        put(url, f"{name}.offsets", lambda out: out.write(np.r_[0, np.cumsum(counts)].astype("<i8").tobytes()))
        put(url, f"{name}.docs", lambda out: out.write(np.array(keys, "<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "name": [name], "docs": pa.array([len(keys)], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64())})

    order = [F.col("key").asc_nulls_first(), F.col("hash"), F.col("row")]
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    d = d.select("key", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    dealt = d.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")
    done = dealt.mapInArrow(save, "part int, name string, docs long, tokens long").collect()  # a row for each partition
    totals = sorted((r.asDict() for r in done), key=lambda r: r["part"])
    base = 0
    for t in totals:
        t |= {"base": base, "width": width}
        base += t["tokens"]
    put(url, "manifest.json", lambda out: out.write(json.dumps(totals).encode()))
    return totals


def mapped(url: str, name: str, width: str) -> np.ndarray:
    """A file's integers: memory-mapped where the folder is a local or mounted one, else read."""
    system, folder = store(url)
    if system.type_name == "local":
        size = os.path.getsize(f"{folder}/{name}")
        return np.memmap(f"{folder}/{name}", width, "r") if size else np.empty(0, width)
    with system.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read(), width)


def read(spark: SparkSession, url: str) -> DataFrame:
    """(key, start, ids) of each document in the files; start: the ids of all documents before it."""
    return _read(spark, url, lambda ids: ids.astype("<u4").tobytes(), pa.binary(), "ids binary")


def checksums(spark: SparkSession, url: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the files."""
    return _read(spark, url, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32 long")


def _read(spark: SparkSession, url: str, of, kind, column: str) -> DataFrame:
    system, folder = store(url)
    with system.open_input_file(f"{folder}/manifest.json") as f:
        parts = json.loads(f.read())
    schema = f"key long, start long, n_tokens long, {column}"
    if not parts:
        return spark.createDataFrame([], schema)

    def each(batches):
        for b in batches:
            for _, name, base, width in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, offsets, keys = (mapped(url, f"{name}.{x}", w) for x, w in (("ids", width), ("offsets", "<i8"), ("docs", "<i8")))
                for i in range(0, len(keys), 4096):
                    o, k = offsets[i : i + 4097], np.array(keys[i : i + 4096])
                    made = pa.array([of(ids[a:b]) for a, b in zip(o[:-1], o[1:], strict=True)], kind)
                    yield pa.RecordBatch.from_arrays([pa.array(k, mask=k == NO_KEY), pa.array(o[:-1] + base), pa.array(np.diff(o)), made], ["key", "start", "n_tokens", column.split()[0]])

    listed = spark.createDataFrame([(i, p["name"], p["base"], p["width"]) for i, p in enumerate(parts)], "part int, name string, base long, width string")
    return listed.repartitionById(len(parts), F.col("part")).mapInArrow(each, schema)
