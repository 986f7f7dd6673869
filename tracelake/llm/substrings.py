"""Suffix-array dedup: removes bytes covered by a 200-byte string that also starts anywhere else.

Texts are UTF-8 bytes. Every 200-byte window has an anchor: within it, the place with the least
hash of 32 bytes. Equal windows have equal anchors at equal distance, so windows can only be equal
if their anchors' hashes are. A run of windows with the same anchor forms a segment, of 369 bytes at
most, and one row for each segment (anchor hash, segment hash, place) is all that is shuffled.

- A segment that occurs twice is repeated as a whole; two 64-bit hashes decide.
- An anchor hash with several different segments is mixed. One of each of its segments, with its
  bytes, goes to a shard chosen by the anchor hash. Windows that no other segment of their anchor can
  have, told by the bytes that neighbouring windows share, are left out. The rest of a shard is joined to one text whose
  repeated windows are found by induced suffix sorting with common-prefix values (suffixes.py),
  which keeps its queues on disk.
- A mixed anchor with very many different segments would make one shard large. Its segments are
  first cut into narrower runs of windows, told apart by the bytes that all windows of a run share,
  until few are left in each; the narrowest runs are single windows. Nothing is dropped on the way.

Bytes are fetched, and spans cut out, where a text is read: what a scan partition needs lies in a
folder of its own in the shared store, so texts are never shuffled. Rows are known by the scan
partition and their place in it, so docs must give the same rows in the same order when read again,
as a table does.

Cases: a null text counts as empty; texts under 200 bytes lose nothing; repeated rows repeat each
other, so all of their bytes go if there are 200; a text may repeat itself, overlaps included;
null doc_ids are carried as null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, partitions, shared_dir
from .suffixes import Room, repeats
from .tokens import store

LENGTH, GRAM = 200, 32
#: Bytes handled at once; places in a piece take PLACE bits.
PIECE, PLACE = 1 << 20, 24
#: Different segments of an anchor that one shard takes, bytes of a shard, and the widths of narrower runs.
MANY, SHARD, WIDTHS = 256, 1 << 20, (48, 12, 3, 1)
#: Distances from the anchor whose windows are told apart by one core before sorting.
CLASS = 24
#: Tuples that the sorter's queues hold in memory, and the longest text of names that it sorts there. A shard has some
#: 500,000 suffixes a scan and 340,000 names, so both go to disk, and the names one level deeper.
TUPLES, NAMES = 1 << 18, 1 << 18

_P = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_TABLE = np.random.default_rng(11).integers(1, 2**63, (2, 256), dtype=np.uint64)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and its inverse for i < n."""
    while len(_POWERS) < 2:
        _POWERS.append((np.ones(1, np.uint64), np.ones(1, np.uint64)))
    if len(_POWERS[k][0]) < n:
        n = max(n, PIECE + 2 * LENGTH)
        step = np.array([_P[k], pow(_P[k], -1, 1 << 64)], np.uint64)
        _POWERS[k] = tuple(np.r_[np.uint64(1), np.full(n - 1, s, np.uint64)].cumprod(dtype=np.uint64) for s in step)
    return _POWERS[k]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any span of some bytes."""

    def __init__(self, b: np.ndarray, k: int):
        self.power, self.inverse = _powers(k, len(b) + 1)
        self.sums = np.r_[np.uint64(0), (_TABLE[k][b] * self.power[: len(b)]).cumsum(dtype=np.uint64)]

    def of(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + np.asarray(end - start, np.uint64))


def least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x) - w + 1
    full = np.r_[x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)].reshape(-1, w)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(b: np.ndarray, bounds: np.ndarray):
    """Segments of the texts that lie one after the other in b, ending at bounds: (start, bytes, anchor place, anchor hash, segment hash)."""
    empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    if len(b) < LENGTH:
        return empty
    one = Hashes(b, 0)
    at = np.arange(len(b) - GRAM + 1)
    h = one.of(at, at + GRAM)
    key = (h & ~np.uint64((1 << PLACE) - 1)) | at.astype(np.uint64)
    anchor = (least(key, LENGTH - GRAM + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    p = np.arange(len(anchor))
    text = np.searchsorted(bounds, p, side="right")
    p = p[p + LENGTH <= bounds[text]]
    if not len(p):
        return empty
    a, t = anchor[p], text[p]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])])
    start, end = p[first], p[np.r_[first[1:] - 1, len(p) - 1]] + LENGTH
    return start, end - start, a[first], h[a[first]], Hashes(b, 1).of(start, end)


ROW = "hash long, seg long, pid int, row long, start long, n int, off int"


def _signed(x):
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _texts(batches):
    """(row, bytes, first byte's place) of texts in groups of about PIECE bytes; a longer text in pieces that overlap by a window."""
    held, size = [], 0
    for b in batches:
        for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            raw = (t or "").encode()
            for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
                part = raw[at : at + PIECE + LENGTH - 1]
                if held and size + len(part) > PIECE:
                    yield held
                    held, size = [], 0
                held.append((row, part, at))
                size += len(part)
    if held:
        yield held


def _rows(batches):
    for held in _texts(batches):
        bounds = np.cumsum([len(x[1]) for x in held])
        start, n, anchor, h, seg = segments(np.frombuffer(b"".join(x[1] for x in held), np.uint8), bounds)
        t = np.searchsorted(bounds, start, side="right")
        origin = np.r_[0, bounds[:-1]]
        shift = np.array([x[2] for x in held], np.int64) - origin
        row = np.array([x[0] for x in held], np.int64)[t]
        cols = [_signed(h), _signed(seg), pa.array((row >> 33).astype(np.int32)), pa.array(row), pa.array(start + shift[t]), pa.array(n.astype(np.int32)), pa.array((anchor - start).astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in ROW.split(", ")])


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return numbered(docs.select(F.col(text).alias("text"), F.col(key).cast("long").alias("doc_id")), "row").select("row", "text", "doc_id")


def _by_scan(df: DataFrame, name: str) -> str:
    """df (pid, row, ...) in a folder for each scan partition."""
    url = shared_dir(df.sparkSession, name)
    df.repartition(partitions(df.sparkSession), "pid").sortWithinPartitions("pid", "row", "start").write.partitionBy("pid").parquet(url)
    return url


def _needed(url: str, pid: int, columns: list[str]) -> dict[int, list[tuple]]:
    """What a scan partition's rows need, by row."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, folder = store(url)
    found = system.get_file_info(fs.FileSelector(f"{folder}/pid={pid}", allow_not_found=True))
    out: dict[int, list[tuple]] = {}
    for f in found:
        if f.base_name.endswith(".parquet"):
            with system.open_input_file(f.path) as stream:
                t = pq.ParquetFile(stream).read(columns=["row", *columns])
            for row, *rest in zip(*(c.to_pylist() for c in t.columns), strict=True):
                out.setdefault(row, []).append(tuple(rest))
    return out


PIECES = "hash long, m long, pid int, row long, start long, off int, data binary"


def _fetch(url: str):
    def of(batches):
        needed = None
        for b in batches:
            out = []
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if needed is None:
                    needed = _needed(url, row >> 33, ["hash", "m", "start", "n", "off"])
                if row in needed:
                    raw = (t or "").encode()
                    out += [(h, m, row >> 33, row, start, off, raw[start : start + n]) for h, m, start, n, off in needed.pop(row)]
            yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array([x[i] for x in out], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for i, c in enumerate(PIECES.split(", "))})

    return of


def _short(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _narrower(width: int):
    """Pieces cut into runs of at most `width` windows, at the same distances from the anchor in all pieces; the bytes that all windows of a full run share make their new hash."""

    def of(batches):
        for b in batches:
            out = []
            for h, m, pid, row, start, off, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first, last = -off, len(data) - LENGTH - off  # windows by their distance from the anchor
                for block in range(first // width, last // width + 1):
                    lo, hi = max(first, block * width), min(last, block * width + width - 1)
                    core = data[block * width + width - 1 + off : block * width + LENGTH + off]
                    own = data[lo + off : hi + LENGTH + off]
                    out.append((_short(b"%d %d %d " % (h, block, width) + core), _short(own), m, pid, row, start + lo + off, -lo, own))
            yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array([x[i] for x in out], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]]) for i, c in enumerate(("hash long, seg long, " + PIECES.split(", ", 1)[1]).split(", "))})

    return of


SPAN = "pid int, row long, start long, end long"


WHERE = np.dtype([("all", "<i8"), ("pid", "<i4"), ("row", "<i8"), ("start", "<i8"), ("n", "<i4")])


def _alive(pieces: list[tuple]) -> list[tuple]:
    """Of the pieces (m, pid, row, start, off, data) of one anchor, those that may share a window with another, cut to these windows, without off.

    Windows at CLASS neighbouring distances from the anchor have bytes in common, their core, so equal windows have equal
    cores. Where no other piece has a core, no window around it is repeated; where all that have it occur as a whole
    elsewhere, they are settled. What is left is sorted.
    """
    cores: dict[tuple[int, bytes], list[int]] = {}
    for i, (*_, off, data) in enumerate(pieces):
        for j in range((off - len(data) + LENGTH) // CLASS, off // CLASS + 1):
            at = off - j * CLASS
            cores.setdefault((j, data[at : at - CLASS + 1 + LENGTH]), []).append(i)
    ends: dict[int, tuple[int, int]] = {}
    for (j, _), same in cores.items():
        if len(same) > 1 and any(pieces[i][0] == 1 for i in same):
            for i in same:
                lo, hi = ends.get(i, (j, j))
                ends[i] = min(lo, j), max(hi, j)
    out = []
    for i, (lo, hi) in ends.items():
        m, pid, row, start, off, data = pieces[i]
        first, last = max(0, off - hi * CLASS - CLASS + 1), min(len(data) - LENGTH, off - lo * CLASS)
        out.append((m, pid, row, start + first, data[first : last + LENGTH]))
    return out


def _shard(batches):
    """Repeated windows among the pieces of a partition, as spans of those that stand for one place.

    Pieces come in order of their anchors, of which few have one; those that may repeat go to a text on disk, which ends
    between two anchors, once it has SHARD bytes.
    """
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    with tempfile.TemporaryDirectory() as folder:
        text, where, size = f"{folder}/text", f"{folder}/where", 0
        for _, same in groupby(rows, lambda r: r[0]):
            pieces = _alive([r[1:] for r in same])
            if not pieces:
                continue
            if size >= SHARD:
                yield from _sorted(text, where, folder)
                size = 0
            with open(text, "ab" if size else "wb") as f, open(where, "ab" if size else "wb") as g:
                for m, pid, row, start, data in pieces:
                    f.write(np.append(np.frombuffer(data, np.uint8).astype("<i2") + 1, 0).astype("<i2").tobytes())
                    g.write(np.array([(m, pid, row, start, len(data))], WHERE).tobytes())
                    size += len(data)
        if size:
            yield from _sorted(text, where, folder)


def _sorted(text: str, where: str, folder: str):
    hit = repeats(np.memmap(text, "<i2", "r"), LENGTH, folder, Room(tuples=TUPLES, small=NAMES))
    pieces, at = np.memmap(where, WHERE, "r"), 0
    for i in range(0, len(pieces), 100_000):
        out = []
        for m, pid, row, start, n in pieces[i : i + 100_000].tolist():
            if m == 1 and len(p := np.flatnonzero(hit[at : at + n])):
                gap = np.flatnonzero(np.diff(p) > LENGTH)
                out += [(pid, row, start + int(i), start + int(j) + LENGTH) for i, j in zip(p[np.r_[0, gap + 1]], p[np.r_[gap, len(p) - 1]], strict=True)]
            at += n + 1
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["pid", "row", "start", "end"])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans (pid, row, start, end) that cover the bytes to go; they may overlap."""
    d, spark = keyed(docs, key, text), docs.sparkSession
    a = cut(d.select("row", "text").mapInArrow(_rows, ROW).withColumn("id", F.monotonically_increasing_id()), "segments")
    g = cut(a.groupBy("hash", "seg").agg(F.count("*").alias("m"), F.min("id").alias("id")), "kinds")
    often = g.where("m > 1").select("hash", "seg")
    found = [a.join(often, ["hash", "seg"]).select("pid", "row", "start", (F.col("start") + F.col("n")).alias("end"))]
    several = g.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1")
    first = g.join(several, "hash").select("id", "m", "k")
    want = a.join(first, "id").select("pid", "row", "hash", "m", "k", "start", "n", "off")
    want = cut(want, "mixed")
    kinds = want.select("hash", "k").distinct()
    left = cut(d.select("row", "text").mapInArrow(_fetch(_by_scan(want, "wanted")), PIECES), "pieces").join(kinds, "hash")
    few = [left.where(F.col("k") <= MANY).drop("k")]
    left = cut(left.where(F.col("k") > MANY).drop("k"), "many")
    for width in WIDTHS:
        if left.isEmpty():
            break
        runs = cut(left.select([c.split()[0] for c in PIECES.split(", ")]).mapInArrow(_narrower(width), "hash long, seg long, " + PIECES.split(", ", 1)[1]), "runs")
        g = cut(runs.groupBy("hash", "seg").agg(F.sum("m").alias("all"), F.min("row").alias("row")), "run-kinds")
        twice = g.where(F.col("all") > 1).select("hash", "seg")
        found.append(runs.where("m = 1").join(twice, ["hash", "seg"]).select("pid", "row", "start", (F.col("start") + F.length("data")).alias("end")))
        several = g.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1")
        one = g.select("hash", "seg", "row", "all")
        stand = runs.join(one, ["hash", "seg", "row"]).groupBy("hash", "seg").agg(F.min("all").alias("m"), F.min(F.struct("pid", "row", "start", "off", "data")).alias("s"))
        left = cut(stand.join(several, "hash").select("hash", "m", "s.*", "k"), "left")
        few.append(left.where(F.col("k") <= MANY).select([c.split()[0] for c in PIECES.split(", ")]))
        left = left.where(F.col("k") > MANY)
    shards = few[0]
    for f in few[1:]:
        shards = shards.unionByName(f)
    shards = cut(shards, "shards")
    size = shards.agg(F.sum(F.length("data"))).first()[0] or 0
    n = max(partitions(spark), size // (32 * SHARD))
    dealt = shards.repartition(int(n), "hash").sortWithinPartitions("hash").select("hash", "m", "pid", "row", "start", "off", "data")
    found.append(dealt.mapInArrow(_shard, SPAN))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(cuts: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(cuts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _cut(url: str, make, names: list[str], kinds: list):
    def of(batches):
        needed = None
        for b in batches:
            rows = []
            for row, t, doc_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if needed is None:
                    needed = _needed(url, row >> 33, ["start", "end"])
                raw, runs = (t or "").encode(), merged(needed.pop(row, []))
                kept, at = [], 0
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                rows.append(make(doc_id, t, raw, runs, b"".join(kept) + raw[at:]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return of


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT of every row: bytes, bytes removed, maximal removed runs, and the SHA-256 of what stays."""
    url = _by_scan(spans(docs, key, text).distinct(), "spans")
    make = lambda doc, t, raw, runs, kept: (doc, len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest())
    kinds = [pa.int64()] * 4 + [pa.string()]
    return keyed(docs, key, text).mapInArrow(_cut(url, make, [c.split()[0] for c in RESULT.split(", ")], kinds), RESULT)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept binary, removed array of [start, end)) of every row. What stays may end within a character."""
    url = _by_scan(spans(docs, key, text).distinct(), "spans")
    make = lambda doc, t, raw, runs, kept: (doc, kept, runs)
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
    return keyed(docs, key, text).mapInArrow(_cut(url, make, ["doc_id", "kept", "removed"], kinds), "doc_id long, kept binary, removed array<array<long>>")
