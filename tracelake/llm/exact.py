"""Exact dedup over a cuckoo-filter index of digests.

Texts are equal when they are identical after lower-casing A-Z. Each row's normalised text becomes
a SHA-256 digest; digests are dealt to index partitions, each of which keeps a cuckoo filter. A
filter slot holds a short fingerprint and the place of the stored record it stands for, so that a
hit is verified against that record's whole digest at once; an insertion that finds no room doubles
the filter and fills it anew from the stored digests. Then `verified` holds the contents of all rows
that share a digest against each other, byte by byte, in buckets of bounded share.

The index takes insertions and deletions of live rows: a record counts the rows that share its
digest, a deletion takes one off, and the record goes with the last of them. When the row that stays
is deleted, its successor is looked up among the live rows.

Copies are counted up within each batch before they are dealt, so a group of copies with a third of
all rows sends one row a batch. To find copies only digests are shuffled, to verify them the texts of
rows that have one, once. Which rows these are, and which stay, is looked up where the texts are read, in
a folder of the shared store for each scan partition, so docs must read the same way twice.

Cases: a null text counts as empty, and all empty texts form one group; of rows with equal text and
equal largest doc_id exactly one stays; null doc_ids count as smaller than any other; very long texts
are digested and compared whole; an empty table gives an empty result; extra columns pass through
`dedup` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, numbered, partitions, shared_dir
from .tokens import store

#: Digests that one index partition holds at most, on average.
PER_PARTITION = 400_000
INSERT, DELETE = 0, 1


class CuckooIndex:
    """Digests with a value each, behind a cuckoo filter of four slots a bucket."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self.records: list[list | None] = []
        self.free: list[int] = []
        self.resizes = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.places: list[list[int]] = [[] for _ in range(buckets)]

    def _of(self, digest: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(digest[:8], "little")
        mark = h >> 48
        one = h & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ ((mark + 1) * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> list | None:
        """The live record of a digest: [digest, *value]. Filter hits with another digest are passed over."""
        mark, one, two = self._of(digest)
        for b in (one, two):
            for p, at in zip(self.prints[b], self.places[b], strict=True):
                if p == mark and self.records[at][0] == digest:
                    return self.records[at]
        return None

    def insert(self, record: list) -> None:
        """A digest that is not there yet."""
        if self.free:
            at = self.free.pop()
            self.records[at] = record
        else:
            at = len(self.records)
            self.records.append(record)
        if not self._place(at):
            self._grow()

    def _place(self, at: int) -> bool:
        mark, one, two = self._of(self.records[at][0])
        b = one if len(self.prints[one]) <= len(self.prints[two]) else two
        for k in range(self.KICKS):
            if len(self.prints[b]) < self.SLOTS:
                self.prints[b].append(mark)
                self.places[b].append(at)
                return True
            s = k % self.SLOTS
            mark, self.prints[b][s] = self.prints[b][s], mark
            at, self.places[b][s] = self.places[b][s], at
            b = self._other(b, mark)
        return False

    def _grow(self) -> None:
        size = 2 * (self.mask + 1)
        while True:
            self.resizes += 1
            self._empty(size)
            if all(self._place(at) for at, r in enumerate(self.records) if r is not None):
                return
            size *= 2

    def delete(self, digest: bytes) -> bool:
        mark, one, two = self._of(digest)
        for b in (one, two):
            for s, (p, at) in enumerate(zip(self.prints[b], self.places[b], strict=True)):
                if p == mark and self.records[at][0] == digest:
                    del self.prints[b][s], self.places[b][s]
                    self.records[at] = None
                    self.free.append(at)
                    return True
        return False

    def live(self) -> Iterator[list]:
        return (r for r in self.records if r is not None)


def _newer(a: tuple, b: tuple) -> bool:
    """Whether (doc_id, row) a comes after b; null ids first."""
    return (a[0] is not None, a[0] or 0, a[1]) > (b[0] is not None, b[0] or 0, b[1])


CHANGE = "op int, digest binary, id long, row long, n long"
ENTRY = "digest binary, id long, row long, n long"
#: The row of a record whose kept row was deleted, until a live one takes its place.
OPEN = -1


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One index partition: takes changes in order, gives what is live at the end."""
    index = CuckooIndex()
    for batch in batches:
        for op, digest, i, row, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            have = index.find(digest)
            if op == DELETE:
                if have is None or n > have[3]:
                    raise ValueError(f"{n} rows deleted of {have[3] if have else 0} with digest {digest.hex()}")
                have[3] -= n
                if not have[3]:
                    index.delete(digest)
                elif (i, row) == (have[1], have[2]):
                    have[1], have[2] = None, OPEN
            elif have is None:
                index.insert([digest, i, row, n])
            else:
                have[3] += n
                if have[2] != OPEN and _newer((i, row), (have[1], have[2])):
                    have[1], have[2] = i, row
    out: list[list] = []
    for r in index.live():
        out.append(r)
        if len(out) == 20_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["digest", "id", "row", "n"])


def update(changes: DataFrame, index: DataFrame | None = None, n: int | None = None, live: DataFrame | None = None) -> DataFrame:
    """The index (ENTRY) after the changes (CHANGE, with a long `seq` if their order matters), with those of `index` inserted first.

    Changes come in order of seq; of one seq, insertions first. Rows are dealt by digest, so each
    partition holds all of a digest; pre-aggregate insertions (`combined`) before. Deleting more rows
    than are live is an error. live: (digest, id, row) of all rows that are live after the changes, from
    which a record whose kept row was deleted gets the largest left; without it such a record's row is OPEN.
    """
    if "seq" not in changes.columns:
        changes = changes.withColumn("seq", F.lit(0).cast("long"))
    if index is not None:
        changes = index.select(F.lit(INSERT).alias("op"), *ENTRY_COLUMNS, F.lit(-(1 << 63)).cast("long").alias("seq")).unionByName(changes)
    dealt = changes.select("op", *ENTRY_COLUMNS, "seq").repartition(n or partitions(changes.sparkSession), "digest").sortWithinPartitions("seq", "op")
    out = dealt.select("op", *ENTRY_COLUMNS).mapInArrow(_apply, ENTRY)
    if live is None:
        return out
    out = cut(out, "index")
    open_ = out.where(F.col("row") == OPEN).select("digest", "n")
    order = F.struct(F.col("id").isNotNull(), "id", "row")
    found = live.join(open_.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max(F.struct(order.alias("o"), "id", "row")).alias("k"))
    return out.where(F.col("row") != OPEN).unionByName(open_.join(found, "digest").select("digest", "k.id", "k.row", "n"))


ENTRY_COLUMNS = ("digest", "id", "row", "n")


def combined(rows: DataFrame) -> DataFrame:
    """Insertions (CHANGE) of rows (digest, id, row): one for each digest and batch."""

    def of(batches):
        for batch in batches:
            best: dict[bytes, list] = {}
            for digest, i, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = best.get(digest)
                if have is None:
                    best[digest] = [digest, i, row, 1]
                else:
                    have[3] += 1
                    if _newer((i, row), (have[1], have[2])):
                        have[1], have[2] = i, row
            b = _batch(list(best.values()))
            yield pa.RecordBatch.from_arrays([pa.array([INSERT] * b.num_rows, pa.int32()), *b.columns], ["op", *ENTRY_COLUMNS])

    return rows.select("digest", "id", "row").mapInArrow(of, CHANGE)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(id, row, digest) of each row; row: a column that tells rows apart, else made here."""

    def of(batches):
        for batch in batches:
            i, row, texts = batch.columns
            sha = [hashlib.sha256((t.as_py() or "").encode().lower()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([i, row, pa.array(sha, pa.binary())], ["id", "row", "digest"])

    r = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(F.col(key).cast("long").alias("id"), r.alias("row"), F.col(text).alias("text")).mapInArrow(of, "id long, row long, digest binary")


#: Rows of a digest that one task compares, about; a digest with more is dealt to as many buckets as it needs.
SHARE = 1_000


def _unlike(columns: int):
    """Of rows in order of their first columns, the last being content: heads, one for each run of equal first columns; fails if a run holds two contents."""

    def of(batches):
        last, content = None, None
        for b in batches:
            heads = []
            for i, (key, data) in enumerate(zip(zip(*(c.to_pylist() for c in b.columns[:columns]), strict=True), b.column(columns), strict=True)):
                data = (data.as_py() or "").encode().lower()
                if key != last:
                    last, content = key, data
                    heads.append(i)
                elif data != content:
                    raise ValueError(f"two texts share the digest {key[0][:32].hex()}")
            yield b.take(pa.array(heads, pa.int64()))

    return of


def _by_scan(rows: DataFrame, row: str, name: str) -> str:
    """rows, with a column `row` of monotonically_increasing_id(), in a folder for each scan partition."""
    url = shared_dir(rows.sparkSession, name)
    pid = F.shiftright(row, 33).cast("int")
    rows.withColumn("pid", pid).repartition(partitions(rows.sparkSession), "pid").write.partitionBy("pid").parquet(url)
    return url


def _noted(url: str, row: str, value: str | None = None):
    """A function of the row numbers of a scan: what rows of `_by_scan` note of them, null for the others; without a value, whether they are among them.

    A task reads the notes of its own scan partitions, so what is looked up is never joined with, and texts stay where they are.
    """

    def of(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, folder = store(url)
        known: dict[int, tuple[np.ndarray, pa.Array]] = {}

        def notes(pid: int) -> tuple[np.ndarray, pa.Array]:
            if pid not in known:
                found = system.get_file_info(fs.FileSelector(f"{folder}/pid={pid}", allow_not_found=True))
                parts = [pa.schema([(row, pa.int64()), *([(value, pa.binary())] if value else [])]).empty_table()]
                for f in found:
                    if f.base_name.endswith(".parquet"):
                        with system.open_input_file(f.path) as stream:
                            parts.append(pq.ParquetFile(stream).read(columns=parts[0].column_names).cast(parts[0].schema))
                known.clear()  # a task has one partition, or a few one after the other
                t = pa.concat_tables(parts).sort_by(row)
                known[pid] = t[row].to_numpy(), (t[value].combine_chunks() if value else pa.repeat(True, t.num_rows))
            return known[pid]

        for r in rows:
            at = r.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(at >> 33)) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if a < b:
                    there, values = notes(int(at[a] >> 33))
                    i = np.searchsorted(there, at[a:b])
                    hit = np.r_[there, -1][i] == at[a:b]
                    out.append(values.take(pa.array(i, mask=~hit)) if value else pa.array(hit))
            yield pa.concat_arrays(out) if out else pa.array([], pa.binary() if value else pa.bool_())

    return F.arrow_udf(of, "binary" if value else "boolean")


def verified(docs: DataFrame, rows: DataFrame, text: str, row: str) -> int:
    """Compares the contents of rows (digest, row) of docs that share a digest; gives the number of digests compared, fails if two contents share one.

    row: a column of docs made by monotonically_increasing_id() where docs are read. Texts without a copy stay in their
    scan, the others are shuffled once. A digest's rows are dealt to buckets of about SHARE rows and compared in order, each with the one
    before; then the buckets' first rows are, where a digest has several. Memory is two texts, and no bucket of a hot group
    holds more than its share.
    """
    n = partitions(docs.sparkSession)
    hot = rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > SHARE).select("digest", F.ceil(F.col("n") / SHARE).alias("buckets"))
    salt = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("buckets")) + 1, F.lit(0)).cast("int")
    noted = rows.select(F.col("row").alias("_row"), "digest").join(hot, "digest", "left")
    # Which bucket a row goes to is a suffix of its digest.
    url = _by_scan(noted.select("_row", F.concat("digest", F.unhex(F.lpad(F.hex(salt), 8, "0"))).alias("at")), "_row", "copies")
    d = docs.select(F.col(row).alias("row"), F.col(text).alias("text")).withColumn("at", _noted(url, "_row", "at")("row")).where("at IS NOT NULL")
    dealt = d.select("at", "text").repartition(n, "at").sortWithinPartitions("at")
    heads = dealt.mapInArrow(_unlike(1), "at binary, text string")
    digest, several = F.expr("substring(at, 1, length(at) - 4)"), F.expr("substring(at, -4, 4) <> X'00000000'")
    heads = heads.select(digest.alias("digest"), F.when(several, F.col("text")).alias("text"))
    return heads.repartition(n, "digest").sortWithinPartitions("digest").mapInArrow(_unlike(1), "digest binary, text string").count()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """For each row: id, row, digest, keep_id, group_size, kept."""
    if row is None:
        (row,) = fresh(docs, "_row")
        docs = numbered(docs, row)
    d = cut(digests(docs, key, text, row), "digests")
    n = max(partitions(docs.sparkSession), d.count() // PER_PARTITION)
    index = update(combined(d), n=n).select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    out = cut(d.join(index, "digest").withColumn("kept", F.col("row") == F.col("keep_row")).drop("keep_row"), "groups")
    verified(docs, out.where("group_size > 1"), text, row)
    return out


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without rows whose text equals that of a row with a larger id. docs must give the same rows in the same order when read again, as a table does."""
    (row,) = fresh(docs, "_row")
    keyed = numbered(docs, row)
    stay = groups(keyed, key, text, row).where("kept").select("row")
    return keyed.where(_noted(_by_scan(stay, "row", "kept"), "row")(row)).select(docs.columns)
