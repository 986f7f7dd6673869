"""SimHash near-dedup: fingerprints, a pigeonring search for links, connected components.

Words are lower-cased in A-Z; a fingerprint has 64 bits, each set if more than half of the XXH64
values (seed 42) of the text's three-word shingles have it set. Fingerprints that differ in at most
three bits are linked.

Links are searched among distinct fingerprints. The 64 bits lie on a ring of eight segments. If two
fingerprints differ in at most three bits, then from some segment on, for every length l, the first
l segments together differ in at most l * 3 / 8 bits (pigeonring principle): none in the first two,
one at most in the first five, two in seven. So the first two segments and two of the next three
are equal, which gives 8 starts with 3 choices each, 24 keys of 32 bits. Fingerprints that share a
key are held against the whole chain of budgets, and those that remain against the full distance.

A key leaves 32 bits free, so many short or templated texts can share one. A run of more than LONG
fingerprints under one key is not searched by the task that meets it but dealt anew: the bits that are
still free fall into four parts, of which two linked fingerprints have at least one in common, and each part with its
value is a key below the first one. A run that is still long is dealt again; with nine bits free it is
at most LONG. So no task has a run of more, however hot a key is. Within a run only links that join
what is not yet joined there are given, at most one fewer than its fingerprints, and no link between
different groups is lost.

Cases: a very long text is fingerprinted whole, a block of shingles at a time; extra columns of `dedup` pass
through, whatever their names; null, empty and blank texts have fingerprint zero and are linked like any other; fewer than
three words form one shingle; repeated rows and equal fingerprints share a component; a null doc_id
is never the component's id unless all its rows have none; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, numbered, partitions
from .components import components

BITS, SEGMENTS, DISTANCE = 64, 8, 3
#: Bits that the first l segments of a chain may differ in.
BUDGET = np.array([(n + 1) * DISTANCE // SEGMENTS for n in range(SEGMENTS)])
#: Which two of a chain's third to fifth segments a key takes.
CHOICES = ((2, 3), (2, 4), (3, 4))
#: Runs of equal keys up to this length are compared pair by pair with the chain's budgets, longer ones by a search at full distance.
SHORT = 12
#: Runs beyond this are dealt anew by further bits.
LONG = 512


def fingerprint(text: str | None, size: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, 42) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(id, row, fp) of each row; fp: the fingerprint's bits as a signed long."""

    def of(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["id", "row", "fp"])

    r = F.col(row) if row else F.lit(0).cast("long")
    return docs.select(F.col(key).cast("long").alias("id"), r.alias("row"), F.col(text).alias("text")).mapInArrow(of, "id long, row long, fp long")


def keys(fps: DataFrame) -> DataFrame:
    """fps (fp) -> (k, fp): the 24 chain keys, each with its start and choice in the upper bits."""
    w = BITS // SEGMENTS

    def chain(start):
        turned = F.shiftleft("fp", w * start).bitwiseOR(F.shiftrightunsigned("fp", BITS - w * start)) if start else F.col("fp")
        seg = lambda i: F.shiftrightunsigned(turned, BITS - w * (i + 1)).bitwiseAND((1 << w) - 1)
        for c, two in enumerate(CHOICES):
            parts = [F.lit(start * len(CHOICES) + c).cast("long"), *map(seg, (0, 1, *two))]
            k = parts[0]
            for p in parts[1:]:
                k = F.shiftleft(k, w).bitwiseOR(p)
            yield k

    return fps.select(F.explode(F.array(*(k for s in range(SEGMENTS) for k in chain(s)))).alias("k"), "fp")


def near(x: np.ndarray, y: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of pairs that share a key of this table, those that are linked and have no earlier table in common."""
    turn = (np.arange(SEGMENTS)[:, None] + np.arange(SEGMENTS)) % SEGMENTS
    apart = np.bitwise_count((x ^ y).view(np.uint8).reshape(-1, SEGMENTS)[:, ::-1])
    chains = apart[:, turn].cumsum(2)  # pair, start, length
    viable = (chains <= BUDGET).all(2)
    start = viable.argmax(1)
    rows = np.arange(len(x))
    own = apart[rows[:, None], turn[start]]
    choice = np.stack([own[:, a] + own[:, b] == 0 for a, b in CHOICES], 1).argmax(1)
    return viable.any(1) & (start * len(CHOICES) + choice == table) & (apart.sum(1) <= DISTANCE)


def spanning(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links of a forest with the same components as all links among fp: each found fingerprint meets those not yet found."""
    left, out = np.unique(fp), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            close = np.bitwise_count(left ^ x) <= DISTANCE
            if close.any():
                found = left[close]
                out += [(int(x), int(f)) for f in found]
                todo += list(found)
                left = left[~close]
    return out


def free_bits(table: int) -> int:
    """The bits that a chain key leaves free, as a mask."""
    start, choice = divmod(table, len(CHOICES))
    taken = 0
    for s in (0, 1, *CHOICES[choice]):
        low = BITS - BITS // SEGMENTS * ((start + s) % SEGMENTS + 1)
        taken |= ((1 << BITS // SEGMENTS) - 1) << low
    return taken ^ ((1 << BITS) - 1)


def parts(free: int) -> list[int]:
    """A mask's bits in DISTANCE + 1 parts, as masks."""
    bits = [b for b in range(BITS) if free >> b & 1]
    n = DISTANCE + 1
    return [sum(1 << b for b in bits[len(bits) * i // n : len(bits) * (i + 1) // n]) for i in range(n)]


def _dealt_anew(batches):
    """(k, free, fp) of long runs -> the same by each part of the free bits, which the new key fixes."""
    for b in batches:
        k, free, fp = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
        for mask in np.unique(free):
            own = free == mask
            for i, part in enumerate(parts(int(mask))):
                named = np.stack([k[own], np.full(own.sum(), i, np.uint64), fp[own] & np.uint64(part)], 1)
                key = np.fromiter((xxhash.xxh64_intdigest(r.tobytes()) for r in named), np.uint64)
                left = np.full(own.sum(), mask & ~np.uint64(part), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, left, fp[own])], ["k", "free", "fp"])


def _links(batches, first_round: bool = True):
    """Rows (k, free, fp) in order of k -> links (a, b), and the rows of long runs with their k and free, their b null."""
    k, free, fp = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    names = ["a", "b", "k", "free"]

    def out(a, b):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (a, b)), none, none], names)

    def of(k, free, fp):
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
        length = np.diff(np.r_[first, len(k)])
        for i in np.flatnonzero(length > (SHORT if first_round else 1)):
            run = slice(first[i], first[i] + length[i])
            if length[i] > LONG and np.bitwise_count(free[run].view(np.uint64)).max() > 9:
                left = free[run] if not first_round else np.full(length[i], np.array([free_bits(int(k[first[i]]) >> 32)], np.uint64).view(np.int64)[0])
                yield pa.RecordBatch.from_arrays([pa.array(fp[run].view(np.int64)), pa.nulls(length[i], pa.int64()), pa.array(k[run]), pa.array(left)], names)
            elif pairs := spanning(fp[run]):
                yield out(*zip(*pairs, strict=True))
        if not first_round:
            return
        short = np.repeat(length <= SHORT, length)
        k, fp = k[short], fp[short]
        for d in range(1, SHORT):
            at = np.flatnonzero(k[d:] == k[:-d])
            if not len(at):
                break
            for i in range(0, len(at), 100_000):
                a = at[i : i + 100_000]
                x, y = fp[a], fp[a + d]
                ok = near(x, y, k[a] >> 32)
                if ok.any():
                    yield out(x[ok], y[ok])

    for b in batches:
        k = np.r_[k, b.column(0).to_numpy(zero_copy_only=False)]
        free = np.r_[free, b.column(1).to_numpy(zero_copy_only=False)]
        fp = np.r_[fp, b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
        whole = np.searchsorted(k, k[-1]) if len(k) else 0
        yield from of(k[:whole], free[:whole], fp[:whole])
        k, free, fp = k[whole:], free[whole:], fp[whole:]
    yield from of(k, free, fp)


def links(fps: DataFrame) -> DataFrame:
    """Distinct fps (fp) -> links (a, b) with the same connected components as all pairs within DISTANCE bits."""
    n, out = partitions(fps.sparkSession), None
    todo = keys(fps).select("k", F.lit(-1).cast("long").alias("free"), "fp")
    while True:
        first = out is None
        dealt = todo.repartition(n, "k").sortWithinPartitions("k", "fp")
        found = cut(dealt.mapInArrow(lambda b, first=first: _links(b, first), "a long, b long, k long, free long"), "links")
        own = found.where("b IS NOT NULL").select("a", "b")
        out = own if first else out.unionByName(own)
        long = found.where("b IS NULL").select("k", "free", F.col("a").alias("fp"))
        if long.isEmpty():
            return out
        todo = long.mapInArrow(_dealt_anew, "k long, free long, fp long")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """For each row: id, row, fp, root (a fingerprint that names its component), component_id (the component's smallest id)."""
    d = cut(fingerprints(docs, key, text, row), "fingerprints")
    fps = cut(d.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    root = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    rooted = fps.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "roots")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return d.join(rooted.join(best, "root").select("fp", "root", "component_id"), "fp")


def hexadecimal(fp):
    """16 lower-case hex digits of a signed long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id, of several such rows the first. docs must give the same rows in the same order when read again, as a table does."""
    (row,) = fresh(docs, "_row")
    keyed = numbered(docs, row)
    g = groups(keyed, key, text, row).where(F.col("id").eqNullSafe(F.col("component_id")))
    stay = g.groupBy("root").agg(F.min("row").alias(row)).select(row)
    return keyed.join(stay, row, "left_semi").drop(row).select(docs.columns)
