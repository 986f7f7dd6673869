"""Periodic runs of words: stretches that repeat with a smallest period at least TIMES times.

Seed and extend on diagonals. Two words at distance q in a run of period q are equal, so a run is a stretch
of equal pairs on the diagonal of lag q, at least max(LEAST - q, (TIMES - 1) * q) long. Lags of
[2^j, 2^(j+1)) are found by the k-grams that each of their runs must hold on its diagonal: k = 5 for lag 1,
3 * 2^j else. Names of k-grams are doubled from level to level; only those that occur again in their
document are kept, so plain prose ends after a level or two.

Of a k-gram's occurrences only neighbouring ones are paired. That loses nothing: k is at least the period, so an
occurrence less than a period away within the run would give its root a shorter period. It also means that a
pair's lag is the smallest period of what its extension covers. A table of each lag's furthest covered word
keeps a run from being extended again by its other seeds. Pairs are as many as words at each level,
and work is in the order of words times levels.

Rows need nothing of each other, so nothing is shuffled; a task takes the documents of a batch in groups of
about CHUNK words, each document with word numbers of its own.

Cases: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows are
reported each; a very long text is one group by itself, in memory of some 100 bytes a word; an empty table
gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh, let, words

LEAST, TIMES = 6, 4
#: Words that are searched at once.
CHUNK = 400_000
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def _repeated(at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of grams at ascending places: places and dense names of those that occur twice or more, and pairs (earlier, later) of neighbouring occurrences."""
    order = np.argsort(code, kind="stable")
    s, p = code[order], at[order]
    same = s[1:] == s[:-1]
    if not same.any():
        none = np.empty(0, np.int64)
        return none, none, none, none
    again = np.zeros(len(s), bool)
    again[1:] |= same
    again[:-1] |= same
    name = np.cumsum(np.concatenate(([True], ~same)))[again]
    place = p[again]
    by = np.argsort(place)
    return place[by], name[by], p[:-1][same], p[1:][same]


def _joined(at: np.ndarray, name: np.ndarray, n: int, shift: int):
    """The grams made of a kept gram and another one `shift` words behind it."""
    of = np.full(n + shift, -1, np.int64)
    of[at] = name
    behind = of[at + shift]
    ok = behind >= 0
    at, name, behind = at[ok], name[ok], behind[ok]
    return _repeated(at, name * (int(of.max(initial=0)) + 1) + behind)


def _until(w: np.ndarray, x: int, lag: int) -> int:
    """The first place from x on whose word differs from the one a lag behind it."""
    step, end = 32, len(w) - lag
    while x < end:
        m = min(step, end - x)
        unlike = w[x : x + m] != w[x + lag : x + lag + m]
        if unlike.any():
            return x + int(unlike.argmax())
        x, step = x + m, min(2 * step, 1 << 16)
    return x


def _since(w: np.ndarray, x: int, lag: int) -> int:
    """The least place up to x from which on words equal those a lag behind."""
    step = 32
    while x > 0:
        m = min(step, x)
        unlike = w[x - m : x] != w[x - m + lag : x + lag]
        if unlike.any():
            return x - int(unlike[::-1].argmax())
        x, step = x - m, min(2 * step, 1 << 16)
    return x


def _extended(w: np.ndarray, one: np.ndarray, two: np.ndarray, k: int, lags: tuple[int, int], covered: dict[int, int], found: list) -> None:
    """Extends the pairs of k-grams whose lag lies in `lags`; covered: lag -> furthest word known to equal the one a lag behind."""
    lag = two - one
    keep = (lag >= lags[0]) & (lag < lags[1])
    one, lag = one[keep], lag[keep]
    order = np.lexsort((one, lag))
    one, lag = one[order], lag[order]
    head = np.ones(len(one), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (one[1:] != one[:-1] + 1)
    for i, d in zip(one[head].tolist(), lag[head].tolist(), strict=True):
        if i < covered.get(d, 0):
            continue
        a, b = _since(w, i, d), _until(w, i + k, d)
        covered[d] = b
        if b - a + d >= max(LEAST, TIMES * d):
            found.append((a, b - a + d, d))


def runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    n, w = len(w), w.astype(np.int64, copy=False)
    if n < LEAST:
        return []
    covered: dict[int, int] = {}
    found: list[tuple[int, int, int]] = []
    at, name, _, _ = _repeated(np.arange(n - 1), w[:-1] * (int(w.max()) + 1) + w[1:])
    at, name, _, _ = _joined(at, name, n, 1)
    if len(at):
        _, _, one, two = _joined(at, name, n, 2)
        _extended(w, one, two, 5, (1, 2), covered, found)
    at, name, one, two = _joined(at, name, n, 3) if len(at) else (at, name, at, at)
    # at, name: 6-grams now, for the lags 2 and 3.
    k, low = 6, 2
    while len(at) and TIMES * low <= n:
        _extended(w, one, two, k, (low, 2 * low), covered, found)
        at, name, one, two = _joined(at, name, n, k)
        k, low = 2 * k, 2 * low
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(parts: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not found:
        return b" ".join(parts)
    edge = np.zeros(len(parts) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(parts[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0))


def _searched(texts: list[list[bytes]]) -> Iterator[tuple[int, list, bytes]]:
    """(number of words, runs, collapsed text) of each document of a group."""
    numbers, starts = [], [0]
    for parts in texts:
        own: dict[bytes, int] = {}
        base = starts[-1]
        numbers += [base + own.setdefault(p, len(own)) for p in parts]
        starts.append(base + len(parts))
    found = runs(np.array(numbers, np.int64))
    del numbers
    at = 0
    for parts, start, end in zip(texts, starts, starts[1:], strict=False):
        own_runs = []
        while at < len(found) and found[at][0] < end:
            own_runs.append((found[at][0] - start, *found[at][1:]))
            at += 1
        yield len(parts), own_runs, _collapsed(parts, own_runs)


def _groups(column: pa.Array) -> Iterator[list[list[bytes]]]:
    group, n = [], 0
    for t in column:
        parts = (t.as_py() or "").encode().split()  # at blanks, tabs and line ends, as WORD does
        if group and n + len(parts) > CHUNK:
            yield group
            group, n = [], 0
        group.append(parts)
        n += len(parts)
    if group:
        yield group


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with three columns more, named n_words, runs (of RUN, by start, then period) and collapsed, or longer where docs has such names."""
    names = fresh(docs, "n_words", "runs", "collapsed")
    kinds = (LongType(), ArrayType(RUN), StringType())
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(names, kinds, strict=True))])
    run = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN.fields]))
    place = docs.columns.index(text)

    def of(batches):
        for batch in batches:
            done = 0
            for group in _groups(batch.column(place)):
                n, found, left = zip(*_searched(group), strict=True)
                structs = [[dict(zip(RUN.names, r, strict=True)) for r in f] for f in found]
                part = batch.slice(done, len(group))
                made = [pa.array(n, pa.int64()), pa.array(structs, run), pa.array([x.decode() for x in left], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=schema.names)
                done += len(group)

    return docs.mapInArrow(of, schema)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs whose texts keep one period of each run, their words joined by single blanks. Texts without a run stay as they are, null ones too."""
    found = with_runs(docs, text)
    runs_, collapsed = found.columns[-2:]
    return found.select(*(F.when(F.size(runs_) > 0, F.col(collapsed)).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns))


def planted(key: Column, text: Column) -> Column:
    """A text, but every tenth (by crc32 of its key) is made periodic from some word on; a null key changes nothing."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def of(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(again, " ")).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), of)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs, after planted(): doc_id, n_runs, the greatest run, digests of the runs and of the collapsed text."""
    found = with_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")).select("doc_id", "text")).drop("text")
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("b.l")
    return out.select(
        "doc_id", "n_runs", F.col("b.start").alias("start"), length.alias("length"), F.col("b.period").alias("period"),
        F.floor(1000 * length / F.col("b.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
