"""Hierarchical packing of documents into sequences of several lengths.

Tiers are the powers of two up to the context size. A document's whole windows of the longest tier
are sequences by themselves; what is left is routed to the smallest tier that holds it. Tiers are
packed from long to short: a piece opens a window of its tier, and the window's gap is filled from
shorter tiers, the largest piece that fits first; where none fits, a piece is cut and its rest goes
back to the tier of its new length. What cannot be filled at the very end is cut into windows of
shorter tiers, so that no sequence holds padding. Windows of one tier are then numbered through over
all tasks, by prefix sums over each task's counts, and dealt to step groups of at most STEP tokens
whose sizes differ by one window at most.

Each task packs what it reads, a bounded number of left-over pieces at a time, so documents are
neither shuffled nor gathered, and a source or group of copies of any size is as good as another.

Cases: a null text counts as empty and still gets its end id; repeated rows and equal doc_ids are
packed each by itself; very long texts fill as many windows as they need; a null doc_id is carried as
null; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import Encoder

CONTEXT = 1024
#: Left-over pieces held before they are packed, and tokens of a step group.
HELD, STEP = 8192, 65_536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, place long"


def tier(n: int) -> int:
    """The smallest power of two that holds n."""
    return 1 << (n - 1).bit_length()


class Shelf:
    """Pieces (doc, start, ids, doc_tokens) by length; the largest up to a length and the smallest above one are found by bits."""

    def __init__(self):
        self.by: dict[int, list] = {}
        self.mask = 0
        self.count = 0

    def add(self, piece) -> None:
        n = len(piece[2]) // 4
        self.by.setdefault(n, []).append(piece)
        self.mask |= 1 << n
        self.count += 1

    def _take(self, n: int):
        pieces = self.by[n]
        piece = pieces.pop()
        if not pieces:
            self.mask &= ~(1 << n)
        self.count -= 1
        return piece

    def up_to(self, n: int):
        below = self.mask & ((1 << (n + 1)) - 1)
        return self._take(below.bit_length() - 1) if below else None

    def above(self, n: int):
        over = self.mask >> (n + 1)
        return self._take(n + (over & -over).bit_length()) if over else None


def split(piece, n: int):
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


def windows(shelf: Shelf, context: int, last: bool):
    """Packs the shelf from its longest piece on: lists of pieces that fill a tier each. Unless last, stops where the rest could not be filled."""
    while shelf.count:
        head = shelf.up_to(context)
        size = tier(len(head[2]) // 4)
        window, gap = [head], size - len(head[2]) // 4
        while gap:
            piece = shelf.up_to(gap)
            if piece is None:
                piece = shelf.above(gap)
                if piece is None:
                    break
                piece, rest = split(piece, gap)
                shelf.add(rest)
            window.append(piece)
            gap -= len(piece[2]) // 4
        if not gap:
            yield size, window
        elif not last:
            for piece in window:
                shelf.add(piece)
            return
        else:
            while window:
                n = sum(len(p[2]) // 4 for p in window)
                size = tier(n + 1) // 2
                own = []
                while size:
                    piece = window.pop(0)
                    if len(piece[2]) // 4 > size:
                        piece, rest = split(piece, size)
                        window.insert(0, rest)
                    own.append(piece)
                    size -= len(piece[2]) // 4
                yield tier(n + 1) // 2, own


def pack(docs: DataFrame, path: str, end: int, context: int = CONTEXT, key: str = "doc_id", text: str = "text", step: int = STEP) -> DataFrame:
    """Pieces of all documents with their sequences. context: a power of two."""
    final = np.array([end], "<u4").tobytes()

    def of(batches):
        enc, shelf = Encoder.of(path), Shelf()
        task = TaskContext.get().partitionId()
        sequences, filled, rows = 0, {}, []

        def put(size, window):
            nonlocal sequences
            place = filled[size] = filled.get(size, -1) + 1
            at = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, (task << 40) + sequences, at, size, task, place))
                at += n
            sequences += 1

        def flush(least):
            nonlocal rows
            if len(rows) > least:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int32() if n in ("tier", "task") else pa.int64()) for n, c in zip(NAMES, zip(*rows, strict=True), strict=True)})
                rows = []

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.ids(t.as_py() or "") + final
                total = len(ids) // 4
                whole = total - total % context
                for i in range(0, whole, context):
                    put(context, [(doc, i, ids[4 * i : 4 * (i + context)], total)])
                if whole < total:
                    shelf.add((doc, whole, ids[4 * whole :], total))
                if shelf.count >= HELD:
                    for w in windows(shelf, context, False):
                        put(*w)
                yield from flush(20_000)
        for w in windows(shelf, context, True):
            put(*w)
        yield from flush(0)

    return stepped(cut(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, SCHEMA), "packed"), step)


def stepped(packed: DataFrame, step: int = STEP) -> DataFrame:
    """packed with step_group, even over all tasks, in place of task and place. Counts are a row for each task and tier."""
    n = packed.groupBy("tier", "task").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("tier"))
    n = n.select("tier", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), total.alias("total"))
    groups = F.ceil(F.col("total") * F.col("tier") / step)
    # Groups of a tier are told from those of another by the tier's own upper bits.
    group = F.col("tier").cast("long") * (1 << 40) + F.floor((F.col("base") + F.col("place")) * groups / F.col("total"))
    return packed.join(n, ["tier", "task"]).select(*[c for c in NAMES if c not in ("task", "place")], group.alias("step_group"))


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
