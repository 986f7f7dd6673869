"""External induced sorting of suffixes: disk-backed priority queues, common-prefix values, recursion.

A text is a file of integers that ends with a 0 found nowhere else. A suffix is S if it is smaller than
the next one, else L; a leftmost S suffix (a seed) has an L suffix before it. Sorting goes by levels:

1. The seeds' substrings, each up to and with the next seed, are cut into blocks of a few characters.
   Blocks are put in order by a queue and named by their rank; the names, in the text's order, are a
   text of less than half the length. Where names repeat, that text's suffixes are sorted in the same
   way, one level deeper, down to texts without repeated names or of at most Room.small names, which
   are sorted in memory.
2. The order of the blocks gives that of the seeds, and the common prefixes of the names say from where
   two neighbouring seeds need comparing.
3. A scan in ascending order starts from the seeds: the smallest suffix not yet scanned is taken, from
   the seeds or from a queue, and the suffix one place before it, if L, is put into the queue under its
   own first character. A second scan, in descending order from the L suffixes, does so for S suffixes.

Queues hold tuples (first character, place, common prefix with the tuple before). They are parted by
ranges of characters into runs: a range holds few suffixes or is one character, whose tuples are in order
as they come. Runs are files beyond a bound on the tuples that all of a queue's runs hold together
(`Room`). Texts, names, orders and marks are memory-mapped files, read and written mostly in order; what
lies in memory at a time is a few arrays of Room.tuples, whatever the length of the text.

Two suffixes put in one after the other under one character have one more character in common than the
suffixes they came from, whose common prefix is the least one between them in the scan. Common prefixes
are cut off at a horizon; deeper levels have one in names, which never says less.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

class Room:
    """How much is held in memory, and where the rest goes."""

    def __init__(self, folder: str = "", tuples: int = 1 << 20, small: int | None = None):
        self.folder, self.tuples, self.small = folder, tuples, tuples if small is None else small
        self.files, self.spilled, self.depth, self.most = 0, 0, 0, 0

    def name(self) -> str:
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def array(self, n: int, kind) -> np.ndarray:
        """A new array on disk, whose file goes with it."""
        if not n:
            return np.empty(0, kind)
        name = self.name()
        made = np.memmap(name, kind, "w+", shape=(n,))
        os.unlink(name)
        return made

    def held(self, n: int) -> None:
        self.most = max(self.most, n)


#: Tuples of scans, whose texts have less than 2 ** 30 characters, and of sorting by keys of 63 bits.
TUPLE = np.dtype([("char", "<i4"), ("place", "<i4"), ("common", "<i2")])
KEYED = np.dtype([("char", "<i8"), ("place", "<i4")])


class Run:
    """Tuples in order of coming; what the queue does not hold in memory lies in a file."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.parts, self.held, self.stored, self.path = [], 0, 0, None

    def __len__(self):
        return self.stored + self.held

    def add(self, tuples: np.ndarray) -> None:
        self.parts.append(tuples)
        self.held += len(tuples)

    def _memory(self) -> np.ndarray:
        if len(self.parts) != 1:
            self.parts = [np.concatenate(self.parts)] if self.parts else [np.empty(0, self.kind)]
        return self.parts[0]

    def spill(self, room: Room) -> None:
        self.path = self.path or room.name()
        with open(self.path, "ab") as f:
            self._memory().tofile(f)
        room.spilled += self.held
        self.stored += self.held
        self.parts, self.held = [], 0

    def slice(self, at: int, n: int) -> np.ndarray:
        """Tuples at to at + n."""
        out = []
        if at < self.stored:
            m = min(n, self.stored - at)
            out.append(np.fromfile(self.path, self.kind, m, offset=at * self.kind.itemsize))
            at, n = at + m, n - m
        if n > 0 and self.held:
            out.append(self._memory()[at - self.stored : at - self.stored + n])
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, self.kind)

    def drop(self) -> None:
        if self.path:
            os.remove(self.path)
        self.parts, self.held, self.stored, self.path = [], 0, 0, None


class Queue:
    """A priority queue by character; of one character, first in, first out. edges: the last character of each range, ascending."""

    def __init__(self, room: Room, edges: np.ndarray, kind: np.dtype = TUPLE):
        self.room, self.edges, self.held = room, edges, 0
        self.runs = [Run(kind) for _ in edges]

    def add(self, tuples: np.ndarray) -> None:
        if len(self.edges) == 1:
            self.runs[0].add(tuples)
        else:
            where = np.searchsorted(self.edges, tuples["char"])
            if len(tuples) > 1:
                order = np.argsort(where, kind="stable")
                tuples, where = tuples[order], where[order]
            cuts = np.flatnonzero(where[1:] != where[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(tuples)], strict=True):
                self.runs[where[a]].add(tuples[a:b])
        self.held += len(tuples)
        self.room.held(self.held)
        if self.held > self.room.tuples:
            for r in self.runs:
                if r.held:
                    r.spill(self.room)
            self.held = 0

    def drop(self, i: int) -> None:
        self.held -= self.runs[i].held
        self.runs[i].drop()


def tuples(char, place, common=None) -> np.ndarray:
    """Tuples of scans, or, without common prefixes, of sorting by keys."""
    out = np.empty(len(place), KEYED if common is None else TUPLE)
    out["char"], out["place"] = char, place
    if common is not None:
        out["common"] = common
    return out


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, horizon: int) -> np.ndarray:
    """Common prefix of suffixes a and b up to the horizon, of which `known` characters are known to agree."""
    out = np.minimum(known, horizon).astype(np.int64)
    open_ = np.flatnonzero(out < horizon)
    step = 8
    while len(open_):
        k = np.arange(step)
        x, y = a[open_] + out[open_], b[open_] + out[open_]
        differ = text[np.minimum(x[:, None] + k, len(text) - 1)] != text[np.minimum(y[:, None] + k, len(text) - 1)]
        hit = differ.any(1)
        out[open_] += np.where(hit, differ.argmax(1), step)
        open_ = open_[~hit & (out[open_] < horizon)]
        step = min(64, 2 * step)
    return np.minimum(out, horizon)


def ranges(text: np.ndarray, alphabet: int, room: Room) -> np.ndarray:
    """Last characters of ranges that hold at most room.tuples / 4 suffixes each, or are one character."""
    most, edges, carry = max(1, room.tuples // 4), [], 0
    for lo in range(0, alphabet, room.tuples):
        hi = min(alphabet, lo + room.tuples)
        sums = np.full(hi - lo, carry, np.int64)
        for i in range(0, len(text), room.tuples):
            t = np.asarray(text[i : i + room.tuples], np.int64) - lo
            sums += np.bincount(t[(t >= 0) & (t < hi - lo)], minlength=hi - lo).cumsum()
        start, i, empty = 0, 0, carry == 0
        while (j := int(np.searchsorted(sums, start + most, side="right"))) < len(sums):
            j += int(j == i and empty)  # one character too many by itself is a range of its own
            if lo + j > 0:
                edges.append(lo + j - 1)
            start, i, empty = int(sums[j - 1]) if j else carry, j, True
        carry = int(sums[-1]) - start
    return np.array([*edges, alphabet - 1], np.int64) if not edges or edges[-1] != alphabet - 1 else np.array(edges, np.int64)


class Sink(Run):
    """A run that is written out as it grows."""

    def __init__(self, room: Room):
        super().__init__(TUPLE)
        self.room = room

    def add(self, t: np.ndarray) -> None:
        super().add(t)
        if self.held > self.room.tuples // 4:
            self.spill(self.room)


class Backwards:
    """A run from its end: a tuple's common prefix is then the one that its follower had. turn: what takes the characters round."""

    def __init__(self, run: Run, turn=None):
        self.run, self.turn = run, turn

    def __len__(self):
        return len(self.run)

    def slice(self, at: int, n: int) -> np.ndarray:
        end = len(self.run) - at
        n = min(n, end)
        t = self.run.slice(end - n, n + 1)
        out = t[:n][::-1].copy()
        out["common"] = t["common"][1:][::-1] if len(t) > n else np.r_[0, t["common"][1:][::-1]][:n]
        if self.turn:
            out["char"] = self.turn(out["char"])
        return out


def behind(first, x: np.ndarray) -> np.ndarray:
    """x moved on by one place, `first` before it."""
    out = np.empty_like(x)
    if len(x):
        out[0] = first
        out[1:] = x[:-1]
    return out


class Scan:
    """One induction. up: L suffixes in ascending order, else S suffixes in descending order, from seeds in that order.

    In the descending scan characters are turned round (alphabet - 1 - c), so that both take the smallest key
    first; of one key, tuples from the queue come before seeds. out(char, place, common, seed) gets what is scanned.
    """

    def __init__(self, text, alphabet: int, room: Room, horizon: int, up: bool, edges: np.ndarray, out):
        self.text, self.alphabet, self.room, self.horizon, self.up, self.out = text, alphabet, room, horizon, up, out
        self.queue = Queue(room, edges if up else np.r_[(alphabet - 2 - edges[:-1])[::-1], alphabet - 1])
        #: Key, place and kind scanned last; by character put in from that key, the least common prefix since.
        self.last, self.open = (-1, -1, False), {}

    def key(self, c):
        return c if self.up else self.alphabet - 1 - c

    def feed(self, char: np.ndarray, place: np.ndarray, shared: np.ndarray, seed: np.ndarray, narrow: bool):
        """Scans tuples in order, as far as nothing that they put in belongs between them: how many, and what they put in.

        shared: common prefix with the tuple before, right where that has the same key and kind.
        narrow: all have one key and kind, so that what they put in comes after them all.
        """
        prev = np.where(place > 0, self.key(self.text[np.maximum(place - 1, 0)].astype(np.int64)), -1)
        # What comes before a suffix is L if its character is greater, or equal and the suffix itself L. The
        # descending scan says the same of S in turned keys. Seeds are of the other kind.
        puts = np.where((prev > char) | ((prev == char) & ~seed), prev, -1)
        m = len(place)
        if not narrow and m > 1:
            ahead = np.minimum.accumulate(np.where(puts >= 0, 2 * puts, np.iinfo(np.int64).max))
            late = 2 * char[1:] + seed[1:] > ahead[:-1]
            if late.any():
                m = int(late.argmax()) + 1
                char, place, shared, seed, puts = char[:m], place[:m], shared[:m], seed[:m], puts[:m]
        last, last_place, last_seed = self.last
        before = behind(last, char)
        shared = np.where(before == char, shared, 0)
        first = (before == char) & seed & ~behind(last_seed, seed)
        if first.any():
            at = np.flatnonzero(first)
            shared[at] = common(self.text, behind(last_place, place)[at], place[at], np.zeros(len(at), np.int64), self.horizon)
        self.out(char, place, shared, seed)
        tail = int(np.searchsorted(char, char[-1]))  # from here on the last key
        at = np.flatnonzero(puts >= 0)
        new, opened = None, {}
        if len(at):
            order = at[np.argsort(puts[at], kind="stable")]
            to, src = puts[order], char[order]
            same = (to == behind(-1, to)) & (src == behind(-1, src))
            own = np.ones(len(order), np.int64)
            if same.any():
                i = np.flatnonzero(same)
                between = np.stack([order[i - 1] + 1, order[i] + 1], 1).ravel()
                own[i] = 1 + np.minimum.reduceat(np.r_[shared, self.horizon], between)[::2]
            if self.open and char[0] == last:
                fall = np.minimum.accumulate(shared)
                for i in np.flatnonzero(~same & (src == last)).tolist():
                    if (least := self.open.get(int(to[i]))) is not None:
                        own[i] = 1 + min(least, int(fall[order[i]]))
            new = tuples(to, place[order] - 1, np.minimum(own, self.horizon))
            after = np.minimum.accumulate(np.r_[shared[tail + 1 :], self.horizon][::-1])[::-1]  # from the next one on
            ends = order >= tail
            ends[:-1] &= ~same[1:]
            opened = dict(zip(to[ends].tolist(), after[order[ends] - tail].tolist(), strict=True))
        if tail == 0 and char[0] == last and self.open:
            fall = int(shared.min())
            opened = {t: min(v, fall) for t, v in self.open.items()} | opened
        self.open, self.last = opened, (int(char[-1]), int(place[-1]), bool(seed[-1]))
        return m, new

    def run(self, seeds) -> None:
        """seeds: tuples by slice(at, n), in the scan's order."""
        at, piece = 0, max(1, self.room.tuples // 4)

        def upto(edge: int) -> np.ndarray:
            t = seeds.slice(at, piece)
            return t[: np.searchsorted(t["char"], edge, side="right")]

        for i, (start, edge) in enumerate(zip(np.r_[0, self.queue.edges[:-1] + 1].tolist(), self.queue.edges.tolist(), strict=True)):
            run = self.queue.runs[i]
            if start == edge:  # first in, first out, however many there are
                done = 0
                while done < len(run):
                    done += self._whole(run.slice(done, piece), False)
                while len(t := upto(edge)):
                    at += self._whole(t, True)
            else:
                own = [run.slice(0, len(run))]
                while len(t := upto(edge)):
                    own.append(t)
                    at += len(t)
                self._several(np.concatenate(own), len(own[0]), i)
            self.queue.drop(i)

    def _fields(self, t: np.ndarray):
        return t["char"].astype(np.int64), t["place"].astype(np.int64), t["common"].astype(np.int64)

    def _whole(self, t: np.ndarray, seed: bool) -> int:
        m, new = self.feed(*self._fields(t), np.full(len(t), seed), True)
        if new is not None:
            self.queue.add(new)
        return m

    def _several(self, t: np.ndarray, own: int, i: int) -> None:
        """A range of several characters: what is put into it goes to its place among what is left.

        The front, a few thousand tuples, takes what belongs there at once; the rest waits until the front gets there.
        """
        kind = np.zeros(len(t), np.int64)
        kind[own:] = 1
        rank = 2 * t["char"].astype(np.int64) + kind
        order = np.argsort(rank, kind="stable")
        t, rank, at, window = t[order], rank[order], 0, 1024
        front, front_rank, waiting = t[:0], rank[:0], []
        self.room.held(self.queue.held + len(t))
        while at < len(t) or len(front) or waiting:
            if len(front) < window // 2 and (at < len(t) or waiting):
                to = min(len(t), at + max(4096, window))
                front, front_rank, at = np.concatenate([front, t[at:to]]), np.concatenate([front_rank, rank[at:to]]), to
                if waiting:
                    w = np.concatenate(waiting)
                    now = w["char"] < rank[at] / 2 if at < len(t) else np.ones(len(w), bool)
                    waiting = [w[~now]] if not now.all() else []
                    front, front_rank = self._placed(front, front_rank, w[now])
            m, new = self.feed(*self._fields(front[:window]), (front_rank[:window] & 1).astype(bool), False)
            front, front_rank, window = front[m:], front_rank[m:], min(1 << 16, max(256, 3 * m))
            if new is not None:
                inside = new["char"] <= self.queue.edges[i]
                if inside.any():
                    mine = new[inside]
                    now = mine["char"] < rank[at] / 2 if at < len(t) else np.ones(len(mine), bool)
                    front, front_rank = self._placed(front, front_rank, mine[now])
                    if not now.all():
                        waiting.append(mine[~now])
                if not inside.all():
                    self.queue.add(new[~inside])

    @staticmethod
    def _placed(t: np.ndarray, rank: np.ndarray, new: np.ndarray):
        """Tuples with new ones, in order of coming, behind those of equal rank."""
        if not len(new):
            return t, rank
        new = new[np.argsort(new["char"], kind="stable")]
        own = 2 * new["char"].astype(np.int64)
        to = np.searchsorted(rank, own, side="right") + np.arange(len(new))
        old = np.ones(len(t) + len(new), bool)
        old[to] = False
        both, ranks = np.empty(len(old), t.dtype), np.empty(len(old), np.int64)
        both[to], ranks[to] = new, own
        both[old], ranks[old] = t, rank
        return both, ranks


def seeds_of(text: np.ndarray, room: Room) -> np.ndarray:
    """Places of the leftmost S suffixes in ascending order, the final 0 among them."""
    n = len(text)
    out, end, right = room.array(n // 2 + 1, np.int32), n // 2 + 1, True
    for b in range(n - 1, 0, -room.tuples):
        a = max(0, b - room.tuples)
        step = np.sign(np.diff(np.asarray(text[a : b + 1], np.int64)))
        there = np.where(step != 0, np.arange(b - a), b - a)
        there = np.minimum.accumulate(there[::-1])[::-1]
        s = np.r_[step > 0, right][there]  # where equal characters go on to b, as b is
        s = np.where(there < b - a, s, right)
        both = np.r_[s, right]
        found = np.flatnonzero(both[1:] & ~both[:-1]) + a + 1
        out[end - len(found) : end] = found
        end, right = end - len(found), bool(s[0])
    return out[end:]


def blocks(text: np.ndarray, seeds: np.ndarray, alphabet: int, room: Room):
    """(keys, starts, firsts) of the blocks of the seeds' substrings, on disk. Keys are in the blocks' order.

    A substring ends with the next seed's character. Where one ends and an equal one goes on, the longer is
    smaller, since it goes on with an L suffix of the same character: the key of a block has its characters,
    filled up with a largest one, and a last bit for the end.
    """
    bits = alphabet.bit_length()
    size = min(6, 62 // bits)
    if size < 3:
        raise ValueError(f"an alphabet of {alphabet} is too large for one task")
    fill, step = (1 << bits) - 1, max(1, room.tuples // 8)
    count = 0
    for i in range(0, len(seeds), step):
        p = np.asarray(seeds[i : i + step + 1])
        count += int((-(-(np.diff(p) + 1) // size)).sum())
    count += 1
    keys, starts, firsts = room.array(count, np.int64), room.array(count, np.int32), room.array(count, np.bool_)
    at = 0
    for i in range(0, len(seeds), step):
        p = np.asarray(seeds[i : i + step + 1], np.int64)
        width = np.diff(p) + 1 if len(p) > 1 else np.empty(0, np.int64)
        if i + step >= len(seeds):
            width = np.r_[width, 1]  # the final 0
        p = p[: len(width)]
        n = -(-width // size)
        whose = np.repeat(np.arange(len(p)), n)
        nth = np.arange(len(whose)) - np.repeat(np.r_[0, n.cumsum()[:-1]], n)
        start, left = p[whose] + size * nth, width[whose] - size * nth
        k = np.zeros(len(whose), np.int64)
        for j in range(size):
            c = np.asarray(text[np.minimum(start + j, len(text) - 1)], np.int64)
            k = k << bits | np.where(j < left, c, fill)
        to = slice(at, at + len(k))
        keys[to], starts[to], firsts[to] = k << 1 | (left <= size), start, nth == 0
        at += len(k)
    keys[-1] = -1  # the final 0, found nowhere else
    return keys, starts, firsts


def named(keys: np.ndarray, room: Room) -> tuple[np.ndarray, int]:
    """Ranks of the keys among the different ones, on disk, and how many of these there are. A queue by ranges of keys puts them in order."""
    n, names = len(keys), room.array(len(keys), np.int32)
    some = np.sort(np.asarray(keys[:: max(1, n // 4096)]))
    parts = max(1, 4 * n // room.tuples)
    at = some[np.linspace(0, len(some) - 1, parts + 1).astype(int)[1:-1]]
    edges = np.unique(np.r_[at - 1, at, np.iinfo(np.int64).max]) if parts > 1 else np.array([np.iinfo(np.int64).max])
    queue, piece = Queue(room, edges, KEYED), max(1, room.tuples // 4)
    for i in range(0, n, piece):
        k = np.asarray(keys[i : i + piece])
        queue.add(tuples(k, np.arange(i, i + len(k))))
    rank, last = -1, None
    for i, run in enumerate(queue.runs):
        one = i and int(edges[i]) - int(edges[i - 1]) == 1
        for j in range(0, len(run), piece if one else max(1, len(run))):
            t = run.slice(j, piece if one else len(run))
            t = t[np.argsort(t["char"], kind="stable")]
            c = t["char"]
            new = np.r_[last is None or c[0] != last, c[1:] != c[:-1]]
            r = rank + np.cumsum(new)
            names[t["place"]] = r
            rank, last = int(r[-1]), c[-1]
        queue.drop(i)
    return names, rank + 1


def ordered(names: np.ndarray, room: Room) -> Run:
    """The order of a text without repeated characters, from the largest suffix on; its 0 is left out."""
    place = room.array(len(names), np.int32)
    for i in range(0, len(names), room.tuples):
        place[np.asarray(names[i : i + room.tuples])] = np.arange(i, min(len(names), i + room.tuples))
    out = Sink(room)
    for i in range(len(names), 1, -room.tuples):
        p = np.asarray(place[max(1, i - room.tuples) : i])[::-1]
        out.add(tuples(0, p, 0))
    return out


def within(text: np.ndarray, room: Room, horizon: int) -> Run:
    """As ordered(), of a text that fits in memory, by prefix doubling up to the horizon."""
    text = np.asarray(text, np.int64)
    n, rank, reach = len(text), text, 1
    while reach < horizon:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = pair[order] != behind(-1, pair[order])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            break
        reach *= 2
    place = np.argsort(rank, kind="stable")[:0:-1]
    shared = common(text, behind(n - 1, place), place, np.zeros(len(place), np.int64), horizon)
    out = Sink(room)
    out.add(tuples(0, place, shared))
    return out


def sort(text: np.ndarray, alphabet: int, room: Room, horizon: int, out, depth: int = 1) -> None:
    """Gives out(char, place, common, seed) all suffixes but the final 0 from the largest on, with the common prefix with the one before. Characters come turned round."""
    room.depth = max(room.depth, depth)
    places = seeds_of(text, room)
    keys, starts, firsts = blocks(text, places, alphabet, room)
    del places
    names, different = named(keys, room)
    del keys
    if different == len(names):
        deeper = ordered(names, room)
    elif len(names) <= room.small:
        deeper = within(names, room, horizon)
    else:
        deeper = Sink(room)
        sort(names, different, room, horizon, lambda c, p, s, _: deeper.add(tuples(c, p, s)), depth + 1)
    del names
    seeds, up = Sink(room), Backwards(deeper)
    seeds.add(tuples(0, np.array([len(text) - 1]), 0))
    last, least, piece = len(text) - 1, 0, max(1, room.tuples // 4)
    for i in range(0, len(up), piece):
        t = up.slice(i, piece)
        at = np.flatnonzero(firsts[t["place"]])
        if not len(at):
            least = min(least, int(t["common"].min()))
            continue
        # Names in common with the seed before: the least of all blocks between.
        share = np.minimum.reduceat(np.r_[t["common"], horizon], np.r_[0, at + 1])[:-1].astype(np.int64)
        share[0] = min(share[0], least)
        least = int(t["common"][at[-1] + 1 :].min(initial=horizon))
        b = t["place"][at].astype(np.int64)
        p = np.asarray(starts[b], np.int64)
        known = np.asarray(starts[b + share]) - p
        seeds.add(tuples(text[p], p, common(text, np.r_[last, p[:-1]], p, known, horizon)))
        last = int(p[-1])
    deeper.drop()
    del starts, firsts
    edges, found = ranges(text, alphabet, room), Sink(room)

    def keep(c, p, s, seed):
        if not seed.all():
            found.add(tuples(c, p, s)[~seed])

    Scan(text, alphabet, room, horizon, True, edges, keep).run(seeds)
    seeds.drop()
    Scan(text, alphabet, room, horizon, False, edges, out).run(Backwards(found, lambda c: alphabet - 1 - c))
    found.drop()


def repeats(text: np.ndarray, horizon: int, folder: str | None = None, room: Room | None = None) -> np.ndarray:
    """Places whose next `horizon` characters also start elsewhere. text: an array or memory map of integers from 0 on, 0 between parts; what reaches over a 0 is no repeat."""
    n = len(text)
    with tempfile.TemporaryDirectory(dir=folder) as own:
        room = room or Room(own)
        room.folder = own
        marked = room.array(n, np.bool_)
        if n < 2:
            return np.zeros(n, bool)
        alphabet = max(int(text[i : i + room.tuples].max()) for i in range(0, n, room.tuples)) + 2
        whole = room.array(n + 1, np.int16 if alphabet < 1 << 15 else np.int32)
        for i in range(0, n, room.tuples):
            whole[i : min(n, i + room.tuples)] = text[i : i + room.tuples] + 1
        whole[n] = 0
        last = -1

        def mark(_, place, shared, __):
            nonlocal last
            hit = np.flatnonzero(shared >= horizon)
            marked[place[hit]] = True
            marked[np.r_[last, place[:-1]][hit]] = True
            last = int(place[-1])

        sort(whole, alphabet, room, horizon, mark)
        # Windows that reach over a 0 go, from the end on.
        end = n
        for b in range(n, 0, -room.tuples):
            a = max(0, b - room.tuples)
            zero = np.r_[np.flatnonzero(np.asarray(text[a:b]) == 0) + a, end]
            at = np.arange(a, b)
            marked[a:b] &= zero[np.searchsorted(zero, at)] - at >= horizon
            end = int(zero[0])
        return np.array(marked)
