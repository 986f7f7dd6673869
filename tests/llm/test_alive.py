"""Query 9 sorts only pieces that may share a window."""

import random
from collections import Counter

import pyarrow as pa

from tracelake.llm import substrings as s

COLUMNS = ["hash", "m", "pid", "row", "start", "off", "data"]


def test_what_cannot_repeat_is_not_sorted():
    rng = random.Random(5)
    word = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    anchor, near = word(32), word(60)
    apart = [(1, 0, i, 0, 160, word(100) + near + anchor + near + word(100)) for i in range(4)]  # 152 bytes in common
    assert s._alive(apart) == []
    left = word(160)
    same = [(1, 0, 1, 7, 168, b"xxxxxxxx" + left + anchor + b"a" * 60), (1, 0, 2, 9, 160, left + anchor + word(8) + b"b" * 9), (1, 0, 3, 0, 160, left + anchor + b"a" * 30)]
    alive = s._alive(same)
    assert {x[2] for x in alive} == {1, 3} and all(len(x[4]) < len(same[x[2] - 1][5]) + 1 for x in alive)
    assert s._alive([(2, *x[1:]) for x in same]) == []  # settled as a whole elsewhere


def test_no_repeated_window_is_lost():
    rng = random.Random(6)
    rows = []
    for h in range(60):
        base = bytes(rng.randrange(97, 123) for _ in range(400))
        at = rng.randrange(170, 190)  # the anchor's place in base
        for i in range(rng.randrange(2, 6)):
            first = rng.randrange(at - 168, at + 1)
            last = rng.randrange(first, at + 1)
            data = bytearray(base[first : last + s.LENGTH])
            for _ in range(rng.randrange(3)):
                if not 0 <= (k := rng.randrange(len(data))) - (at - first) < 32:
                    data[k] = 65
            rows.append((h, rng.choice((1, 1, 2)), 0, 1000 * h + i, rng.randrange(50), at - first, bytes(data)))
    windows = Counter(r[-1][i : i + s.LENGTH] for r in rows for i in range(len(r[-1]) - s.LENGTH + 1))
    want = {(r[3], r[4] + i + k) for r in rows if r[1] == 1 for i in range(len(r[-1]) - s.LENGTH + 1) if windows[r[-1][i : i + s.LENGTH]] > 1 for k in range(s.LENGTH)}
    cols = [pa.array(c, pa.binary() if n == "data" else pa.int64()) for n, c in zip(COLUMNS, zip(*rows, strict=True), strict=True)]
    got = {(row, k) for b in s._shard([pa.RecordBatch.from_arrays(cols, COLUMNS)]) for _, row, a, e in zip(*(c.to_pylist() for c in b.columns), strict=True) for k in range(a, e)}
    assert want and got == want
