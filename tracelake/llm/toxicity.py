"""Toxicity: a linear classifier over hashed character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and runs of white space become one blank. A text's features are the distinct
buckets of its character n-grams of several lengths. On labelled documents each bucket's log-count
ratio r = log(p / |p|) - log(q / |q|) is taken from how many toxic and other documents have it (p
and q, smoothed by one); buckets that tell the classes apart significantly are kept, their presence
is scaled by r (only those with a chi-square of TELLING at least, in three documents or more, and of
these the KEPT that tell most), and a logistic regression with L2 penalty is fitted on that. It is fitted on a
bounded sample of labelled rows (`most` of each class, those with the smallest hashes, weighted back to
the share of their class) in one task; every document is scored where it is read.

Cases: null, empty and blank texts have no feature and score the model's bias; very long texts are
scored whole, in pieces; of several labels of a document the highest counts; without labels of
both classes every score is 0; repeated rows get equal scores; an empty table gives an empty
result; only the text is an input of a score, extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

BUCKET_BITS, LENGTHS = 20, (3, 4, 5)
#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 4_000
#: Least chi-square of a kept bucket, and how many are kept at most.
TELLING, KEPT = 20.0, 16_384
PENALTY, ROUNDS = 1e-6, 1000
TOXIC = 0.7
PIECE = 1 << 21


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of the texts, which are cleaned."""
    clean = texts
    length = np.array([len(t) for t in clean], np.int64)
    code = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), length)
    h, whose, out = code * np.uint64(0x9E3779B97F4A7C15), [], []
    for n in range(2, max(LENGTHS) + 1):
        if len(code) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + code[n - 1 :]
        if n in LENGTHS:
            inside = of[: len(h)] == of[n - 1 :]
            out.append(((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BUCKET_BITS))[inside].astype(np.int64))
            whose.append(of[: len(h)][inside])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(whose), np.concatenate(out)


def cleaned(text: str | None) -> str:
    """Lower case, runs of white space as one blank, a blank at both ends."""
    return " " + " ".join((text or "").lower().split()) + " "


def pieces(texts: list[str | None]):
    """Runs of cleaned texts of about PIECE characters: (numbers, parts). Parts of a long text overlap so that each n-gram lies in one, and hold none that it has not."""
    numbers, parts, size = [], [], 0
    step = PIECE - max(LENGTHS) + 1
    for i, t in enumerate(texts):
        t = cleaned(t)
        for at in range(0, max(1, len(t) - max(LENGTHS) + 1), step):
            part = t[at : at + PIECE]
            numbers.append(i)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield np.array(numbers), parts
                numbers, parts, size = [], [], 0
    if parts:
        yield np.array(numbers), parts


def present(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket), only of wanted buckets (a boolean for each)."""
    found = []
    for numbers, parts in pieces(texts):
        of, b = grams(parts)
        if wanted is not None:
            use = wanted[b]
            of, b = of[use], b[use]
        found.append(np.unique(numbers[of] << BUCKET_BITS | b) if len(b) else np.empty(0, np.int64))
    key = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias)."""
    size = 1 << BUCKET_BITS
    counts, last = np.zeros((2, size)), np.zeros(size, np.int32)
    for text, t in zip(texts, toxic, strict=True):
        for _, parts in pieces([text]):
            _, b = grams(parts)
            at = np.arange(len(b), dtype=np.int32)
            last[b] = at
            counts[t, b[last[b] == at]] += 1  # each bucket once
    n = np.array([(toxic == c).sum() for c in (0, 1)], float)
    share, both = counts / n[:, None], counts.sum(0) / n.sum()
    chi = (share[1] - share[0]) ** 2 / np.maximum(both * (1 - both), 1e-9) * n[0] * n[1] / n.sum()
    chi[counts.sum(0) < 3] = 0
    keep = np.sort(np.argsort(-chi, kind="stable")[:KEPT])
    keep = keep[chi[keep] >= TELLING]
    smooth = counts[:, keep] + 1
    r = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    place = np.full(size, -1, np.int64)
    place[keep] = np.arange(len(keep))
    wanted = place >= 0
    rows, cols = [], []
    for i in range(0, len(texts), 500):
        of, b = present(texts[i : i + 500], wanted)
        rows.append(of + i)
        cols.append(place[b])
    row, col = np.concatenate(rows), np.concatenate(cols)
    value = r[col]
    weight = weight / weight.sum()
    w, bias, at, at_bias = np.zeros(len(keep)), 0.0, np.zeros(len(keep)), 0.0
    norm = np.bincount(row, value**2, minlength=len(texts))
    step = 4 / (np.percentile(norm, 95) + 1) if len(keep) else 1.0
    for k in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * at[col], minlength=len(texts)) + at_bias, -40, 40)))
        error = weight * (p - toxic)
        new = at - step * (np.bincount(col, value * error[row], minlength=len(keep)) + PENALTY * at)
        new_bias = at_bias - step * error.sum()
        pull = k / (k + 3)
        at, at_bias = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias = new, new_bias
    return keep, w * r, float(bias)


def train(docs: DataFrame, labels: DataFrame, use, key: str = "doc_id", text: str = "text", most: int = SAMPLE):
    """fit() on labelled rows (key, toxic) for which the condition `use` on them holds; None without both classes."""
    marks = cut(labels.where("toxic IS NOT NULL").where(use).groupBy(F.col(key).alias("_k")).agg(F.max("toxic").cast("int").alias("_t")), "marks")
    n = {r["_t"]: r["count"] for r in marks.where("_t IN (0, 1)").groupBy("_t").count().collect()}
    if len(n) < 2:
        return None
    some = [marks.where(F.col("_t") == c).orderBy(F.xxhash64("_k"), "_k").limit(most).withColumn("_w", F.lit(n[c] / min(n[c], most))) for c in (0, 1)]
    chosen = F.broadcast(cut(some[0].unionByName(some[1]), "chosen"))  # at most 2 * most ids

    def of(batches):
        texts, toxic, weight = [], [], []
        for b in batches:
            texts += [t or "" for t in b.column(0).to_pylist()]
            toxic += b.column(1).to_pylist()
            weight += b.column(2).to_pylist()
        if len(set(toxic)) == 2:
            buckets, w, bias = fit(texts, np.array(toxic), np.array(weight))
            yield pa.RecordBatch.from_pydict({"buckets": [buckets.tolist()], "w": [w.tolist()], "bias": [bias]})

    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(chosen, F.col("_id") == F.col("_k")).select("_text", "_t", "_w")
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("_text"), "_t").mapInArrow(of, "buckets array<long>, w array<double>, bias double").first()
    return one and (np.array(one["buckets"], np.int64), np.array(one["w"]), one["bias"])


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row."""
    schema = f"`{key}` long, score double"

    def of(batches):
        if model is not None:
            weights = np.zeros(1 << BUCKET_BITS)
            weights[model[0]] = model[1]
            wanted = weights != 0
        for b in batches:
            s = np.zeros(b.num_rows)
            if model is not None:
                whose, bucket = present(b.column(1).to_pylist(), wanted)
                s = 1 / (1 + np.exp(-np.clip(np.bincount(whose, weights[bucket], minlength=b.num_rows) + model[2], -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], [key, "score"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text")).mapInArrow(of, schema)


def held_out(key):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1
