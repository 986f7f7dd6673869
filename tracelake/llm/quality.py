"""Quality rules: fixed text rules, then a log-likelihood ratio of hashed n-grams.

Every document is seen as a draw from a multinomial over hashed n-grams. One multinomial is
estimated from all documents, another from trusted ones; a document's score is the mean over its
n-grams of log(p_trusted / p_raw). A document is kept if the base rules hold and its score reaches
a threshold that is itself a statistic of all trusted documents, so the same input always gives
the same verdicts. Only DataFrame functions are used.

Cases: a null text counts as empty; empty and blank texts fail the base rules (no words); repeated
rows are judged one by one with equal verdicts; with no trusted document the ratio is 0 for every
n-gram and only the base rules decide; a very long text is one row whose words and n-grams are all counted, none
left out; an empty table gives an empty result; extra columns of the input pass through untouched, and the
added columns win over columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, let, words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]+"
#: Runs of letters and digits, and runs of anything else that is not white space.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
BUCKETS = 8192
#: The verdict's threshold lies this many standard deviations below the mean score of trusted documents.
DEVIATIONS = 8.0
#: Words of 64 ids up to which the trusted ids are broadcast: 64 million ids where they lie close. Beyond, Spark joins texts and ids by shuffling.
MASKS = 1_000_000
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def windows(w: Column) -> Column:
    """A 64-bit hash of each three-word window of an array of words, in order."""
    n = F.greatest(F.size(w) - 2, F.lit(0))
    return F.transform(F.slice(w, 1, n), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))


def repeat_words(w: Column, win: Column) -> Column:
    """Words of w lying in a three-word window that occurs twice or more in the same text; win: windows(w).

    Most texts repeat none, which their distinct hashes tell. For the others, 33 bits of each
    window's hash and its place share one long, so that sorting plain longs brings likely repeats
    together; those are then compared as strings, so a collision changes nothing.
    """
    zero, place = F.lit(0).cast("long"), 1 << 31
    mark = lambda x: F.shiftright(x, 31)

    def exact(cand):
        named = F.transform(cand, lambda x: F.struct(F.concat_ws(" ", F.slice(w, x + 1, 3)).alias("h"), x.alias("i")))
        same = lambda s, x, i: F.coalesce(x["h"] == F.get(s, i)["h"], F.lit(False))
        return let(F.sort_array(named), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)), lambda x: x["i"])))

    def covered(p):
        """p: first words of repeated windows, ascending. Each covers 3 words or as many as come before the next."""
        step = lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3)).cast("long")
        return F.aggregate(F.transform(p, step), zero, lambda a, x: a + x)

    def likely(s):
        same = lambda x, i: F.coalesce(mark(x) == mark(F.get(s, i)), F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.bitwiseAND(place - 1).cast("int"))

    packed = F.transform(win, lambda x, i: mark(x) * place + i)
    found = let(F.sort_array(packed), lambda s: let(likely(s), lambda c: let(exact(c), covered)))
    return F.when(F.size(F.array_distinct(win)) == F.size(win), zero).otherwise(found)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base columns, the text's words not included."""
    w, t, win = fresh(docs, "_w", "_t", "_win")
    d = docs.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(w, words(F.col(t))).withColumn(win, windows(F.col(w)))
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    d = d.select(
        *keep, t,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col(t)).alias("n_dup_lines"),
        repeat_words(F.col(w), F.col(win)).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop(t)


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the text's unigrams and bigrams."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def hashed(t):
        one = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        two = F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")))
        return F.concat(one, F.filter(two, lambda x: x.isNotNull()))

    return let(tokens, hashed)


def ratios(docs: DataFrame, trusted: Column, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row: ratio array<double> by bucket, from counts over all of docs. At most `buckets` rows are gathered for it.

    trusted: condition on docs. Add-one smoothing in each bucket.
    """
    b = F.explode(features(F.col(text), buckets)).alias("b")
    n = docs.select(F.coalesce(trusted, F.lit(False)).cast("long").alias("t"), b).groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("good"))
    all_of_them = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    n = all_of_them.join(n, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    packed = n.agg(F.array_sort(F.collect_list(F.struct("b", "raw", "good"))).alias("x"), F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    ratio = F.transform("x", lambda x: F.log((x["good"] + 1) / (F.col("good") + buckets)) - F.log((x["raw"] + 1) / (F.col("raw") + buckets)))
    return packed.select(F.when(F.col("good") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("ratio"))


def scored(docs: DataFrame, ratio: list[float], text: str = "text") -> Column:
    """Mean ratio of a text's n-grams; 0 for none. ratio: of fixed length, by bucket."""
    r = F.lit(ratio)
    f = features(F.col(text), len(ratio))
    mean = lambda a: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.aggregate(a, F.lit(0.0), lambda s, b: s + F.get(r, b)) / F.size(a))
    return let(f, mean)


def marked(docs: DataFrame, ids: DataFrame, key: str, good: str, most: int = MASKS) -> DataFrame:
    """docs with a column `good`: whether their key is among ids (_k).

    Whole numbers are packed into words of 64 bits, so that all ids can be broadcast and no text is
    shuffled. Other keys, and ids that lie too far apart for it, are joined as Spark chooses.
    """
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return docs.join(ids.distinct(), F.col(key) == F.col("_k"), "left").withColumn(good, F.col("_k").isNotNull()).drop("_k")
    place = lambda k: k.cast("long").bitwiseAND(63).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place(F.col("_k")))
    masks = cut(ids.groupBy(F.shiftright(F.col("_k").cast("long"), 6).alias("_k")).agg(F.bit_or(bit).alias("_m")), "trusted")
    masks = F.broadcast(masks) if masks.count() <= most else masks
    j = docs.join(masks, F.shiftright(F.col(key).cast("long"), 6) == F.col("_k"), "left")
    return j.withColumn(good, F.coalesce(F.getbit("_m", place(F.col(key))) == 1, F.lit(False))).drop("_k", "_m")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, deviations: float = DEVIATIONS) -> DataFrame:
    """docs with the base columns, score and kept.

    labels: key and quality; documents with a quality of 1 are trusted. The raw multinomial counts
    all documents; the trusted one, and the threshold's mean and deviation, all trusted documents.
    """
    (good,) = fresh(docs, "_good")
    trusted = labels.where(F.col("quality") == 1).select(F.col(key).alias("_k")).where("_k IS NOT NULL")
    raw = marked(docs.select(key, text), trusted, key, good)
    ratio = [float(x) for x in ratios(raw, F.col(good), text, buckets).first()["ratio"]]
    sure = raw.where(F.col(good))
    stats = sure.select(scored(sure, ratio, text).alias("s")).agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).first()
    least = stats["m"] - deviations * stats["d"] if stats["m"] is not None else float("-inf")
    out = base(docs, text).withColumn("score", scored(docs, ratio, text))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(round(least, 6))))


def keep(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that judge() keeps.

    A plain filter would move below the columns of words and windows and compute them anew for every
    element. Spark moves none below a projection that holds a random column, so the filter names one
    that is always true.
    """
    (always,) = fresh(docs, "_always")
    judged = judge(docs, labels, **how).withColumn(always, F.rand())
    return judged.where(F.col("kept") & (F.col(always) >= 0)).select(docs.columns)
