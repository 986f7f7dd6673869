"""Redaction of texts of any length and shape, against the plain patterns."""

import random
from functools import reduce

from pyspark.sql import functions as F

from tracelake.functions import expr as X


def test_searched_patterns_match_as_the_plain_ones(spark):
    r = random.Random(3)
    parts = ["a", "b.", "@", "x@y.org", ".com", "-", "%", "_", "+", "1.2.3.4", ".", " ", "\n", "\\", "\\\\", "C:\\", "d:/", "/home/", "/Users/", "/", ":", '"', "u", "%temp%", "[12:ab:", "f]", "\u00e9", "\u65e5", "|", "kim"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(6000)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    plain = reduce(lambda x, p: F.regexp_replace(x, p[0], F.lit(p[1])), X.LITERALS + X.PATHS, F.col("t"))
    assert d.select("t", X.redact(F.col("t"), True).alias("r"), plain.alias("p")).where("r <> p").collect() == []


def test_long_texts_are_searched(spark):
    mail, words = "kim@example.org and 10.1.2.3", "some words\n" * 20_000
    texts = {words: words, words + mail: words + "[email] and [ipv4]", "a." * 500_000: "a." * 500_000, "/home" + "/ab" * 100_000 + " x": "[path_redacted] x", "C:" + "\\ab" * 100_000: "[path_redacted]", "\\\\srv" + "\\ab" * 100_000: "[path_redacted]"}
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {x["t"]: x["r"] for x in d.select("t", X.redact(d["t"], True).alias("r")).collect()}
    assert all(got[t] == w for t, w in texts.items())
