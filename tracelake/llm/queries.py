"""The registered queries of the corpus operators: each runs one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, merkle, mixing, packing, periodic, pii, quality, simhash, substrings, tokens, toxicity, urls, warc
from .common import shared_dir, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = shared_dir(spark, "tokens")
    tokens.write(table(spark, sf_dir, "documents"), url, vocabulary(), 2)
    return tokens.checksums(spark, url).withColumnRenamed("key", "doc_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out("doc_id")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~out)
    s = toxicity.score(docs, model)
    return s.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), url)
    back = warc.read(spark, url)
    return back.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = exact.groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_urls": op5_urls,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_suffix_array": op9_suffix_array,
    "op10_simhash": op10_simhash,
    "op11_pii": op11_pii,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Where SQL can say the same.
SQL: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op5_urls": urls.SQL,
    "op13_merkle_manifest": merkle.sql(),
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
""",
}
