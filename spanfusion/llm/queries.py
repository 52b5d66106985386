"""The queries of the operators: name -> function of a session and a folder of tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanfusion.llm import chat, decontaminate, divergence, fingerprints, language, near_duplicates, oracles, pii, search, secrets, sentencepiece_scan, substrings, suffix_dedup, toxicity
from spanfusion.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sentencepiece_scan.encode(table(spark, sf_dir, "documents"), decoded=True)
    same = F.sha2(F.col("text").cast("binary"), 256) == F.col("text_sha256")
    return texts.select("doc_id", "n_chars", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", F.coalesce(same, F.col("text").isNull()).alias("round_trip"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.link(fingerprints.fingerprint(table(spark, sf_dir, "documents")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.train(documents))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pii.find(documents, pii.train(documents))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.cluster(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, as records of four layouts, and one that says control strings, formatted and read back."""
    given = chat.as_records(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, json.dumps({"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]}))], "conv_id long, turn long, record string")
    return chat.read_back(chat.formatted(chat.canonical(given.unionByName(more))))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_fingerprints, op3_language, op4_suffix_dedup, op5_toxicity, op6_pii, op7_decontaminate, op8_secrets, op9_near_duplicates, op10_substring_dedup, op11_chat_format, op12_lexical_search, op13_source_divergence,
    )
}

#: The other operators learn models or search by hash; the tests hold them against brute force.
ORACLES: dict[str, str] = oracles.ORACLES
