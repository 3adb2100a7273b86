"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushspan.llm import (
    alignment, crosspolytope, hardnegatives, langid, maxscore, mixing, pieces, quality, secretscan, simhash, toxicity, urllists, warc)
from hushspan.llm.common import table


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, as digests of the ids and of the decoded text."""
    want = ["n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"]
    return pieces.encoded(table(spark, sf_dir, "documents"), want, ["doc_id"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urllists.query(spark, sf_dir)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(spark, table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardnegatives.query(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxscore": op1_maxscore,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash": op3_simhash,
    "op4_url_lists": op4_url_lists,
    "op5_mixing": op5_mixing,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_cross_polytope": op10_cross_polytope,
    "op11_warc": op11_warc,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op1_maxscore": maxscore.ORACLE,
    "op4_url_lists": urllists.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op11_warc": warc.ORACLE,
    "op12_hard_negatives": hardnegatives.ORACLE,
}
