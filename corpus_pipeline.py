"""From documents to token ids: language, near duplicates, secrets, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again
as the next one's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from hushspan.llm import langid, mixing, pieces, secretscan, shingles
from hushspan.llm.common import table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or letters, or of a language that cannot be told, go."""
    return langid.in_known_languages(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Links are those of SimHash fingerprints (pivot distance tables) and of five-word shingles (similarity 0.8).
    """
    return shingles.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a placeholder; every document stays."""
    return secretscan.redacted(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text and the bytes that each piece stands for."""
    return pieces.encoded(docs, ["n_tokens", "ids", "ends", "ids_sha256", "decoded_sha256"], ["doc_id", "source"])


STAGES = [
    ("language ID", known_languages),
    ("SimHash near-dedup", one_of_near_copies),
    ("secret scans", without_secrets),
    ("mixing to target weights", to_weights),
    ("SentencePiece encoding", to_pieces),
]

#: SQL has neither the language model nor the forest; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`, with each result written to the shared folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hushspan-")
    place = f"{folder.rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{number}")
        docs = spark.read.parquet(f"{place}/{number}")
    return docs
