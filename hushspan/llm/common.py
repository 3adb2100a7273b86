"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """Compute once and go on from files in the folder of spark.checkpoint.dir.

    The lineage ends there, so a lost executor costs nothing that was settled before.  The folder
    is the cluster's; only a session without the setting, such as a test, gets a folder of its own.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hushspan-"))
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without it, such as a test, gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hushspan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch of texts; with the default of 10,000 a batch alone can take some 100 MB.
TEXT_ROWS = 1_000


def text_batches(df: DataFrame) -> DataFrame:
    """The same rows, for a Python step that gets whole texts: its session sends small batches from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))
    return df


def id_text(column: Column | str) -> Column:
    """An id as text, for hashes; a null id reads as an empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True for documents of the fold that learning never sees."""
    return (F.crc32(id_text(doc_id).cast("binary")) % folds) == fold
