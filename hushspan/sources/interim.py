"""Intermediates in the shared folder, so that a costly result is computed once and survives lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hushspan.session import shared_dir


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and go on from the files of a reliable checkpoint.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes them when the result is no
    longer in use.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
