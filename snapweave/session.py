"""Session settings the operators rely on, and checkpoints in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder the cluster names; a temporary one only where none is set (tests, local runs)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="snapweave-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative computation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
