"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir` (a temporary one where it is unset and Spark runs locally)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="kindred-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder of checkpoints."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
