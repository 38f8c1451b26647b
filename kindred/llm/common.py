"""What the operators of this subpackage share: reading tables, cutting lineage and bounding Arrow batches."""

from __future__ import annotations

import gc
import math
import tempfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch handed to Python; a batch always holds one row at least.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes, so that long texts do not make huge batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs locally."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="kindred-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that a task of a small frame takes on average.
TASK_ROWS = 20_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """The frame in as many parts as `rows` rows, an upper bound of what it has, are worth, and in no more than it has.
    Few rows in a great many parts cost a task and files for each part in every shuffle that follows. A frame of many
    rows stays as it is."""
    return df.coalesce(parts_for(rows, TASK_ROWS))


#: Keys that `attached` takes as hot: so many at most, each of more rows than LEAST_HOT.
HOT_KEYS, LEAST_HOT = 500, 200


def attached(rows: DataFrame, keyed: DataFrame, *keys: str, count: str | None = None) -> DataFrame:
    """`rows` joined with `keyed`, which has one row for each key. The most frequent keys, `HOT_KEYS` at most, meet
    their rows where they lie, by a broadcast of so many rows; the others go by a shuffle, and none of them is in more
    than one of `HOT_KEYS` rows. count: a column of `keyed` that says how many rows a key has, if it is known.
    Both frames are read several times, so they should be checkpoints or tables."""
    counts = keyed.select(*keys, F.col(count).alias("_n")) if count else rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    often = counts.filter(F.col("_n") > LEAST_HOT)
    found = often.orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).drop("_n").collect()
    if not found:
        return rows.join(keyed, list(keys))
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, often.select(*keys).schema))
    few = F.broadcast(keyed.join(hot, list(keys), "left_semi"))
    return rows.join(few, list(keys)).unionByName(rows.join(hot, list(keys), "left_anti").join(keyed, list(keys)))


def forget(spark: SparkSession) -> None:
    """Let the driver see which frames nothing refers to any more, so that Spark removes their shuffle files and
    checkpoints."""
    gc.collect()
    spark._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this package's own, wherever the shared file system is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows of fold 2 are held out from learning."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def release() -> None:
    """Give back what a Python worker holds but no longer uses; workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def parts_for(n: int, per_part: int) -> int:
    return max(1, math.ceil(n / per_part))
