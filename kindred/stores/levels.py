"""Keyed values that end, in one level or two.

A level is a folder of Parquet runs for each kind of value (`emb`, `centroid`, `sim`). A key's newest value counts until it
ends. `get` of two levels asks the upper one first, then the lower one, and puts what it finds there into the upper one,
where it ends after the upper level's time.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.stores import files
from kindred.stores.lineage import kept

# The kinds of values, and the seconds that one of the upper level lasts.
KINDS, DAY = ("emb", "centroid", "sim"), 86_400


def at(now: datetime | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def pair_name(method: str, metric: str, a: Column, b: Column) -> Column:
    """The key of a pair's similarity: method, both names in order of their lower-cased forms, metric."""
    first, second = F.when(F.lower(a) <= F.lower(b), a).otherwise(b), F.when(F.lower(a) <= F.lower(b), b).otherwise(a)
    return F.concat_ws(":", F.lit(method), first, second, F.lit(metric))


class Level:
    """Values of a level: `key string`, `value array<double>` (one number for a similarity). seconds: how long one lasts;
    None for ever."""

    def __init__(self, spark: SparkSession, folder: str, seconds: int | None = None):
        self.spark, self.folder, self.seconds = spark, folder, seconds

    def runs(self, kind: str) -> list[str]:
        """The whole runs of a kind, by name, so that a frame reads those that are there when it is made."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}; use one of {KINDS}")
        place = f"{self.folder}/{kind}"
        return [f"{place}/{n}" for n in files.names(self.spark, place) if files.exists(self.spark, f"{place}/{n}/_SUCCESS")]

    def put(self, kind: str, rows: DataFrame, now: datetime | None = None, seconds: int | None = None) -> None:
        """Add `key, value` rows; they last for `seconds`, or the level's own time."""
        lasts = self.seconds if seconds is None else seconds
        end = F.lit(None).cast("timestamp") if lasts is None else at(now) + F.make_dt_interval(secs=F.lit(float(lasts)))
        self.runs(kind)  # a kind that is not known is an error
        rows.select("key", F.col("value").cast("array<double>").alias("value"), at(now).alias("ts"), end.alias("ends")).write.parquet(f"{self.folder}/{kind}/{uuid.uuid4().hex}")

    def all(self, kind: str, now: datetime | None = None) -> DataFrame:
        """`key, value, ts, ends` of the values that have not ended: the newest of each key, of equal times the one that
        lasts longest."""
        runs = self.runs(kind)
        schema = "key string, value array<double>, ts timestamp, ends timestamp"
        if not runs:
            return self.spark.createDataFrame([], schema)
        newest = F.max_by(F.struct("value", "ts", "ends"), F.struct("ts", F.coalesce("ends", F.lit(datetime(9999, 1, 1)).cast("timestamp"))))
        rows = self.spark.read.schema(schema).parquet(*runs).groupBy("key").agg(newest.alias("_r")).select("key", "_r.*")
        return rows.filter(F.col("ends").isNull() | (F.col("ends") > at(now)))

    def get(self, kind: str, keys: DataFrame, now: datetime | None = None) -> DataFrame:
        """`key, value` of the distinct keys; null where there is none."""
        return keys.select("key").distinct().join(self.all(kind, now).select("key", "value"), "key", "left")

    def compact(self, kind: str, now: datetime | None = None) -> int:
        """Put what counts into one run, without what has ended or been replaced, and return how many values there are.
        The new run is whole before the old ones go, and a value that is in both counts once."""
        old, rows = self.runs(kind), kept(self.all(kind, now))
        if not old:
            return 0
        rows.write.parquet(f"{self.folder}/{kind}/{uuid.uuid4().hex}")
        for run in old:
            files.remove(self.spark, run)
        return rows.count()

    def clear(self, *kinds: str) -> None:
        """Remove all values of some kinds, or of all."""
        for kind in kinds or KINDS:
            self.runs(kind)
            files.remove(self.spark, f"{self.folder}/{kind}")


class TwoLevels:
    """An upper level whose values end, and a lower one whose values last."""

    def __init__(self, spark: SparkSession, upper: str, lower: str, seconds: int = DAY):
        self.upper, self.lower = Level(spark, upper, seconds), Level(spark, lower)

    def get(self, kind: str, keys: DataFrame, now: datetime | None = None) -> DataFrame:
        """`key, value, level` of the distinct keys: `upper`, `lower`, or null where neither has it. What only the lower
        level has is in the upper one afterwards."""
        above = kept(self.upper.get(kind, keys, now))
        missed = above.filter("value IS NULL").select("key")
        below = kept(self.lower.get(kind, missed, now))
        raised = below.filter("value IS NOT NULL")
        if not raised.isEmpty():
            self.upper.put(kind, raised, now)
        level = lambda name: F.when(F.col("value").isNotNull(), F.lit(name))
        return above.filter("value IS NOT NULL").withColumn("level", level("upper")).unionByName(below.withColumn("level", level("lower")))

    def get_or(self, kind: str, keys: DataFrame, compute, now: datetime | None = None) -> DataFrame:
        """As `get`, with `compute(keys)` (`key, value`) for keys that neither level has: level `new`, put into both."""
        found = kept(self.get(kind, keys, now))
        missed = found.filter("level IS NULL").select("key")
        if missed.isEmpty():
            return found
        fresh = kept(compute(missed).select("key", F.col("value").cast("array<double>").alias("value")))
        self.upper.put(kind, fresh, now)
        self.lower.put(kind, fresh, now)
        return found.filter("level IS NOT NULL").unionByName(fresh.withColumn("level", F.lit("new")))
