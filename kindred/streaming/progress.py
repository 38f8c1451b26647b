"""The latest state of each task, and tasks that have gone quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The states that end a task, and for how many seconds one that has ended is still listed.
FINISHED, LISTED_SECONDS = ("completed", "failed"), 10
#: Timers need this store of states.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest(events: DataFrame, task: str = "task_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """One row for each task: its newest event's status and progress. Runs on a batch and, in update or complete mode,
    on a stream alike."""
    newest = F.max(F.struct(ts, tie, "status", "progress")).alias("_e")
    return events.groupBy(task).agg(newest, F.count("*").alias("events")).select(task, f"_e.{ts}", "_e.status", "_e.progress", "events")


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Events and mean progress by status and window of time; events later than `late` are dropped from a stream."""
    own = events.withWatermark(ts, late) if events.isStreaming else events
    return own.groupBy(F.window(ts, length), "status").agg(F.count("*").alias("events"), F.avg("progress").alias("progress")).select(F.col("window.start").alias("begin"), "status", "events", "progress")


def active(events: DataFrame, quiet: str = "10 seconds", task: str = "task_id", ts: str = "ts") -> DataFrame:
    """Sessions of tasks: a task that is silent for `quiet` has ended; `began`, `ended` and the number of its events."""
    own = events.withWatermark(ts, quiet) if events.isStreaming else events
    return own.groupBy(F.session_window(ts, quiet).alias("s"), task).agg(F.count("*").alias("events")).select(task, F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "events")


def live_at(events: DataFrame, now: Column | None = None, finished: tuple[str, ...] = FINISHED, seconds: int = LISTED_SECONDS) -> DataFrame:
    """`task_id, ts, status, progress` of the tasks that are listed at a time, by default that of the last event: those
    whose last event does not end them, and those that have ended less than `seconds` before. An ended task that goes on
    is a new one."""
    own = events.filter(F.col("ts") <= now) if now is not None else events
    last = latest(own)
    if now is None:
        last = last.join(F.broadcast(own.agg(F.max("ts").alias("_now"))))  # of one row
        now = F.col("_now")
    ended = F.col("status").isin(*finished) & (F.col("ts") + F.make_dt_interval(secs=F.lit(float(seconds))) <= now)
    return last.filter(~ended).select("task_id", "ts", "status", "progress")


class Expiring(StatefulProcessor):
    """Keeps each task's last event. A timer removes a task some seconds after the event that ended it; an event that
    comes before that clears the timer. Gives a row for each change: the task's state, and whether it is listed."""

    def __init__(self, finished: tuple[str, ...] = FINISHED, seconds: int = LISTED_SECONDS):
        self.finished, self.seconds = finished, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, event_id long, status string, progress double")

    def row(self, key, ts, status, progress, live) -> pd.DataFrame:
        return pd.DataFrame({"task_id": [key[0]], "ts": [ts], "status": [status], "progress": [progress], "live": [live]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.last.get() if self.last.exists() else None
        for part in rows:
            first = part.sort_values(["ts", "event_id"]).iloc[-1]
            found = (first["ts"].to_pydatetime(), int(first["event_id"]), first["status"], float(first["progress"]))
            if newest is None or found[:2] > (newest[0].replace(tzinfo=None), newest[1]):
                newest = found
        self.last.update(tuple(newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ts, _, status, progress = newest
        if status in self.finished:
            self.handle.registerTimer(int(pd.Timestamp(ts).tz_localize(None).timestamp() * 1000) + 1000 * self.seconds)
        yield self.row(key, ts, status, progress, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, _, status, progress = self.last.get()
        self.last.clear()
        yield self.row(key, ts, status, progress, False)

    def close(self) -> None:
        pass


def listed(events: DataFrame, late: str = "0 seconds", finished: tuple[str, ...] = FINISHED, seconds: int = LISTED_SECONDS) -> DataFrame:
    """`task_id, ts, status, progress, live` of a stream of events, in update mode: a row for each batch in which a task
    changes, and one with `live` false when it goes. The last row of a task says what `live_at` says for the watermark."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keyed = events.withWatermark("ts", late).select("task_id", "ts", "event_id", "status", F.col("progress").cast("double").alias("progress")).groupBy("task_id")
    kind = dict(events.dtypes)["task_id"]
    return keyed.transformWithStateInPandas(statefulProcessor=Expiring(finished, seconds), outputStructType=f"task_id {kind}, ts timestamp, status string, progress double, live boolean", outputMode="Update", timeMode="EventTime")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def upsert_into(path: str, order: str, task: str = "task_id"):
    """A `foreachBatch` function that keeps the latest state of each task in a Parquet folder, one version a batch. Of a
    task's rows in a batch the one with the largest `order` counts. A batch follows the newest version before it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [F.col(order), *(F.col(c) for c in batch.columns if c != order)]  # of equal ones the largest row
        batch = batch.groupBy(task).agg(F.max(F.struct(*columns)).alias("s")).select("s.*").select(*batch.columns)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        versions = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and int(n[1:]) < number]
        before = spark.read.parquet(f"{path}/v{max(versions)}") if versions else None
        rows = batch if before is None else before.join(batch.select(task), task, "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(f"{path}/v{number}")

    return write


def snapshot(locks: DataFrame, datasets: DataFrame, tasks: DataFrame) -> DataFrame:
    """`n_locks, n_datasets, n_tasks, status`: `busy` while an operation is locked or a task runs, else `ready`."""
    out = locks.agg(F.count("*").alias("n_locks")).join(datasets.agg(F.count("*").alias("n_datasets"))).join(tasks.agg(F.count_if(F.col("status") == "running").alias("n_tasks")))  # of one row each
    return out.withColumn("status", F.when((F.col("n_locks") > 0) | (F.col("n_tasks") > 0), "busy").otherwise("ready"))
