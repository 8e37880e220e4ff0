"""Structured Streaming: job states and request metrics from a stream of events."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TERMINAL = ("succeeded", "failed", "cancelled")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events as they arrive in a folder; ``ts`` gets a time zone, which watermarks need."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_metrics(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts and sums for each type and hour; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


class JobStates(StatefulProcessor):
    """The status and number of events of each job.

    A job that is over keeps its status whatever comes later; ``keep_ms`` after its last event, by the watermark, a timer
    drops its state, so the state holds jobs under way and those lately over.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, n = self.job.get() if self.job.exists() else (None, 0)
        over, first, last = status in TERMINAL, None, None
        for pdf in rows:
            n += len(pdf)
            ended = pdf[pdf["status"].isin(TERMINAL)]
            for part, pick in ((ended, min), (pdf, max)):
                if len(part):
                    found = pick(zip(part["ts"], part["event_id"], part["status"], strict=True))
                    if part is pdf:
                        last = found if last is None else max(last, found)
                    else:
                        first = found if first is None else min(first, found)
        status = status if over else (first or last)[2]
        self.job.update((status, n))
        if status in TERMINAL:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last[0].timestamp() * 1000) + self.keep_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n_events": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        return iter([])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, keep: str = "7 days", late: str = "1 hour") -> DataFrame:
    """(job_id, status, n_events) of jobs that changed; once a job is over, later events don't change it.

    events: (job_id, status, ts, event_id).  Events later than ``late`` are dropped, and the state of a job goes
    ``keep`` after it is over.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    named = events.withWatermark("ts", late).groupBy("job_id")
    return named.transformWithStateInPandas(JobStates(keep_ms), "job_id long, status string, n_events long", "Update", "EventTime")


def drain(stream: DataFrame, key: str) -> DataFrame:
    """Runs a stream of updates until its source is used up; the last row of each key.

    Each batch goes to a folder of its own, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="certlake-")
    path = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # states with timers need this store
    query = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    names = [c for c in rows.columns if c not in (key, "__batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "__batch").alias("v")).select(key, "v.*")
