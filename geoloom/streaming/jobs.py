"""Streaming twins of the batch operators.

Each takes and returns a streaming DataFrame; ``run_available`` drains what is
there into a table of files, so a finished stream can be compared with the
batch answer. Windows still open behind the watermark are not part of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geoloom.operators.catalog import latest
from geoloom.sources.files import quarantine_mismatch, with_format, with_heads
from geoloom.sources.sinks import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Outcome events from parquet files as they arrive."""
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema).parquet(path)
            .select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job_id"),
                    "event_type", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency")))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Drain the stream into parquet under the shared folder and read it back."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(key, None)
    out = scratch_path(spark, name)
    # a query takes the store that is set when it starts; the session gets its own back
    spark.conf.set(key, ROCKS)
    try:
        q = (stream.writeStream.format("parquet").option("path", f"{out}/data")
             .option("checkpointLocation", f"{out}/progress").outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, own) if own else spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def ingest_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """W1. Uploads as they land: sniff, refuse or accept, keep the last state per file name.

    A batch is written under its number, so a batch that runs twice after a
    failure overwrites itself.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    # contents are not asked for: a batch reads the first bytes and the footers of its files
    listed = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
              .select("path", "length", "modificationTime"))
    log = scratch_path(spark, "registry")

    def upsert(batch: DataFrame, number: int) -> None:
        rows = quarantine_mismatch(with_format(with_heads(batch))).select(
            "name", "format", "size", "status", F.col("modificationTime").alias("uploaded_at"), F.lit("upsert").alias("op"))
        rows.write.mode("overwrite").parquet(f"{log}/data/version={number}")

    q = (listed.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{log}/progress")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return latest(spark.read.parquet(f"{log}/data"), "name", "uploaded_at").drop("version")


def dedupe_stream(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """W2. One run per job id within the watermark."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id"])


def progress_stream(outcomes: DataFrame, every: str = "30 seconds", delay: str = "10 minutes") -> DataFrame:
    """W3. Done and failed per heartbeat; rows later than the delay are dropped."""
    return (outcomes.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), "job_id")
            .agg(F.count(F.lit(1)).alias("done"), F.count_if(~F.col("ok")).alias("failed"))
            .select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "done", "failed"))


def failure_rate_stream(outcomes: DataFrame, min_fails: int = 5, rate: float = 0.5, span: str = "1 hour",
                        step: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """W4. Sliding windows in which enough outcomes, and more than the rate, failed."""
    return (outcomes.withWatermark("ts", delay).groupBy(F.window("ts", span, step).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"))
            .where((F.col("failed") >= min_fails) & (F.col("failed") / F.col("n") > rate))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "failed"))


def usage_sessions(outcomes: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """W6. Spells of use per job, ended by an idle gap."""
    return (outcomes.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "job_id")
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events"))


class _Streak(StatefulProcessor):
    """Counts failures in a row in event-time order, for the jobs of a bucket at once.

    Rows wait in state until the watermark passes them, as order inside and
    across batches is not given; what waits is bounded by the watermark delay.
    They wait packed, one piece a batch, and so do the streaks that run, as a
    call into the state per row or per job is what a bucket costs.
    """

    ROW = np.dtype([("job", "<i8"), ("ts", "<i8"), ("event_id", "<i8"), ("nameless", "?"), ("ok", "?")])
    RUN = np.dtype([("job", "<i8"), ("n", "<i8"), ("nameless", "?")])

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.streak = handle.getValueState("streak", "runs binary")

    def _advance(self, rows: np.ndarray, watermark: int) -> Iterator[pd.DataFrame]:
        """``rows``: all that the bucket holds back and all that came."""
        late = rows["ts"] > watermark * 1000
        ready, left = rows[~late], rows[late]
        if len(ready):
            yield from self._counted(ready)
        if len(left):
            self.waiting.put([(left.tobytes(),)])
            self._wake(left)
        else:
            self.waiting.clear()

    def _wake(self, left: np.ndarray) -> None:
        # the timer is at the next row, rounded up to a whole millisecond
        self.handle.registerTimer(int(left["ts"].min()) // 1000 + 1)

    def _counted(self, ready: np.ndarray) -> Iterator[pd.DataFrame]:
        """Hits among rows in order; the streaks in which the jobs end are kept."""
        held = np.frombuffer(self.streak.get()[0], self.RUN) if self.streak.exists() else np.empty(0, self.RUN)
        ready = ready[np.lexsort((ready["ok"], ready["event_id"], ready["ts"], ready["job"], ready["nameless"]))]
        at = np.arange(len(ready))
        new = np.r_[True, (ready["job"][1:] != ready["job"][:-1]) | (ready["nameless"][1:] != ready["nameless"][:-1])]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        before = pd.DataFrame({"job": ready["job"][first], "nameless": ready["nameless"][first]})
        runs = pd.DataFrame({c: held[c] for c in ("job", "nameless", "n")})
        carried = before.merge(runs, "left", ["job", "nameless"])["n"].fillna(0).to_numpy(np.int64)
        # a run begins behind the last success of its job, or as long ago as it had lasted before these rows
        start = np.where(ready["ok"], at + 1, np.where(new, at - carried[group], np.iinfo(np.int64).min))
        # what begins later wins within a job, and jobs follow one another
        jobs = pd.Series(start).groupby(group)
        length = np.where(ready["ok"], 0, at + 1 - jobs.cummax().to_numpy())
        last = np.r_[first[1:], len(ready)] - 1
        done = before.assign(n=length[last])
        runs = pd.concat([done, runs]).drop_duplicates(["job", "nameless"])
        runs = runs[runs["n"] > 0]
        keep = np.empty(len(runs), self.RUN)
        for c in ("job", "nameless", "n"):
            keep[c] = runs[c].to_numpy()
        self.streak.update((keep.tobytes(),))
        hits = ready[length == self.n]
        if len(hits):
            yield pd.DataFrame({"job_id": pd.array(hits["job"], "Int64"), "event_id": hits["event_id"].astype("int64")}).mask(
                pd.DataFrame({"job_id": hits["nameless"], "event_id": False}))

    def _held(self) -> list[np.ndarray]:
        return [np.frombuffer(r[0], self.ROW) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = []
        for pdf in rows:
            got = np.empty(len(pdf), self.ROW)
            got["ts"] = pdf["ts"].astype("datetime64[us]").astype("int64")
            for c in ("job", "event_id", "nameless", "ok"):
                got[c] = pdf[c]
            came.append(got)
        got, watermark = np.concatenate(came), timerValues.getCurrentWatermarkInMs()
        if (got["ts"] > watermark * 1000).all():
            # nothing to count yet: what waits stays as it is
            self.waiting.appendValue((got.tobytes(),))
            self._wake(got)
        else:
            yield from self._advance(np.concatenate([*self._held(), got]), watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        if held:
            yield from self._advance(np.concatenate(held), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def streak_stream(outcomes: DataFrame, n: int = 3, delay: str = "1 hour", buckets: int = 512) -> DataFrame:
    """W5. Each event that completes ``n`` failures in a row of its job.

    Jobs share a state row per bucket, so the calls into Python do not grow with the jobs.
    """
    rows = outcomes.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"), F.coalesce(F.col("job_id").cast("long"), F.lit(0)).alias("job"),
        F.col("job_id").isNull().alias("nameless"), "ts", "event_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        _Streak(n), outputStructType="job_id long, event_id long", outputMode="append", timeMode="eventTime")


class _Expiry(StatefulProcessor):
    """Emits an artifact when its age passes the limit; a new use starts the clock again."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0] if self.seen.exists() else 0
        for pdf in rows:
            last = max(last, int(pdf["ts"].astype("datetime64[ms]").astype("int64").max()))
        self.seen.update((last,))
        self.handle.registerTimer(last + self.ttl_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0] if self.seen.exists() else 0
        if last + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.seen.clear()
            yield pd.DataFrame({"artifact_id": [key[0]], "expired_ms": [last + self.ttl_ms]})

    def close(self) -> None:
        pass


def expiry_stream(artifacts: DataFrame, ttl_ms: int = 24 * 3600 * 1000, delay: str = "1 hour") -> DataFrame:
    """W7. Artifacts whose last use is older than the limit."""
    return (artifacts.withWatermark("ts", delay).groupBy("artifact_id")
            .transformWithStateInPandas(_Expiry(ttl_ms), outputStructType="artifact_id long, expired_ms long",
                                        outputMode="append", timeMode="eventTime"))
