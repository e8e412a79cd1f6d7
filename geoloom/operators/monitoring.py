"""Outcomes of many small jobs: progress, streaks and failure rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.scale import running


def _ordered(outcomes: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Outcomes with an hour bucket, so that a busy job is worked on hour by hour."""
    return (outcomes.withColumn("_hour", F.date_trunc("hour", "ts")), [F.asc("ts"), F.asc("event_id")])


def _first_trip(marked: DataFrame) -> DataFrame:
    first = F.min(F.when(F.col("_trip"), F.struct("ts", "event_id")))
    return (marked.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_events"), first.alias("_f"))
            .select("job_id", "n_events", F.col("_f").isNotNull().alias("tripped"), F.col("_f.event_id").alias("trip_event_id")))


def failure_streaks(outcomes: DataFrame, n: int = 3) -> DataFrame:
    """G3. The first event per job that makes ``n`` failures in a row; a success starts over; 0 disables."""
    rows, order = _ordered(outcomes)
    fails = running(rows, ["job_id"], "_hour", order, "sum", {"_fails": (~F.col("ok")).cast("int")})
    # failures so far at the last success; failures only grow, so a running maximum finds it
    last = running(fails, ["job_id"], "_hour", order, "max", {"_base": F.when(F.col("ok"), F.col("_fails"))})
    streak = F.col("_fails") - F.coalesce("_base", F.lit(0))
    trip = (streak >= n) & ~F.col("ok") if n > 0 else F.lit(False)
    return _first_trip(last.withColumn("_trip", trip))


def failure_rate_trip(outcomes: DataFrame, min_fails: int = 5, rate: float = 0.5) -> DataFrame:
    """G4. The first event per job with enough failures and a failure rate above the limit; 0 disables."""
    rows, order = _ordered(outcomes)
    run = running(rows, ["job_id"], "_hour", order, "sum",
                  {"_fails": (~F.col("ok")).cast("int"), "_all": F.lit(1)})
    on = min_fails > 0 and rate > 0
    trip = (F.col("_fails") >= min_fails) & (F.col("_fails") / F.col("_all") > rate) if on else F.lit(False)
    return _first_trip(run.withColumn("_trip", trip))


def job_progress(outcomes: DataFrame, jobs: DataFrame, concurrency: int = 2) -> DataFrame:
    """D24. Chunks done, failed and in all, elapsed time and time left.

    The time left is null before the first chunk and when none is left.
    """
    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    seen = outcomes.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("done"), F.count_if(~F.col("ok")).alias("failed"), F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    out = jobs.join(seen, "job_id", "left").withColumn("done", F.coalesce("done", F.lit(0)).cast("bigint"))
    elapsed = F.coalesce(F.floor((micros("_b") - micros("_a")) / 1000), F.lit(0))
    left = F.col("total") - F.col("done")
    eta = F.when((F.col("done") > 0) & (left > 0), F.floor(left * (elapsed / F.col("done")) / concurrency))
    return out.select("job_id", "total", "done", F.coalesce("failed", F.lit(0)).cast("bigint").alias("failed"),
                      elapsed.alias("elapsed_ms"), eta.alias("remaining_ms"))
