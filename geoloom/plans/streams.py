"""Streaming queries, drained and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.fixtures import TABLES, Tables, values_sql
from geoloom.registry import query
from geoloom.streaming import jobs as J


def events(t: Tables):
    return J.event_stream(t.spark, f"{t.folder}/events*.parquet")


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("W1", "ingest_stream", f"SELECT name || '.parquet' AS name, 'parquet' AS format, 'ok' AS status, true AS has_size FROM {values_sql([(x,) for x in TABLES])} AS f(name)")
def ingest_stream(t: Tables):
    return J.ingest_stream(t.spark, t.folder, "*.parquet").select("name", "format", "status", (F.col("size") > 0).alias("has_size"))


@query("W2", "dedupe_stream", "SELECT DISTINCT job_id FROM fx_outcome")
def dedupe_stream(t: Tables):
    return J.run_available(J.dedupe_stream(events(t)).select("job_id"), "dedupe")


_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@query("W3", "progress_stream", f"""
WITH w AS (SELECT job_id, time_bucket(INTERVAL 30 SECOND, ts) AS "start", count(*) AS done, count(*) FILTER (WHERE NOT ok) AS failed FROM fx_outcome GROUP BY 1, 2)
SELECT job_id, strftime("start", '%Y-%m-%d %H:%M:%S') AS "start", strftime("start" + INTERVAL 30 SECOND, '%Y-%m-%d %H:%M:%S') AS "end", done, failed
FROM w WHERE "start" + INTERVAL 30 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def progress_stream(t: Tables):
    got = J.run_available(J.progress_stream(events(t)), "progress")
    return got.select("job_id", stamp("start"), stamp("end"), "done", "failed")


@query("W4", "failure_rate_stream", """
WITH s AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * i AS "start", ok FROM fx_outcome, range(6) v(i)),
w AS (SELECT "start", count(*) AS n, count(*) FILTER (WHERE NOT ok) AS failed FROM s GROUP BY 1)
SELECT strftime("start", '%Y-%m-%d %H:%M:%S') AS "start", strftime("start" + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", n, failed FROM w
WHERE failed >= 4 AND failed / n > 0.3 AND "start" + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def failure_rate_stream(t: Tables):
    got = J.run_available(J.failure_rate_stream(events(t), 4, 0.3), "rate")
    return got.select(stamp("start"), stamp("end"), "n", "failed")


@query("W5", "streak_stream", """
WITH e AS (SELECT * FROM fx_outcome WHERE epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) * 1000),
a AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS island FROM e),
b AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY job_id, island ORDER BY ts, event_id) AS pos FROM a)
SELECT job_id, event_id FROM b WHERE NOT ok AND pos = 3""")
def streak_stream(t: Tables):
    return J.run_available(J.streak_stream(events(t), 3), "streak")


@query("W6", "usage_sessions", """
WITH a AS (SELECT job_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM fx_outcome WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
b AS (SELECT job_id, ts, sum(brk) OVER (PARTITION BY job_id ORDER BY ts) AS s FROM a),
w AS (SELECT job_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events FROM b GROUP BY job_id, s)
SELECT job_id, strftime("start", '%Y-%m-%d %H:%M:%S') AS "start", strftime("end", '%Y-%m-%d %H:%M:%S') AS "end", n_events FROM w
WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def usage_sessions(t: Tables):
    got = J.run_available(J.usage_sessions(events(t)), "sessions")
    return got.select("job_id", stamp("start"), stamp("end"), "n_events")


@query("W7", "expiry_stream", """
SELECT job_id AS artifact_id, max(epoch_us(ts) // 1000) + 86400000 AS expired_ms FROM fx_outcome GROUP BY 1
HAVING max(epoch_us(ts) // 1000) + 86400000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)""")
def expiry_stream(t: Tables):
    art = events(t).select("ts", F.col("job_id").alias("artifact_id"))
    return J.run_available(J.expiry_stream(art), "expiry")
