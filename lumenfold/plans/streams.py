"""Streaming jobs on a batch of the same columns; the tests run them as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.plans.registry import load, query
from lumenfold.streaming import jobs


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    found = jobs.windowed_counts(load(spark, sf_dir, "events"))
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", "total")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id AS "user", min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    found = jobs.sessions(load(spark, sf_dir, "events"))
    return found.select("user", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
