"""Registered streaming queries, drained over the events table, with the same results in DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.market import market_scope
from hirelake.operators.activity import ZONE
from hirelake.plans.catalog import SCOPE
from hirelake.plans.fixtures import LOCATIONS, RUNS, SITES, pick, view
from hirelake.streaming import jobs

SEEN = "SELECT user_id % 20 AS site_id, concat(event_type, '-', regexp_extract(props, '([0-9]+)', 1)) AS external_job_id, ts FROM events"


def _stream(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # A pattern that only this name fits: a stream reads a single file only by a pattern.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return spark.sql(re.sub(r"\bFROM events\b", "FROM {events}", sql), events=events)


def stream_daily_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain(jobs.daily_runs(_stream(spark, sf_dir, RUNS))).drop("batch")


def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain(jobs.trailing_health(_stream(spark, sf_dir, RUNS), view(spark, sf_dir, SITES, "pages"))).drop("batch")


def stream_unique_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain(jobs.unique_postings(_stream(spark, sf_dir, SEEN))).select("site_id", "external_job_id")


def stream_stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.drain(jobs.stale_runs(_stream(spark, sf_dir, RUNS))).drop("batch")


def stream_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.drain(jobs.crawl_backoff(_stream(spark, sf_dir, RUNS)), "update")
    return rows.groupBy("site_id").agg(*(F.max_by(c, "batch").alias(c) for c in ("consecutive_failures", "last_run_at", "next_crawl_at")))


#: Snapshots of eight days; in each, a third of the sites isn't crawled.
ARRIVED = f"""
SELECT * FROM (SELECT user_id % 20 AS site_id, concat(event_type, '-', regexp_extract(props, '([0-9]+)', 1), '-', CAST(user_id % 7 AS varchar(9))) AS external_job_id, {pick(LOCATIONS, 'event_id')} AS location, ts, CAST(floor((day(ts) - 1) / 8.0) AS integer) AS k FROM events WHERE value < 60) e
WHERE (site_id + k) % 3 <> 0"""


def stream_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, ARRIVED, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("market_scope", market_scope(F.col("location")))
    none = spark.createDataFrame([], "site_id long, external_job_id string, market_scope string, active boolean, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp")
    arrivals = [rows.where(F.col("k") == k).select("site_id", "external_job_id", "market_scope", "ts") for k in range(4)]
    return jobs.apply_arrivals(arrivals, none)


QUERIES = {f.__name__: f for f in (stream_daily_runs, stream_health, stream_unique_postings, stream_stale_runs, stream_backoff, stream_snapshots)}

_SUMS = "count(*) AS runs, count(*) FILTER (status = 'succeeded') AS successes, count(*) FILTER (status = 'failed') AS failures"
_LOCAL = f"timezone('{ZONE}', timezone('UTC', CAST(started_at AS timestamp)))"
ORACLES = {
    "stream_daily_runs": f"""
WITH runs AS (SELECT *, {_LOCAL} AS local FROM ({RUNS})), g AS (SELECT CAST(local AS date) AS activity_date, {_SUMS} FROM runs GROUP BY 1)
SELECT * FROM g WHERE activity_date + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(local)) - INTERVAL 1 DAY FROM runs)""",
    "stream_health": f"""
WITH runs AS ({RUNS}), rows AS (SELECT runs.*, source_type, CAST(CAST(started_at AS date) + CAST(k AS integer) AS date) AS day FROM runs JOIN ({SITES}) s USING (site_id), range(1, 8) r(k)),
g AS (SELECT day, source_type, {_SUMS} FROM rows GROUP BY 1, 2)
SELECT * FROM g WHERE day <= (SELECT date_trunc('millisecond', max(started_at)) - INTERVAL 1 DAY FROM rows)""",
    "stream_snapshots": f"""
WITH s AS (SELECT *, {SCOPE} AS scope FROM ({ARRIVED})), times AS (SELECT k, max(ts) AS as_of FROM s GROUP BY k), crawled AS (SELECT DISTINCT site_id, k FROM s),
seen AS (SELECT site_id, external_job_id, min(k) AS a, max(k) AS b FROM s WHERE scope = 'US' GROUP BY 1, 2),
x AS (SELECT seen.*, (SELECT min(c.k) FROM crawled c WHERE c.site_id = seen.site_id AND c.k > seen.b) AS gone FROM seen)
SELECT site_id, external_job_id, 'US' AS market_scope, gone IS NULL AS active, f.as_of AS first_seen_at, l.as_of AS last_seen_at, c.as_of AS closed_at
FROM x JOIN times f ON f.k = a JOIN times l ON l.k = b LEFT JOIN times c ON c.k = gone""",
    "stream_unique_postings": f"SELECT DISTINCT site_id, external_job_id FROM ({SEEN})",
    "stream_stale_runs": f"""
WITH runs AS ({RUNS}) SELECT run_id, started_at, 'stale_timeout' AS error_code FROM runs
WHERE status = 'running' AND date_trunc('millisecond', started_at) + INTERVAL 60 MINUTE < (SELECT date_trunc('millisecond', max(started_at)) - INTERVAL 1 DAY FROM runs)""",
    "stream_backoff": f"""
WITH runs AS (SELECT * FROM ({RUNS}) WHERE status <> 'running'), wins AS (SELECT site_id, max(started_at) FILTER (status = 'succeeded') AS won FROM runs GROUP BY 1),
g AS (SELECT site_id, count(*) FILTER (status = 'failed' AND (won IS NULL OR started_at >= won)) AS consecutive_failures, max(started_at) AS last_run_at FROM runs JOIN wins USING (site_id) GROUP BY 1)
SELECT *, last_run_at + to_hours(CAST(CASE WHEN consecutive_failures = 0 THEN 168 ELSE least(24, pow(2, least(consecutive_failures - 1, 10))) END AS BIGINT)) AS next_crawl_at FROM g""",
}
