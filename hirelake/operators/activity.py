"""Retention of closed postings, stale runs, and activity by local day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.postings import KEYS

ZONE = "America/Chicago"


def local_date(at: Column, zone: str = ZONE) -> Column:
    """The date at a UTC time in the zone."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def posting_is_current_year(text: Column, ref_date: Column) -> Column:
    """Whether the text's year is the date's: of 13 digits in ms, of 10 in s, else the first 20dd; true without one."""
    value = F.trim(F.coalesce(text, F.lit("")))
    found = F.regexp_extract(value, r"(^|[^0-9])(20[0-9]{2})([^0-9]|$)", 2)
    year = (
        F.when(value.rlike("^[0-9]{13}$"), F.year(F.timestamp_millis(value.try_cast("long"))))
        .when(value.rlike("^[0-9]{10}$"), F.year(F.timestamp_seconds(value.try_cast("long"))))
        .otherwise(F.nullif(found, F.lit("")).try_cast("int"))
    )
    return F.coalesce(year == F.year(ref_date), F.lit(True))


def _status(labels: DataFrame, postings: DataFrame) -> DataFrame:
    known = labels.select("normalized_title", "classification_status")
    return postings.join(known, "normalized_title", "left").withColumn("role_status", F.coalesce("classification_status", F.lit("review")))


def retention_candidates(postings: DataFrame, labels: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """Closed postings that may be deleted, with the reason; those with a user's action stay."""
    now = F.lit(as_of).cast("timestamp")
    closed = postings.where("NOT active AND closed_at IS NOT NULL").join(actions.select(*KEYS), KEYS, "left_anti")
    old, older = (F.col("closed_at") < now - F.expr(f"INTERVAL {d} DAYS") for d in (30, 180))
    reason = (
        F.when(~F.col("market_scope").eqNullSafe("US") & old, "closed_non_us_or_unknown_30d")
        .when((F.col("role_status") == "non_target") & old, "closed_non_target_30d")
        .when((F.col("role_status") == "review") & older, "closed_review_180d")
    )
    return _status(labels, closed).select(*KEYS, reason.alias("retention_reason")).where("retention_reason IS NOT NULL")


def prune(postings: DataFrame, candidates: DataFrame) -> DataFrame:
    return postings.join(candidates.select(*KEYS), KEYS, "left_anti")


def fail_stale_runs(runs: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    """Runs that are still running after the minutes become failed, with the error code of a timeout."""
    stale = (F.col("status") == "running") & (F.col("started_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return runs.withColumns({"error_code": F.when(stale, "stale_timeout"), "status": F.when(stale, "failed").otherwise(F.col("status"))})


def daily_activity(postings: DataFrame, labels: DataFrame, runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """New, closed and crawled by local day, for the days up to ``as_of``; days without any have zeros.

    New jobs are active US postings; closed ones are US postings of target titles. Counts are combined
    before they meet the calendar, so only days shuffle to it.
    """
    last = f"to_date(from_utc_timestamp(TIMESTAMP '{as_of}', '{ZONE}'))"
    calendar = postings.sparkSession.sql(f"SELECT explode(sequence(date_sub({last}, {days - 1}), {last})) AS activity_date")
    us = _status(labels, postings.where("market_scope = 'US'"))
    day = lambda c: local_date(F.col(c)).alias("activity_date")
    status = F.col("role_status")
    new = us.where("active").groupBy(day("first_seen_at")).agg(F.count("*").alias("new_jobs"), F.count_if(status == "target").alias("new_target_jobs"), F.count_if(status == "review").alias("new_review_jobs"))
    closed = us.where("closed_at IS NOT NULL AND role_status = 'target'").groupBy(day("closed_at")).agg(F.count("*").alias("closed_jobs"))
    crawled = runs.groupBy(day("started_at")).agg(F.count("*").alias("crawl_runs"), F.count_if(F.col("status") == "succeeded").alias("successful_runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"))
    return calendar.join(new, "activity_date", "left").join(closed, "activity_date", "left").join(crawled, "activity_date", "left").na.fill(0)
