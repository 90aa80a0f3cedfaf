"""The surface of open jobs, their mix, review queues, and what users do with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelake.functions.roles import role_family, role_stack
from hirelake.functions.titles import employment_bucket, is_overridden, location_bucket, matches_all_terms, review_priority_band, seniority_bucket
from hirelake.operators.activity import local_date, posting_is_current_year
from hirelake.operators.postings import KEYS
from hirelake.sources.tables import merge_upsert

#: The states that a user gives a job.
ACTIONS = ("saved", "apply_next", "referred", "applied", "dismissed")


def is_posting_us(ref_date: str) -> Column:
    """Of an active US posting whose text names no other year than the date's."""
    return F.col("active") & (F.col("market_scope") == "US") & posting_is_current_year(F.col("posted_text"), F.lit(ref_date).cast("date"))


def postings_us(postings: DataFrame, ref_date: str) -> DataFrame:
    return postings.where(is_posting_us(ref_date))


def dashboard_jobs(jobs: DataFrame, targets: DataFrame, labels: DataFrame, actions: DataFrame) -> DataFrame:
    """Open jobs of known companies with their role, and what users did about them."""
    forced = is_overridden(F.col("title"))
    rows = jobs.join(targets.select("consolidation_key", "canonical_name", "priority_tier"), "consolidation_key").join(labels.select("normalized_title", "classification_status", "canonical_role"), "normalized_title", "left").join(actions.select(*KEYS, "action_status"), KEYS, "left")
    return rows.select(
        *KEYS, "consolidation_key", "canonical_name", "priority_tier", "title", "normalized_title", "location", "employment_type", "first_seen_at",
        F.when(forced, "non_target").otherwise(F.coalesce("classification_status", F.lit("review"))).alias("role_status"),
        F.when(~forced, F.col("canonical_role")).alias("canonical_role"), F.coalesce("action_status", F.lit("new")).alias("application_status"),
    )


def with_buckets(jobs: DataFrame) -> DataFrame:
    """Jobs with their stack, family, level, kind of employment and place."""
    title, role, status = F.col("normalized_title"), F.col("canonical_role"), F.col("role_status")
    by_status = lambda value: F.when(status == "target", value).when(status == "review", "needs_review").otherwise("excluded_non_target")
    return jobs.withColumns({
        "role_stack": by_status(role_stack(title, role)), "role_family": by_status(role_family(title, role)), "seniority_bucket": seniority_bucket(title),
        "employment_bucket": employment_bucket(title, F.col("employment_type")), "location_bucket": location_bucket(F.col("location")),
    })


def search_jobs(jobs: DataFrame, query: str) -> DataFrame:
    """Jobs in whose title, company or place every word of the query occurs."""
    return jobs.where(matches_all_terms(F.concat_ws(" ", "title", "canonical_name", "location"), F.lit(query)))


def bucket_counts(jobs: DataFrame) -> DataFrame:
    return with_buckets(jobs).groupBy("role_stack", "role_family", "seniority_bucket", "employment_bucket", "location_bucket").agg(F.count("*").alias("jobs"))


def job_mix(jobs: DataFrame, now: str) -> DataFrame:
    """Open target jobs by track and by family, with their shares, those first seen today apart."""
    rows = jobs.where("role_status = 'target'")
    stack, family = role_stack(F.col("normalized_title"), F.col("canonical_role")), role_family(F.col("normalized_title"), F.col("canonical_role"), mix=True)
    track = F.when(stack == "stack_5_possible_target", F.concat(F.lit("track_family:"), family)).otherwise(stack)
    new = local_date(F.col("first_seen_at")) >= local_date(F.lit(now).cast("timestamp"))
    counted = rows.select(track.alias("track"), family.alias("family"), new.alias("new")).groupBy("track", "family").agg(F.count("*").alias("n"), F.count_if("new").alias("m"))
    segments = counted.select(F.explode(F.array(F.struct(F.lit("track").alias("dimension"), F.col("track").alias("segment_key")), F.struct(F.lit("role_family").alias("dimension"), F.col("family").alias("segment_key")))).alias("s"), "n", "m").select("s.*", "n", "m")
    g = segments.groupBy("dimension", "segment_key").agg(F.sum("n").alias("current_open_jobs"), F.sum("m").alias("new_today_jobs"))
    # The windows run over segments, not over jobs.
    whole = Window.partitionBy("dimension")
    share = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.sum(c).over(whole)), 1).cast("double")
    return g.withColumns({"current_pct": share("current_open_jobs"), "today_pct": share("new_today_jobs")})


def hiring_summary(jobs: DataFrame, text: str) -> DataFrame:
    """Open jobs of the companies whose name holds the text, by family and place."""
    rows = with_buckets(jobs.where(F.contains(F.lower("canonical_name"), F.lit(text.lower()))))
    return rows.groupBy("role_family", "location").agg(F.count("*").alias("jobs"))


def title_review_queue(candidates: DataFrame, examples: DataFrame) -> DataFrame:
    """Titles for review with a suggestion, examples of companies, and a band of priority."""
    rows = candidates.where("classification_status = 'review'").join(examples.select("normalized_title", "example_companies"), "normalized_title", "left")
    band = review_priority_band(F.col("active_posting_count"), F.col("company_count"))
    return rows.select("normalized_title", "active_posting_count", "company_count", "suggested_status", "suggestion_reason", "example_companies", band.alias("priority_band"))


def apply_actions(actions: DataFrame, decisions: DataFrame, as_of: str) -> DataFrame:
    """Users' actions after decisions (site, job, action_status): the latest of a job counts, unknown states are refused."""
    good = decisions.where(F.col("action_status").isin(*ACTIONS))
    latest = good.groupBy(*KEYS).agg(F.max_by("action_status", F.struct("decided_at", "action_status")).alias("action_status")).withColumn("updated_at", F.lit(as_of).cast("timestamp"))
    return merge_upsert(actions, latest.select(*actions.columns), KEYS)


def application_mix(jobs: DataFrame, tiers: tuple[str, ...] = ("P0", "P1", "P2", "P3")) -> DataFrame:
    """Open target jobs of the tiers by what users did about them (``new`` for nothing), with shares of all."""
    counted = jobs.where((F.col("role_status") == "target") & F.col("priority_tier").isin(*tiers)).groupBy("application_status").agg(F.count("*").alias("jobs"))
    # A handful of states meets in the window.
    return counted.withColumn("pct", F.round(100.0 * F.col("jobs").cast("double") / F.sum("jobs").over(Window.partitionBy()), 1))


def local_day_window(at: Column, day: str, zone: str) -> Column:
    """Whether a UTC time lies in the zone's day, as a half-open range that a scan can use."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.date_add(F.lit(day).cast("date"), 1).cast("timestamp"), zone)
    return (at >= start) & (at < end)
