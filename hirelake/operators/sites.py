"""Career sites: selection, schedule, alerts and review precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Source types that are scored as structured, trusted at rank 1, reviewed at rank 1, and crawled.
STRUCTURED = ("greenhouse", "workday", "lever", "ashby", "smartrecruiters", "oracle_cloud", "apple_jobs")
TRUSTED = STRUCTURED[:5]
REVIEWED = STRUCTURED[5:]
CRAWLED = (
    "amazon_jobs", "apple_jobs", "cognizant_jobs", "eightfold", "generic_html", "google_jobs", "greenhouse", "icims", "oracle_cloud",
    "workday", "lever", "ashby", "smartrecruiters", "workable", "jobvite", "paylocity", "rippling", "uber_jobs",
)
#: Hours between crawls of each tier.
INTERVALS = {"P0": 24, "P1": 72, "P2": 168, "P3": 336}


def site_selection_scores(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """Sites of enabled targets with an additive score and a decision."""
    verified = sites.where("verification_status = 'verified'").select("consolidation_key").distinct().withColumn("has_verified", F.lit(True))
    rows = sites.join(targets.where("enabled").select("consolidation_key"), "consolidation_key").join(verified, "consolidation_key", "left")
    kind, status, rank = F.col("source_type"), F.col("verification_status"), F.col("candidate_rank")
    points = (
        (status == "verified", 100), (kind.isin(*STRUCTURED), 45), (kind == "icims", 20), (rank == 1, 25), (rank == 2, 10), (rank == 3, 5),
        ((F.col("target_country_code") == "US") & (F.col("scope_method") != "unknown"), 20), (F.col("last_success_at").isNotNull(), 30), (F.col("crawl_status") == "succeeded", 15),
        (status == "rejected", -200), (F.col("consecutive_failures") >= 3, -40), (kind == "generic_html", -30),
    )
    decision = (
        F.when(status == "verified", "selected_verified")
        .when(status == "rejected", "rejected")
        .when(kind.isin(*TRUSTED) & (rank == 1) & F.col("has_verified").isNull(), "auto_trust_rank1_structured_ats")
        .when(kind.isin(*REVIEWED) & (rank == 1), "supported_but_needs_specific_review")
        .when(kind == "icims", "needs_icims_us_scope_review")
        .when(kind == "generic_html", "manual_or_later_generic_html")
        .otherwise("review_candidate")
    )
    score = sum((F.when(c, F.lit(p)).otherwise(F.lit(0)) for c, p in points), F.lit(0))
    return rows.select("site_id", "consolidation_key", "source_type", "candidate_rank", score.alias("selection_score"), decision.alias("selection_decision"))


def schedule_queue(sites: DataFrame, targets: DataFrame, as_of: str) -> DataFrame:
    """The verified sites of enabled, tiered targets that may be crawled, whether they are due, and their last crawl if ``sites`` has it."""
    ready = sites.where((F.col("verification_status") == "verified") & F.col("crawl_enabled") & (F.col("target_country_code") == "US") & (F.col("scope_method") != "unknown") & F.col("source_type").isin(*CRAWLED))
    wanted = targets.where(F.col("enabled") & F.col("priority_tier").isin(*INTERVALS)).select("consolidation_key", "canonical_name", "priority_tier", "priority_score")
    hours = F.coalesce(*(F.when(F.col("priority_tier") == t, F.lit(h)) for t, h in INTERVALS.items()))
    now = F.lit(as_of).cast("timestamp")
    return ready.join(wanted, "consolidation_key").select(
        "site_id", "consolidation_key", "canonical_name", "priority_tier", "priority_score", "source_type", hours.alias("recommended_interval_hours"),
        "next_crawl_at", (F.coalesce("next_crawl_at", now) <= now).alias("is_due"), "consecutive_failures", "crawl_status", *(c for c in sites.columns if c == "last_crawled_at"),
    )


def due_sites(queue: DataFrame, limit: int) -> DataFrame:
    """The first due sites by tier, score and id; the limit is the batch's size."""
    return queue.where("is_due").orderBy("priority_tier", F.col("priority_score").desc_nulls_last(), "site_id").limit(limit)


def site_alerts(queue: DataFrame, postings: DataFrame, as_of: str) -> DataFrame:
    """Sites of the queue that failed three times, have no active job after a success, or are a day late."""
    active = postings.where("active").select("site_id").distinct().withColumn("has_jobs", F.lit(True))
    late = F.col("next_crawl_at") < F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 24 HOURS")
    kind = F.when(F.col("consecutive_failures") >= 3, "repeated_failure").when((F.col("crawl_status") == "succeeded") & F.col("has_jobs").isNull(), "zero_active_jobs").when(late, "overdue")
    rows = queue.join(active, "site_id", "left").withColumn("alert_type", kind).where("alert_type IS NOT NULL")
    return rows.select("site_id", "consolidation_key", "priority_tier", "source_type", "alert_type", "consecutive_failures")


def review_precision(sites: DataFrame) -> DataFrame:
    """Verified among reviewed candidates by source type and rank; null where none was reviewed."""
    counted = sites.groupBy("source_type", "candidate_rank").agg(
        F.count("reviewed_at").alias("reviewed_candidates"), F.count_if(F.col("verification_status") == "verified").alias("verified_candidates"), F.count_if(F.col("verification_status") == "rejected").alias("rejected_candidates")
    )
    return counted.withColumn("precision", F.round(F.try_divide(F.col("verified_candidates").cast("double"), F.col("reviewed_candidates")), 4))
