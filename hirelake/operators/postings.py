"""Posting history against snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.titles import denies_sponsorship
from hirelake.sources.tables import insert_absent

KEYS = ["site_id", "external_job_id"]
#: Columns that a snapshot brings along; blank ones become null, but for those that every posting has.
DETAILS = ["title", "normalized_title", "location", "category", "job_url", "description_snippet", "posted_text", "employment_type"]
ALWAYS = ("title", "normalized_title", "job_url")


def admitted(stage: DataFrame) -> DataFrame:
    """The rows of a snapshot that are stored: of the US, and without a text that denies sponsorship."""
    return stage.where((F.col("market_scope") == "US") & ~denies_sponsorship(F.col("description_snippet")))


def register_titles(labels: DataFrame, stage: DataFrame) -> DataFrame:
    """``labels`` with the snapshot's new titles, for review."""
    new = stage.select("normalized_title").where("normalized_title IS NOT NULL").withColumn("classification_status", F.lit("review"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in labels.schema if f.name not in new.columns]
    return insert_absent(labels, new.select("*", *rest), ["normalized_title"])


def run_counts(stage: DataFrame, labels: DataFrame) -> DataFrame:
    """By site, the admitted jobs of a snapshot, and those with a target title and with one for review."""
    rows = stage.join(labels.select("normalized_title", "classification_status"), "normalized_title", "left")
    status = F.coalesce("classification_status", F.lit("review"))
    return rows.groupBy("site_id").agg(F.count("*").alias("admitted_jobs"), F.count_if(status == "target").alias("target_job_count"), F.count_if(status == "review").alias("review_job_count"))


def apply_snapshot(postings: DataFrame, stage: DataFrame, as_of: str, crawled: DataFrame | None = None) -> DataFrame:
    """The history after a snapshot, with ``change``: new, updated, reopened, closed or kept.

    Only US rows of the snapshot count. Active US postings of a crawled site that the snapshot lacks are
    closed; crawled (site_id) defaults to the snapshot's sites, and names those whose snapshot is empty.
    Rows join on site and job, so a large site is spread; a seen posting keeps its first_seen_at. A seen
    posting takes the snapshot's details, those of DETAILS that both tables have.
    """
    now = F.lit(as_of).cast("timestamp")
    details = [c for c in DETAILS if c in stage.columns and c in postings.columns]
    blank = lambda c: F.col(c) if c in ALWAYS else F.nullif(F.col(c), F.lit(""))
    seen = stage.where("market_scope = 'US'").dropDuplicates(KEYS).select(*KEYS, *(blank(c).alias(f"new_{c}") for c in details), F.lit(True).alias("seen"))
    sites = (crawled or stage).select("site_id").distinct().withColumn("crawled", F.lit(True))
    rows = postings.join(seen, KEYS, "full_outer").join(sites, "site_id", "left")
    known, present = F.col("first_seen_at").isNotNull(), F.col("seen").isNotNull()
    gone = ~present & F.col("active") & (F.col("market_scope") == "US") & F.col("crawled").isNotNull()
    change = F.when(present & ~known, "new").when(present & F.col("active"), "updated").when(present, "reopened").when(gone, "closed").otherwise("kept")
    newer: list[Column] = [F.when(present, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in details]
    return rows.select(
        *KEYS, *newer, F.when(present, F.lit("US")).otherwise(F.col("market_scope")).alias("market_scope"),
        F.when(present, F.lit(True)).when(gone, F.lit(False)).otherwise(F.col("active")).alias("active"), F.coalesce("first_seen_at", now).alias("first_seen_at"),
        F.when(present, now).otherwise(F.col("last_seen_at")).alias("last_seen_at"), F.when(present, F.lit(None)).when(gone, now).otherwise(F.col("closed_at")).alias("closed_at"), change.alias("change"),
    )


def snapshot_counts(applied: DataFrame) -> DataFrame:
    kinds = ("new", "updated", "reopened", "closed")
    return applied.groupBy("site_id").agg(*(F.count_if(F.col("change") == k).alias(f"{k}_jobs") for k in kinds))
