"""Decisions that change several tables: each is made once, kept, and applied to all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators.discovery import finalize_discovery
from hirelake.sources.shared import kept
from hirelake.sources.tables import insert_absent, merge_upsert

#: What a stale run's rows say.
STALE_CODE = "stale_timeout"
STALE_SITE = "stale_timeout: previous crawl run was still running after 60 minutes"
RETRY_HOURS = 6
FOUND = ("normalized_domain", "source_type", "candidate_rank", "candidate_score", "search_query", "evidence_title")


def _blank(c: str):
    return F.nullif(F.col(c), F.lit(""))


def finalize_runs(results: DataFrame, found: DataFrame, targets: DataFrame, runs: DataFrame, attempts: DataFrame, sites: DataFrame, cohort: str, source: str, as_of: str) -> dict[str, DataFrame]:
    """``runs``, ``attempts``, ``sites`` and ``targets`` after the staged searches of one or more discovery runs.

    results: run_id, consolidation_key, canonical_name, search_query, search_succeeded, candidate_count,
    error_message, a row for each run and company; found: the candidates of each run. A run that is in the
    ledger keeps its figures and is completed; attempts are replaced by run and company, candidates by
    company and url, of which reviewed columns stay. Of several runs of a company the last run id counts.
    """
    now = F.lit(as_of).cast("timestamp")
    staged = kept(results.withColumn("error_message", _blank("error_message")), "discovery-results")
    ledger = staged.groupBy("run_id").agg(
        F.lit(cohort).alias("cohort"), F.count("*").alias("target_count"), F.count("*").alias("search_count"), F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("candidate_count"),
        F.count_if(~F.col("search_succeeded")).alias("error_count"), F.count("*").alias("estimated_credits"), F.lit("running").alias("status"), now.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"),
    )
    ended = staged.select("run_id").distinct().withColumn("ended", F.lit(True))
    known = insert_absent(runs, ledger, ["run_id"]).join(ended, "run_id", "left")
    done = F.col("ended").isNotNull()
    runs_ = known.withColumns({"status": F.when(done, "completed").otherwise(F.col("status")), "finished_at": F.when(done, now).otherwise(F.col("finished_at"))}).select(*runs.columns)
    tiers = targets.select("consolidation_key", "priority_tier", "priority_score")
    tried = staged.join(tiers, "consolidation_key", "left").select(*(F.lit(cohort).alias(c) if c == "cohort" else now.alias(c) if c == "attempted_at" else F.col(c) for c in attempts.columns))
    candidates = found.groupBy("consolidation_key", "site_url").agg(F.max_by(F.struct(*FOUND), F.struct("run_id", -F.col("candidate_rank"))).alias("f")).select(
        "consolidation_key", "site_url", *(_blank(f"f.{c}").alias(c) if c == "evidence_title" else F.col(f"f.{c}") for c in FOUND),
        F.lit(source).alias("discovery_source"), F.lit("unverified").alias("verification_status"), F.lit(False).alias("crawl_enabled"), F.lit("pending").alias("crawl_status"), now.alias("last_discovered_at"),
    )
    stays = dict.fromkeys(("discovery_source", "verification_status", "crawl_enabled", "crawl_status"), "keep")
    last = staged.groupBy("consolidation_key").agg(F.max_by(F.struct("search_succeeded", "candidate_count"), "run_id").alias("r")).select("consolidation_key", "r.*")
    return {
        "runs": runs_, "attempts": merge_upsert(attempts, tried, ["run_id", "consolidation_key"]),
        "sites": merge_upsert(sites, candidates, ["consolidation_key", "site_url"], stays), "targets": finalize_discovery(targets, last, as_of),
    }


def fail_stale(runs: DataFrame, batch_targets: DataFrame, batches: DataFrame, sites: DataFrame, as_of: str, minutes: int = 60) -> dict[str, DataFrame]:
    """``runs``, ``batch_targets``, ``batches`` and ``sites`` after runs that have been running too long have failed.

    A running batch with such a run fails with at least one failed target; a site counts one failure more,
    however many of its runs are stale, and waits six hours.
    """
    now = F.lit(as_of).cast("timestamp")
    late = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    stale = kept(runs.where(late).select("run_id", "batch_id", "site_id"), "stale-runs")
    late = F.coalesce(late, F.lit(False))
    runs_ = runs.withColumns({"finished_at": F.when(late, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")), "error_code": F.when(late, STALE_CODE).otherwise(F.col("error_code")), "status": F.when(late, "failed").otherwise(F.col("status"))})

    def marked(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(stale.select(*keys).distinct().withColumn("hit", F.lit(True)), keys, "left")

    hit = F.col("hit").isNotNull()
    targets_ = marked(batch_targets, ["batch_id", "site_id"]).withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))
    fails = hit & (F.col("status") == "running")
    batches_ = marked(batches, ["batch_id"]).withColumns({
        "failed_target_count": F.when(fails, F.greatest("failed_target_count", F.lit(1))).otherwise(F.col("failed_target_count")), "finished_at": F.when(fails, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")),
        "status": F.when(fails, "failed").otherwise(F.col("status")),
    })
    sites_ = marked(sites, ["site_id"]).withColumns({
        "crawl_status": F.when(hit, "failed").otherwise(F.col("crawl_status")), "consecutive_failures": F.col("consecutive_failures") + hit.cast("int"), "last_error": F.when(hit, STALE_SITE).otherwise(F.col("last_error")),
        "next_crawl_at": F.when(hit, now + F.expr(f"INTERVAL {RETRY_HOURS} HOURS")).otherwise(F.col("next_crawl_at")),
    })
    return {"runs": runs_.select(*runs.columns), "batch_targets": targets_.select(*batch_targets.columns), "batches": batches_.select(*batches.columns), "sites": sites_.select(*sites.columns)}


def refresh_run_counts(runs: DataFrame, batches: DataFrame, postings: DataFrame, labels: DataFrame, as_of: str, hours: int = 12) -> dict[str, DataFrame]:
    """``runs`` and ``batches`` after the target and review jobs of recent runs are counted anew.

    Counted are the active US postings with a label that a run saw last, of runs that have succeeded within
    the hours. A batch with such a run takes the counts of its last run.
    """
    recent = (F.col("status") == "succeeded") & (F.col("finished_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
    seen = postings.where("active AND market_scope = 'US'").select(F.col("last_run_id").alias("run_id"), "normalized_title").join(labels.select("normalized_title", F.col("classification_status").alias("state")), "normalized_title")
    counts = seen.groupBy("run_id").agg(F.count_if(F.col("state") == "target").alias("targets"), F.count_if(F.col("state") == "review").alias("reviews"))
    counted = kept(counts.join(runs.where(recent).select("run_id", "batch_id"), "run_id"), "run-counts")
    hit = F.col("targets").isNotNull()
    fresh = runs.join(counted.drop("batch_id"), "run_id", "left").withColumns({"target_job_count": F.when(hit, F.col("targets")).otherwise(F.col("target_job_count")), "review_job_count": F.when(hit, F.col("reviews")).otherwise(F.col("review_job_count"))}).select(*runs.columns)
    last = fresh.join(counted.select("batch_id").distinct(), "batch_id", "left_semi").groupBy("batch_id").agg(F.max_by(F.struct("target_job_count", "review_job_count"), "run_id").alias("last"))
    rows = batches.join(last, "batch_id", "left")
    found = F.col("last").isNotNull()
    return {"runs": fresh, "batches": rows.withColumns({c: F.when(found, F.col(f"last.{c}")).otherwise(F.col(c)) for c in ("target_job_count", "review_job_count")}).select(*batches.columns)}


def resolve_failed_sites(sites: DataFrame, targets: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """``sites`` and ``targets`` after failed crawls: verified, enabled sites of enabled, tiered companies whose last crawl failed.

    A 404 that persists rejects a site of the first tier's companies, another 404 sends it back to review,
    and what may pass is tried again at once. A company of a rejected site without another open one is
    for review.
    """
    now, error = F.lit(as_of).cast("timestamp"), F.lower(F.coalesce("last_error", F.lit("")))
    wanted = targets.where(F.col("enabled") & F.col("priority_tier").isin("P0", "P1", "P2", "P3")).select("consolidation_key", F.col("priority_tier").alias("tier"))
    failed = sites.where((F.col("verification_status") == "verified") & F.col("crawl_enabled") & (F.col("crawl_status") == "failed")).join(wanted, "consolidation_key")
    missing, passing = error.contains("404"), error.rlike("timeout|timed out|403|forbidden")
    action = F.when(missing & (F.col("tier") == "P1") & (F.col("consecutive_failures") >= 2), "reject").when(missing, "demote").when(passing, "retry")
    decided = kept(failed.select("site_id", "consolidation_key", action.alias("action")).where("action IS NOT NULL"), "failed-sites")
    rows = sites.join(decided.select("site_id", "action"), "site_id", "left")
    by = lambda **changes: F.coalesce(*(F.when(F.col("action") == a, v) for a, v in changes.items()))
    out = F.coalesce(F.col("action").isin("reject", "demote"), F.lit(False))
    sites_ = rows.withColumns({
        "verification_status": F.coalesce(by(reject="rejected", demote="unverified"), "verification_status"), "crawl_status": F.coalesce(by(reject="paused", demote="pending", retry="pending"), "crawl_status"),
        "crawl_enabled": F.col("crawl_enabled") & ~out, "next_crawl_at": F.when(out, F.lit(None)).when(F.col("action") == "retry", now).otherwise(F.col("next_crawl_at")),
        "reviewed_by": F.when(F.col("action") == "demote", "system:failed-site-cleanup").otherwise(F.col("reviewed_by")),
    }).select(*sites.columns)
    open_ = sites_.where((F.col("verification_status") == "verified") & F.col("crawl_enabled")).select("consolidation_key").distinct()
    again = decided.where("action = 'reject'").select("consolidation_key").distinct().join(open_, "consolidation_key", "left_anti").withColumn("again", F.lit(True))
    hit = F.col("again").isNotNull()
    targets_ = targets.join(again, "consolidation_key", "left").withColumns({"discovery_status": F.when(hit, "review_pending").otherwise(F.col("discovery_status")), "next_discovery_at": F.when(~hit, F.col("next_discovery_at"))})
    return {"sites": sites_, "targets": targets_.select(*targets.columns)}
