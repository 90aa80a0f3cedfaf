"""Health of crawl runs and of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelake.functions.titles import failure_reason


def adapter_health(runs: DataFrame, sites: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """By source type, the runs of the days before ``as_of``; the last run counts at any age. Requests and mean latency if runs have them."""
    recent = F.col("started_at") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {days} DAYS")
    rows = runs.join(sites.select("site_id", "source_type"), "site_id")
    g = rows.groupBy("source_type").agg(
        F.count_if(recent).alias("runs"), F.count_if(recent & (F.col("status") == "succeeded")).alias("successes"), F.count_if(recent & (F.col("status") == "failed")).alias("failures"),
        F.coalesce(F.sum(F.when(recent, F.col("parsed_job_count"))), F.lit(0)).cast("long").alias("parsed_jobs"), F.max("started_at").alias("last_run_at"),
    )
    rate = F.round(F.try_divide(F.col("successes").cast("double"), F.col("runs")), 4)
    if {"requests_count", "latency_ms"} <= {*runs.columns}:
        more = rows.where(recent).groupBy("source_type").agg(F.sum("requests_count").alias("requests"), F.round(F.avg("latency_ms")).alias("avg_latency_ms"))
        g = g.join(more, "source_type", "left").na.fill(0, ["requests"])
    return g.withColumn("success_rate", rate)


def failure_breakdown(sites: DataFrame) -> DataFrame:
    """Sites by source type and reason of their last error, with the share of all."""
    counted = sites.groupBy("source_type", failure_reason(F.col("last_error")).alias("failure_reason")).agg(F.count("*").alias("failed_sites"))
    # Some dozens of groups: the window runs over counts, not over sites.
    everything = F.sum("failed_sites").over(Window.partitionBy())
    return counted.withColumn("pct_all_failed", F.round(F.col("failed_sites") * 100.0 / everything, 2).cast("double"))
