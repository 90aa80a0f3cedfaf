"""Queues, samples and ranked reports on companies and titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TIERS = ("P0", "P1", "P2", "P3")
#: Places of each kind of company in the sample.
QUOTAS = {"chicago_and_linkedin": 10, "chicago": 15, "linkedin_top_employer": 10, "large_lca_sponsor": 10, "diverse_random": 5}


def tier_rank(tier: Column) -> Column:
    return F.coalesce(*(F.when(tier == t, F.lit(k)) for k, t in enumerate(TIERS)), F.lit(len(TIERS) - 1))


def learning_queue(candidates: DataFrame, suggestions: DataFrame, limit: int) -> DataFrame:
    """The titles for review that teach most: active postings, three for each company, and doubt.

    Of a title's suggestions the latest counts; without one the doubt is worth 25, else up to 50.
    """
    latest = suggestions.groupBy("normalized_title").agg(F.max_by("ml_confidence", F.struct("created_at", "suggestion_id")).alias("ml_confidence"))
    doubt = F.when(F.col("ml_confidence").isNull(), F.lit(25)).otherwise(F.round((1 - F.col("ml_confidence")) * 50, 0).cast("long"))
    rows = candidates.where("classification_status = 'review'").join(latest, "normalized_title", "left")
    rows = rows.withColumn("learning_priority_score", (F.col("active_posting_count") + F.col("company_count") * 3 + doubt).cast("long"))
    order = (F.desc("learning_priority_score"), F.desc("active_posting_count"), F.desc("company_count"), "normalized_title")
    return rows.orderBy(*order).limit(limit).select("normalized_title", "active_posting_count", "company_count", "learning_priority_score")


def sample_bucket() -> Column:
    chicago, linkedin = F.col("chicago_score") > 0, F.col("linkedin_top_employer_score") > 0
    return F.when(chicago & linkedin, "chicago_and_linkedin").when(chicago, "chicago").when(linkedin, "linkedin_top_employer").when(F.col("lca_count") >= 100, "large_lca_sponsor").otherwise("diverse_random")


def stratified_sample(eligible: DataFrame, day: str, limit: int) -> DataFrame:
    """The quota of each bucket by score, in hash order up to ``limit``; others fill what is left of it.

    Keys are unique. A bucket is ranked only as far as its quota, so no task sorts a whole bucket, and the
    fill takes the first rows only.
    """
    key = F.col("consolidation_key")
    rows = eligible.withColumn("sample_bucket", sample_bucket())
    order = Window.partitionBy("sample_bucket").orderBy(F.col("priority_score").desc_nulls_first(), F.md5(F.concat(key, F.lit(day))))
    quota = F.coalesce(*(F.when(F.col("sample_bucket") == b, F.lit(n)) for b, n in QUOTAS.items()))
    chosen = rows.withColumn("bucket_rank", F.row_number().over(order)).where(F.col("bucket_rank") <= max(QUOTAS.values())).where(F.col("bucket_rank") <= quota).drop("bucket_rank")
    # Fifty keys at most: the sum of the quotas.
    others = rows.join(F.broadcast(chosen.select("consolidation_key")), "consolidation_key", "left_anti")
    chosen = chosen.withColumns({"filled": F.lit(0), "place": F.md5(F.concat(key, F.lit("quota")))})
    others = others.withColumns({"filled": F.lit(1), "place": F.md5(F.concat(key, F.lit(day), F.lit("fill")))}).orderBy("place").limit(limit)
    return chosen.unionByName(others).orderBy("filled", "place").limit(limit).select("consolidation_key", "priority_tier", "priority_score", "sample_bucket")


def duplicate_sites(sites: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(site_id) of verified, enabled sites besides the best of their company and kind.

    The best has the latest success, then the smallest id. The keeper comes from a partial aggregate, so a
    company with many sites isn't sorted in one task.
    """
    wanted = sites.where(F.col("source_type").isin(*kinds) & (F.col("verification_status") == "verified") & F.col("crawl_enabled"))
    best = F.min(F.struct(F.col("last_success_at").isNull().alias("never"), (-F.unix_micros(F.col("last_success_at").cast("timestamp"))).alias("age"), "site_id")).alias("best")
    keepers = wanted.groupBy("consolidation_key", "source_type").agg(best).select("best.site_id")
    return wanted.select("site_id").join(keepers, "site_id", "left_anti")


def site_rollup(sites: DataFrame) -> DataFrame:
    """What each company's sites have reached."""
    verified = F.col("verification_status") == "verified"
    enabled = verified & F.col("crawl_enabled")
    return sites.groupBy("consolidation_key").agg(F.bool_or(verified).alias("has_verified_site"), F.bool_or(enabled).alias("has_enabled_site"), F.bool_or(enabled & F.col("last_success_at").isNotNull()).alias("has_success"))


def rank_coverage(targets: DataFrame, sites: DataFrame, cuts: tuple[int, ...] = (500, 1000)) -> DataFrame:
    """Coverage of the first companies by tier and score, for each cut and for all (``max_rank`` null).

    A company counts in each bucket that it is in. Only the companies up to the last cut are ranked.
    """
    wanted = targets.where(F.col("enabled") & F.col("priority_tier").isin(*TIERS))
    order = (tier_rank(F.col("priority_tier")), F.col("priority_score").desc_nulls_last(), F.col("canonical_name"), F.col("consolidation_key"))
    first = wanted.orderBy(*order).limit(max(cuts)).withColumn("overall_rank", F.row_number().over(Window.orderBy(*order))).select("consolidation_key", "overall_rank")
    rows = wanted.join(F.broadcast(first), "consolidation_key", "left").join(site_rollup(sites), "consolidation_key", "left")
    buckets = F.array(*(F.when(F.col("overall_rank") <= c, F.lit(c)).otherwise(F.lit(-1)) for c in cuts), F.lit(0))
    rows = rows.withColumn("bucket", F.explode(F.array_remove(buckets, -1)))
    has = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    g = rows.groupBy("bucket").agg(F.count("*").alias("companies"), has("has_verified_site").alias("verified_site_companies"), has("has_enabled_site").alias("can_crawl"), has("has_success").alias("crawled_successfully"))
    share = F.round(100.0 * F.col("crawled_successfully") / F.col("companies"), 2).cast("double")
    return g.withColumn("success_pct", share).withColumn("max_rank", F.nullif("bucket", F.lit(0))).drop("bucket")


def top_candidates(sites: DataFrame) -> DataFrame:
    """The best three sites of each company in columns; sites without a rank come last."""
    order = Window.partitionBy("consolidation_key").orderBy(F.col("candidate_rank").asc_nulls_last(), "site_id")
    best = sites.withColumn("place", F.row_number().over(order)).where("place <= 3")
    return best.groupBy("consolidation_key").agg(*(F.max(F.when(F.col("place") == k, F.col("site_id"))).alias(f"site_{k}") for k in (1, 2, 3)), F.count("*").alias("candidates"))
