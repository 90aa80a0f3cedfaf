"""Targets and candidate sites: sync, trust, review, hygiene, ranked discovery and its features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelake.functions.urls import bound, classify_url, has_career_term, host_suffixes, once, url_parts
from hirelake.operators.pages import company_tokens
from hirelake.operators.queues import TIERS
from hirelake.operators.sites import INTERVALS

#: Services whose best candidate is trusted without review, and those trusted at one host only.
TRUSTED = ("amazon_jobs", "greenhouse", "workday", "lever", "ashby", "smartrecruiters", "oracle_cloud")
TRUSTED_AT = {"workable": "apply.workable.com", "jobvite": "jobs.jobvite.com", "paylocity": "recruiting.paylocity.com", "rippling": "ats.rippling.com"}
#: Urls of single jobs, by service.
JOB_URLS = {"workday": r"(?i)myworkdayjobs\.com/.*/job/", "amazon_jobs": r"(?i)amazon\.jobs/.*/jobs/[0-9]+/"}
#: The order of states and signals in the review.
STATES = ("REVIEW_CANDIDATES", "VERIFIED")
SIGNALS = ("manual_p0", "chicago_and_linkedin", "chicago", "linkedin_top_employer", "large_lca_sponsor")


def _place(value: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(value == x, F.lit(k)) for k, x in enumerate(order)), F.lit(len(order)))


def sync_targets(targets: DataFrame, scored: DataFrame, overrides: DataFrame) -> DataFrame:
    """The targets after a scoring: tiered units are enabled with their new score, others are disabled.

    A disabled target keeps its name, tier and score, and loses its computed tier and override.
    """
    forced = overrides.where("active").select("consolidation_key", F.col("reason").alias("override_reason")).withColumn("forced", F.lit(True))
    new = scored.where(F.col("crawl_priority_tier").isin(*TIERS)).join(forced, "consolidation_key", "left").select(
        "consolidation_key", F.col("canonical_name").alias("n_name"), F.col("crawl_priority_tier").alias("n_tier"), F.col("computed_crawl_priority_tier").alias("n_computed"), F.col("priority_score").alias("n_score"),
        F.when(F.col("forced"), "manual_override").otherwise("computed").alias("n_source"), "override_reason", F.lit(True).alias("there"),
    )
    rows = targets.join(new, "consolidation_key", "full_outer")
    here = F.coalesce("there", F.lit(False))
    take = lambda new, old: F.when(here, F.col(new)).otherwise(F.col(old))
    return rows.select(
        "consolidation_key", take("n_name", "canonical_name").alias("canonical_name"), take("n_tier", "priority_tier").alias("priority_tier"), F.when(here, F.col("n_computed")).alias("computed_priority_tier"),
        F.when(here, F.col("n_source")).otherwise("computed").alias("priority_source"), F.when(here, F.col("override_reason")).alias("override_reason"), take("n_score", "priority_score").alias("priority_score"), here.alias("enabled"),
    )


def auto_trusted(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """(site_id) of the best supported candidate of each enabled, tiered company without a verified site.

    Urls of single jobs don't count. The best has the least rank, then the highest score, then the least id.
    """
    verified = sites.where("verification_status = 'verified'").select("consolidation_key").distinct()
    kind = F.col("source_type")
    at_home = kind.isin(*TRUSTED) | F.coalesce(*(F.when(kind == k, F.col("normalized_domain") == host) for k, host in TRUSTED_AT.items()), F.lit(False))
    single = F.coalesce(*(F.when(kind == k, F.col("site_url").rlike(p)) for k, p in JOB_URLS.items()), F.lit(False))
    wanted = targets.where(F.col("enabled") & F.col("priority_tier").isin(*TIERS)).select("consolidation_key", "priority_tier")
    rows = sites.where((F.col("verification_status") == "unverified") & at_home & ~single).join(wanted, "consolidation_key").join(verified, "consolidation_key", "left_anti")
    order = F.struct(F.coalesce("candidate_rank", F.lit(2**31 - 1)), F.coalesce(-F.col("candidate_score"), F.lit(1e9)), F.col("site_id"))
    best = rows.groupBy("consolidation_key").agg(F.min_by(F.struct("site_id", "priority_tier"), order).alias("s"))
    return best.select("s.site_id", "consolidation_key", F.coalesce(*(F.when(F.col("s.priority_tier") == t, F.lit(h)) for t, h in INTERVALS.items())).alias("crawl_interval_hours"))


def auto_trust_sites(sites: DataFrame, targets: DataFrame, by: str = "system:structured-ats-best") -> DataFrame:
    """``sites`` with the trusted ones verified and enabled."""
    chosen = auto_trusted(sites, targets).select("site_id", F.lit(True).alias("chosen"))
    rows = sites.join(chosen, "site_id", "left")
    hit = F.col("chosen").isNotNull()
    changes = {"verification_status": "verified", "crawl_enabled": True, "crawl_status": "pending", "target_country_code": "US", "scope_method": "local_filter", "reviewed_by": by}
    return rows.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items() if c in sites.columns}).drop("chosen")


def apply_site_reviews(sites: DataFrame, decisions: DataFrame) -> DataFrame:
    """``sites`` after decisions (consolidation_key, site_id or null): one is verified and its siblings rejected, or all are."""
    latest = decisions.groupBy("consolidation_key").agg(F.max_by(F.struct("site_id"), F.struct("decided_at", F.coalesce("site_id", F.lit(-1)))).alias("d")).select("consolidation_key", F.col("d.site_id").alias("chosen"), F.lit(True).alias("decided"))
    rows = sites.join(latest, "consolidation_key", "left")
    status = F.when(F.col("decided").isNull(), F.col("verification_status")).when(F.col("chosen") == F.col("site_id"), "verified").otherwise("rejected")
    enabled = F.when(F.col("decided").isNull(), F.col("crawl_enabled")).otherwise(F.coalesce(F.col("chosen") == F.col("site_id"), F.lit(False)))
    return rows.withColumns({"verification_status": status, "crawl_enabled": enabled}).select(*sites.columns)


def discovery_status(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """What discovery has found for each target: a verified site, candidates for review, or nothing."""
    rollup = sites.groupBy("consolidation_key").agg(F.bool_or(F.col("verification_status") == "verified").alias("found"), F.bool_or(F.col("verification_status") == "unverified").alias("pending"))
    status = F.when(F.col("found"), "found").when(F.col("pending"), "review_pending").otherwise("not_found")
    return targets.select("consolidation_key").join(rollup, "consolidation_key", "left").select("consolidation_key", status.alias("discovery_status"))


def discovery_dates(sites: DataFrame, targets: DataFrame, as_of: str) -> DataFrame:
    """``discovery_status`` with the date of the next search: none with a site or a candidate, else after 30 days."""
    later = F.lit(as_of).cast("timestamp") + F.expr("INTERVAL 30 DAYS")
    return discovery_status(sites, targets).withColumn("next_discovery_at", F.when(F.col("discovery_status") == "not_found", later))


def apply_priority_overrides(overrides: DataFrame, decisions: DataFrame) -> DataFrame:
    """(consolidation_key, override_tier, active) after decisions: a tier sets one, AUTO clears it; the latest counts."""
    latest = decisions.where(F.col("decision").isin(*TIERS, "AUTO")).groupBy("consolidation_key").agg(F.max_by("decision", F.struct("decided_at", "decision")).alias("decision"))
    rows = overrides.join(latest, "consolidation_key", "full_outer")
    auto = F.col("decision") == "AUTO"
    tier = F.when(F.col("decision").isNull() | auto, F.col("override_tier")).otherwise(F.col("decision"))
    active = F.when(F.col("decision").isNull(), F.col("active")).otherwise(~auto)
    return rows.select("consolidation_key", tier.alias("override_tier"), active.alias("active"))


def site_hygiene(sites: DataFrame, excluded: DataFrame) -> DataFrame:
    """(site_id, action) by the first rule that fits: reject, demote or requeue; other sites are left out.

    Excluded domains are found by equality with the host's parent domains. A 404 that persists is
    rejected, a first one demoted, and what may pass is queued again.
    """
    suffixes = sites.select("site_id", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    out = suffixes.join(excluded.select("domain").distinct(), "domain", "left_semi").select("site_id").distinct().withColumn("excluded", F.lit(True))
    error = F.lower(F.coalesce("last_error", F.lit("")))
    single = F.coalesce(*(F.when(F.col("source_type") == k, F.col("url").rlike(p)) for k, p in JOB_URLS.items()), F.lit(False))
    missing = error.contains("404")
    action = (
        F.when(F.col("excluded"), "reject_domain").when(single, "reject_job_url").when(missing & (F.col("consecutive_failures") >= 2), "reject_persistent_404").when(missing, "demote_404")
        .when(error.contains("429") | error.contains("timed out") | error.contains("timeout"), "requeue_transient")
    )
    return sites.join(out, "site_id", "left").select("site_id", action.alias("action")).where("action IS NOT NULL")



def review_workbench(targets: DataFrame, candidates: DataFrame, verified: DataFrame) -> DataFrame:
    """One row for each company with something to review, in the order of review.

    candidates: the best three in columns (``top_candidates``); verified: (consolidation_key, verified_site).
    Ranks come from sorted ranges: each range's rows are numbered after those of the ranges before it.
    """
    rows = targets.join(candidates, "consolidation_key", "left").join(verified, "consolidation_key", "left").where("site_1 IS NOT NULL OR verified_site IS NOT NULL")
    state = F.when(F.col("verified_site").isNull(), "REVIEW_CANDIDATES").otherwise("VERIFIED")
    rows = rows.withColumn("action_status", state)
    order = [_place(F.col("priority_tier"), ("P0", "P1")), _place(F.col("action_status"), STATES), _place(F.col("signal"), SIGNALS), F.col("priority_score").desc_nulls_first(), F.md5("consolidation_key")]
    return ranked(rows, order, "review_rank")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` numbered by a total order, without one task that sorts them all."""
    dealt = rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).cache()
    inside = dealt.withColumn("at_", F.row_number().over(Window.partitionBy("range_").orderBy(*order)))
    # A row for each range: some hundreds at most meet in the window.
    sizes = dealt.groupBy("range_").agg(F.count("*").alias("n")).withColumn("before_", F.sum("n").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)))
    return inside.join(F.broadcast(sizes.drop("n")), "range_").withColumn(name, F.coalesce("before_", F.lit(0)) + F.col("at_")).drop("range_", "at_", "before_")


def search_terms(name: Column, aliases: Column) -> Column:
    """The name and the aliases between bars, each once in any case, in their order."""
    terms = F.filter(F.transform(F.concat(F.array(name), F.split(F.coalesce(aliases, F.lit("")), r"\|")), lambda t: F.trim(t)), lambda t: t != "")
    return F.filter(terms, lambda t, i: F.array_position(F.transform(terms, lambda x: F.lower(x)), F.lower(t)) == i + 1)


def search_query(terms: Column) -> Column:
    """The first three terms, quoted, as a query for career pages."""
    quoted = F.array_join(F.transform(F.slice(terms, 1, 3), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")
    return F.when(F.size(terms) > 0, F.concat(F.lit("("), quoted, F.lit(") official careers jobs"))).otherwise('"" official careers jobs')


def rank_discovery_candidates(results: DataFrame, excluded: DataFrame, places: int = 3) -> DataFrame:
    """The best search results of each company: scored, each canonical url once, those under 25 points left out.

    results: consolidation_key, canonical_name, url, title, score (0 to 1).
    """
    title = F.lower(F.coalesce("title", F.lit("")))
    rows = results.where(F.col("url").rlike("^https?://")).select("*", once(bound(url_parts(F.col("url")), lambda u: F.struct(u["path"].alias("path"), classify_url(u).alias("c")))).alias("u")).select("*", "u.c").where("c.host <> ''")
    hosts = rows.select(F.col("c.host").alias("host")).distinct()
    out = hosts.withColumn("domain", F.explode(host_suffixes(F.col("host")))).join(excluded.select("domain").distinct(), "domain", "left_semi").select("host").distinct()
    rows = rows.join(out, rows["c.host"] == out["host"], "left_anti")
    token = F.exists(F.slice(company_tokens(F.col("canonical_name")), 1, 4), lambda w: F.contains(F.col("c.host"), w) | F.contains(title, w))
    points = lambda condition, n: F.when(condition, F.lit(float(n))).otherwise(0.0)
    score = (
        20 * F.greatest(F.lit(0.0), F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0))) + points(F.col("c.source_type") != "generic_html", 50) + points(has_career_term(F.col("u.path")), 25) + points(has_career_term(title), 15)
        + points(token, 15) + points(title.contains("official"), 5) + points(F.col("c.site_kind") == "corporate", -15)
    )
    best = rows.withColumn("points", F.round(score, 3)).where("points >= 25").groupBy("consolidation_key", F.col("c.canonical_url").alias("site_url")).agg(F.max("points").alias("points"), F.max_by(F.struct("c.source_type", "c.source_key"), "points").alias("c"))
    order = Window.partitionBy("consolidation_key").orderBy(F.desc("points"), "site_url")
    return best.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= places).select("consolidation_key", "candidate_rank", F.col("points").alias("candidate_score"), "site_url", "c.source_type", "c.source_key")


def finalize_discovery(targets: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """Targets after a discovery run (consolidation_key, search_succeeded, candidate_count): state, next date and failures in a row."""
    rows = targets.join(outcomes, "consolidation_key", "left")
    ran, good = F.col("search_succeeded").isNotNull(), F.coalesce("search_succeeded", F.lit(False))
    now = F.lit(as_of).cast("timestamp")
    found = good & (F.col("candidate_count") > 0)
    status = F.when(~ran, F.col("discovery_status")).when(found, "review_pending").when(good, "not_found").otherwise("retry")
    failures = F.when(~ran, F.col("consecutive_discovery_failures")).when(good, 0).otherwise(F.coalesce("consecutive_discovery_failures", F.lit(0)) + 1)
    wait = F.when(good, F.expr("INTERVAL 30 DAYS")).otherwise(F.expr("INTERVAL 1 DAYS"))
    following = F.when(~ran, F.col("next_discovery_at")).when(~found, now + wait)
    return rows.withColumns({"discovery_status": status, "next_discovery_at": following, "consecutive_discovery_failures": failures}).select(*targets.columns)


def rekey_companies(rows: DataFrame, key_map: DataFrame) -> DataFrame:
    """``rows`` with the keys of merged companies (old_key, new_key) replaced."""
    return rows.join(key_map.select(F.col("old_key").alias("consolidation_key"), "new_key"), "consolidation_key", "left").withColumn("consolidation_key", F.coalesce("new_key", "consolidation_key")).select(*rows.columns)
