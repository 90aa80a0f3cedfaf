"""State of discovery, crawling, scoring and postings: the figures of the operations pages, one grouping each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelake.functions.money import annual_salary
from hirelake.functions.titles import is_product_role, normalize_soc_code, product_role_category
from hirelake.functions.urls import path_pattern, template_family
from hirelake.operators.activity import ZONE, local_date
from hirelake.operators.dashboard import is_posting_us

#: Tiers, errors that pass by themselves, services with an adapter, and the code of chief executives.
TIERS = ("P0", "P1", "P2", "P3")
TRANSIENT = ("HTTPError: HTTP Error 429", "HTTPError: HTTP Error 432", "HTTPError: HTTP Error 5", "URLError", "TimeoutError")
SUPPORTED = ("apple_jobs", "greenhouse", "icims", "oracle_cloud", "workday")
CHIEF = ("11101100", "chief executives")
SCORES = ("target_role_score", "lca_count_score", "chicago_score", "product_role_score", "product_manager_score", "salary_score", "linkedin_top_employer_score")


def _verified() -> Column:
    return F.col("verification_status") == "verified"


def _unverified() -> Column:
    return F.col("verification_status") == "unverified"


def _open() -> Column:
    return _verified() & F.col("crawl_enabled")


def _none(c: str, value: int | bool = 0) -> Column:
    return F.coalesce(F.col(c), F.lit(value))


def _share(part: Column, whole: Column, places: int) -> Column:
    """A percentage as double; null for nothing."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole), places)


def _salary() -> Column:
    return annual_salary(F.col("wage_rate_of_pay_from"), F.col("wage_unit_of_pay"))


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """By run and cohort: searches by what came of them, failures that pass by themselves, first and last time, and the run's quality."""
    good = F.col("search_succeeded")
    error = F.lower("error_message")
    passing = F.coalesce(*(F.when(error.startswith(p.lower()), True) for p in TRANSIENT), F.lit(False))
    g = attempts.groupBy("run_id", "cohort").agg(
        F.count("*").alias("companies"), F.count_if(good).alias("succeeded_searches"), F.count_if(good & (F.col("candidate_count") > 0)).alias("searches_with_candidates"),
        F.count_if(good & (F.col("candidate_count") == 0)).alias("searched_no_candidate"), F.count_if(~good).alias("failed_searches"), F.count_if(~good & passing).alias("transient_failures"),
        F.min("attempted_at").alias("first_attempted_at"), F.max("attempted_at").alias("last_attempted_at"),
    )
    failed = F.col("failed_searches")
    quality = F.when(failed == F.col("companies"), "full_batch_failed").when(failed > 0, "partial_failures").when(F.col("searched_no_candidate") > 0, "completed_with_no_candidate").otherwise("completed_with_candidates")
    return g.withColumn("run_quality", quality)


def credits_by_day(runs: DataFrame) -> DataFrame:
    """Paid discovery runs by local day and cohort, with the local times of the first and the last."""
    local = F.from_utc_timestamp("started_at", ZONE)
    paid = runs.where("estimated_credits > 0").groupBy(local_date(F.col("started_at")).alias("local_day"), "cohort")
    return paid.agg(F.count("*").alias("runs"), *(F.sum(c).alias(c) for c in ("target_count", "candidate_count", "error_count", "estimated_credits")), F.min(local).alias("first_run_at"), F.max(local).alias("last_run_at"))


def paid_runs_of_day(runs: DataFrame, now: str) -> DataFrame:
    """The paid discovery runs of the local day."""
    rows = runs.where((F.col("estimated_credits") > 0) & (local_date(F.col("started_at")) == local_date(F.lit(now).cast("timestamp"))))
    return rows.select("run_id", "cohort", "target_count", "candidate_count", "error_count", "estimated_credits", F.from_utc_timestamp("started_at", ZONE).alias("started_local"))


def crawl_funnel(scores: DataFrame, targets: DataFrame, sites: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of 14 counts, from companies that are scored to sites that are due; each table is read once."""
    tier = F.col("crawl_priority_tier")
    a = scores.agg(F.count("*").alias("all_companies"), F.count_if(F.col("target_role_score") == 1).alias("target_soc_companies"), *(F.count_if(tier == t).alias(f"{t.lower()}_companies") for t in TIERS))
    b = targets.agg(F.count_if("enabled").alias("enabled_targets"))
    scoped = _verified() & (F.col("target_country_code") == "US") & (F.col("scope_method") != "unknown")
    # Companies first: a distinct count would send every row twice.
    companies = sites.groupBy("consolidation_key").agg(
        F.bool_or(_unverified()).alias("candidate"), F.bool_or(_verified()).alias("verified"), F.count_if(scoped).alias("ready"), F.count_if(_verified() & F.col("source_type").isin(*SUPPORTED)).alias("supported")
    )
    known = F.col("consolidation_key").isNotNull()
    c = companies.agg(
        F.count_if(F.col("candidate") & known).alias("companies_with_candidates"), F.count_if(F.col("verified") & known).alias("companies_with_verified_site"),
        F.coalesce(F.sum("ready"), F.lit(0)).alias("us_ready_sites"), F.coalesce(F.sum("supported"), F.lit(0)).alias("adapter_supported_sites"),
    )
    d = queue.agg(F.count("*").alias("schedulable_sites"), F.count_if("is_due").alias("due_sites"), F.count_if(F.col("last_crawled_at").isNull()).alias("never_crawled_schedulable_sites"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)


def site_rollup(sites: DataFrame) -> DataFrame:
    """By company: what its sites have reached, and how many wait, are turned down, or are of either kind."""
    plain = F.col("source_type") == "generic_html"
    return sites.groupBy("consolidation_key").agg(
        F.bool_or(_verified()).alias("has_verified_site"), F.bool_or(_open()).alias("has_enabled_site"), F.bool_or(_open() & F.col("last_crawled_at").isNotNull()).alias("has_attempt"),
        F.bool_or(_open() & F.col("last_success_at").isNotNull()).alias("has_success"), F.bool_or(_open() & (F.col("crawl_status") == "failed")).alias("has_failed"),
        F.count_if(_unverified() & plain).alias("generic_candidates"), F.count_if(_unverified() & ~plain).alias("structured_candidates"),
        F.count_if(_unverified()).alias("unverified_candidates"), F.count_if(F.col("verification_status") == "rejected").alias("rejected_candidates"),
    )


def coverage_by_tier(targets: DataFrame, sites: DataFrame, queue: DataFrame) -> DataFrame:
    """By tier of enabled targets: companies with candidates and verified sites, by whom verified, and the schedule's counts."""
    wanted = targets.where(F.col("enabled") & F.col("priority_tier").isin(*TIERS)).select("consolidation_key", "priority_tier")
    by_system = F.coalesce(F.col("reviewed_by").startswith("system:"), F.lit(False))
    rollup = sites.groupBy("consolidation_key").agg(
        F.bool_or(_unverified()).alias("candidate"), F.bool_or(_verified()).alias("verified"), F.bool_or(_verified() & ~by_system).alias("human"), F.bool_or(_verified() & by_system).alias("auto"), F.count_if(_open()).alias("open")
    )
    yes = lambda c: F.count_if(_none(c, False))
    counts = wanted.join(rollup, "consolidation_key", "left").groupBy("priority_tier").agg(
        F.count("*").alias("companies"), yes("candidate").alias("companies_with_candidates"), yes("verified").alias("companies_with_verified_site"), yes("human").alias("human_verified_companies"),
        yes("auto").alias("auto_trusted_companies"), F.coalesce(F.sum("open"), F.lit(0)).alias("verified_enabled_sites"),
    )
    schedule = queue.groupBy("priority_tier").agg(F.count("*").alias("schedulable_sites"), F.count_if("is_due").alias("due_now"), F.count_if(F.col("last_crawled_at").isNull()).alias("never_crawled"))
    rate = F.round(F.col("companies_with_verified_site").cast("double") / F.col("companies"), 4)
    return counts.join(schedule, "priority_tier", "left").na.fill(0, ["schedulable_sites", "due_now", "never_crawled"]).withColumn("verified_company_rate", rate)


def review_progress(targets: DataFrame, sites: DataFrame) -> DataFrame:
    """By tier of enabled targets: how far the review of sites and the crawl have come, with shares."""
    rows = targets.where(F.col("enabled") & F.col("priority_tier").isin(*TIERS)).select("consolidation_key", "priority_tier").join(site_rollup(sites), "consolidation_key", "left")
    yes = lambda c: F.count_if(_none(c, False))
    some = lambda c: F.count_if(_none(c) > 0)
    g = rows.groupBy("priority_tier").agg(
        F.count("*").alias("companies"), yes("has_verified_site").alias("site_reviewed_verified"), some("unverified_candidates").alias("waiting_site_review"), yes("has_enabled_site").alias("can_crawl"),
        yes("has_attempt").alias("crawled_at_least_once"), yes("has_success").alias("crawled_successfully"),
        F.count_if(~_none("has_verified_site", False) & (_none("unverified_candidates") == 0)).alias("no_site_candidate_yet"), some("rejected_candidates").alias("has_rejected_candidates"),
    )
    return g.withColumns({"verified_pct": _share(F.col("site_reviewed_verified"), F.col("companies"), 2), "success_pct": _share(F.col("crawled_successfully"), F.col("companies"), 2)})


def crawl_state(targets: DataFrame, sites: DataFrame, queue: DataFrame) -> DataFrame:
    """Enabled targets by tier and the first of eight states that fits, with the share within the tier."""
    due = queue.groupBy("consolidation_key").agg(F.count_if("is_due").alias("due_sites"))
    rows = targets.where(F.col("enabled") & F.col("priority_tier").isin(*TIERS)).select("consolidation_key", "priority_tier", "discovery_status")
    rows = rows.join(site_rollup(sites), "consolidation_key", "left").join(due, "consolidation_key", "left")
    state = (
        F.when(_none("has_success", False), "01 successfully crawled").when(_none("has_failed", False), "02 adapter/site failed").when(_none("due_sites") > 0, "03 enabled and due")
        .when(_none("has_enabled_site", False), "04 enabled not due").when(_none("structured_candidates") > 0, "05 structured candidate not enabled")
        .when(_none("generic_candidates") > 0, "06 generic HTML needs resolution").when(F.col("discovery_status") == "pending", "07 not searched yet").otherwise("08 searched no usable candidate")
    )
    return shares_within(rows.groupBy("priority_tier", state.alias("crawl_state")).agg(F.count("*").alias("companies")), "priority_tier", "companies")


def shares_within(counted: DataFrame, group: str, count: str) -> DataFrame:
    """Counts with their share of the group, in percent; a group has as many rows as there are states."""
    return counted.withColumn("pct_within_tier", _share(F.col(count), F.sum(count).over(Window.partitionBy(group)), 2))


def blocked_templates(targets: DataFrame, sites: DataFrame) -> DataFrame:
    """Unresolved plain pages of enabled targets without a working site: companies and sites by tier, family of page and pattern of path."""
    state = site_rollup(sites).select("consolidation_key", "has_enabled_site", "has_success")
    plain = sites.where((F.col("source_type") == "generic_html") & _unverified() & ~F.col("crawl_enabled"))
    rows = plain.join(targets.where(F.col("enabled") & F.col("priority_tier").isin(*TIERS)).select("consolidation_key", "priority_tier"), "consolidation_key").join(state, "consolidation_key", "left").where(~_none("has_enabled_site", False) & ~_none("has_success", False))
    named = F.split_part(F.regexp_replace("site_url", "^https?://", ""), F.lit("/"), F.lit(1))
    host = F.lower(F.regexp_replace(F.coalesce("normalized_domain", named), r"^www\.", ""))
    path = F.lower(F.regexp_replace(F.regexp_replace("site_url", "^https?://[^/]+", ""), "[?#].*$", ""))
    return rows.select("priority_tier", "consolidation_key", host.alias("host"), path.alias("path")).groupBy("priority_tier", template_family(F.col("host"), F.col("path")).alias("template_family"), path_pattern(F.col("path")).alias("path_pattern")).agg(
        F.count_distinct("consolidation_key").alias("companies"), F.count("*").alias("site_rows")
    )


def today_progress(runs: DataFrame, sites: DataFrame, targets: DataFrame, now: str) -> DataFrame:
    """By tier, since local midnight: runs, companies tried and crawled, failures, and the jobs that the runs met."""
    midnight = F.to_utc_timestamp(local_date(F.lit(now).cast("timestamp")).cast("timestamp"), ZONE)
    rows = runs.where(F.col("started_at") >= midnight).join(sites.select("site_id", "consolidation_key"), "site_id").join(targets.where(F.col("priority_tier").isin(*TIERS)).select("consolidation_key", "priority_tier"), "consolidation_key")
    kinds = ("parsed", "new", "closed", "target", "review")
    good = F.col("status") == "succeeded"
    by_company = rows.groupBy("priority_tier", "consolidation_key").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(F.col("status") == "failed").alias("bad"), *(F.sum(f"{k}_job_count").alias(k) for k in kinds))
    return by_company.groupBy("priority_tier").agg(
        F.sum("n").alias("site_attempts_today"), F.count("*").alias("companies_attempted_today"), F.count_if(F.col("good") > 0).alias("companies_succeeded_today"), F.sum("bad").alias("failed_site_attempts_today"),
        *(F.coalesce(F.sum(k), F.lit(0)).alias(f"{k}_jobs_today") for k in kinds),
    )


def _pooled(scores: DataFrame, targets: DataFrame) -> DataFrame:
    known = targets.select("consolidation_key", F.col("enabled").alias("target_enabled"), "priority_tier")
    inside = _none("target_enabled", False) & F.coalesce(F.col("priority_tier").isin("P0", "P1", "P2"), F.lit(False))
    return scores.join(known, "consolidation_key", "left").withColumn("inside", inside)


def pool_breakdown(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Scored companies in the enabled pool and outside it, with what speaks for them."""
    return _pooled(scores, targets).groupBy(F.when(F.col("inside"), "in_enabled_p_pool").otherwise("outside_enabled_p_pool").alias("pool")).agg(
        F.count("*").alias("companies"), F.count_if("recent_lca").alias("recent_lca"), F.count_if(F.col("target_role_lca_count") > 0).alias("has_target_lca_rows"), F.count_if(F.col("salary_score") > 0).alias("has_salary_score"),
        F.count_if("executive_only_excluded").alias("executive_only_excluded"), F.round(F.sum("priority_score").cast("double") / F.count("*"), 3).alias("avg_priority_score"),
    )


def outside_reasons(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Scored companies outside the pool by the first reason that fits."""
    reason = (
        F.when(F.col("executive_only_excluded"), "executive_only_excluded").when((_none("target_role_lca_count") == 0) & (_none("target_role_score") == 0), "no_target_soc_role_signal")
        .when(_none("priority_score") < 2, "has_target_signal_but_score_below_p2").otherwise("other_not_in_enabled_pool")
    )
    return _pooled(scores, targets).where(~F.col("inside")).groupBy(reason.alias("outside_reason")).agg(
        F.count("*").alias("companies"), F.count_if("recent_lca").alias("recent_lca"), F.count_if(F.col("lca_count") >= 5).alias("lca_ge_5"), F.count_if(F.col("target_role_lca_count") > 0).alias("has_target_lca_rows")
    )


def score_histogram(scores: DataFrame) -> DataFrame:
    """Consolidated companies by band of score, in the order of the lowest score of a band."""
    score = F.col("priority_score")
    band = F.when(score == 0, "0").when(score <= 1, "0-1").when(score <= 2, "1-2").when(score <= 3, "2-3").when(score <= 4, "3-4").when(score <= 5, "4-5").otherwise("5+")
    return scores.groupBy(band.alias("bucket")).agg(F.count("*").alias("companies"), F.min(score).alias("lowest")).orderBy("lowest")


def component_patterns(scores: DataFrame, score: str, places: int = 15) -> DataFrame:
    """The most frequent combinations of the seven scores among companies of one total."""
    counted = scores.where(F.col("priority_score") == F.lit(score).cast("decimal(4,2)")).groupBy(*SCORES).agg(F.count("*").alias("companies"))
    return counted.orderBy(F.desc("companies"), *SCORES).limit(places)


def _high(scores: DataFrame, least: int = 76) -> DataFrame:
    return scores.where((F.col("target_role_score") > 0) & (F.col("product_role_lca_pct") >= least))


def _cohort() -> Column:
    return F.when(F.col("product_role_lca_pct") == 100, "100%").otherwise("76-99%")


def product_share(scores: DataFrame) -> DataFrame:
    """Target companies by the share of product roles: two cohorts, their sum, and their companies of one filing."""
    full, high = F.col("product_role_lca_pct") == 100, F.col("product_role_lca_pct") >= 76
    single = lambda c: _share(F.count_if(c & F.col("single_lca_company")), F.count_if(c), 1)
    return scores.where("target_role_score > 0").agg(
        F.count_if(full).alias("companies_at_100_pct"), F.count_if(high & ~full).alias("companies_76_to_99_pct"), F.count_if(high).alias("companies_76_plus_pct"),
        single(full).alias("pct_single_at_100"), single(high & ~full).alias("pct_single_76_to_99"),
    )


def _of_all(counted: DataFrame, places: int = 1) -> Column:
    """A row's share of all rows; the frame has a row for each of a few classes."""
    return _share(F.col("companies"), F.sum("companies").over(Window.partitionBy()), places)


def product_share_buckets(scores: DataFrame) -> DataFrame:
    """Target companies by bands of the share of product roles."""
    share = F.col("product_role_lca_pct")
    band = F.when(share == 0, "0%").when(share <= 10, "1-10%").when(share <= 25, "11-25%").when(share <= 50, "26-50%").when(share <= 75, "51-75%").otherwise("76-100%")
    counted = scores.where("target_role_score > 0").groupBy(band.alias("product_share_bucket")).agg(F.count("*").alias("companies"))
    return counted.withColumn("pct_of_target_companies", _of_all(counted))


def product_share_sizes(scores: DataFrame) -> DataFrame:
    """Companies with product roles only, by the number of their filings."""
    n = F.col("lca_count")
    band = F.when(n == 1, "1 filing").when(n.between(2, 5), "2-5 filings").when(n.between(6, 20), "6-20 filings").otherwise("21+ filings")
    counted = _high(scores, 100).groupBy(band.alias("lca_count_bucket")).agg(F.count("*").alias("companies"))
    return counted.withColumn("pct_of_100_pct_cohort", _of_all(counted))


def product_share_patterns(scores: DataFrame, filings: DataFrame) -> DataFrame:
    """Companies of a high share by how many titles they use; titles are counted before companies meet them."""
    product = is_product_role(F.col("job_title"))
    titles = filings.groupBy("employer_fein", "job_title").agg(F.count("*").alias("n")).where("job_title IS NOT NULL")
    stats = titles.groupBy(F.col("employer_fein").alias("fein")).agg(F.count("*").alias("titles"), F.count_if(product).alias("product_titles"))
    rows = _high(scores).select("fein", "lca_count").join(stats, "fein")
    pattern = F.when(F.col("titles") == 1, "single raw job title total").when(F.col("product_titles") == 1, "multiple titles, one product title").otherwise("multiple product titles")
    counted = rows.groupBy(pattern.alias("title_pattern")).agg(F.count("*").alias("companies"), F.round(F.sum("lca_count") / F.count("*"), 1).alias("avg_lca_count"))
    return counted.withColumn("pct_of_76_plus_cohort", _of_all(counted))


def product_share_titles(scores: DataFrame, filings: DataFrame, places: int = 20) -> DataFrame:
    """The titles that most companies of each cohort use, with their category and the share of product roles."""
    cohorts = _high(scores).select("fein", _cohort().alias("cohort"))
    counted = filings.groupBy(F.col("employer_fein").alias("fein"), "job_title").agg(F.count("*").alias("n"))
    titles = counted.join(cohorts, "fein").groupBy("cohort", "job_title").agg(F.count("*").alias("companies"), F.sum("n").alias("filings"))
    order = Window.partitionBy("cohort").orderBy(F.desc("companies"), F.desc("filings"), "job_title")
    ranked = titles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= places)
    return ranked.withColumns({"category": product_role_category(F.col("job_title")), "pct_product_rows": F.when(is_product_role(F.col("job_title")), 100.0).otherwise(0.0)})


def _target_salaries(filings: DataFrame, units: DataFrame, target_soc: DataFrame) -> DataFrame:
    """Filings of target occupations with a yearly salary, by unit (consolidation_key, member_feins)."""
    codes = target_soc.where("active").select(F.col("normalized_soc_code").alias("code"), F.col("representative_title").alias("soc_title"))
    rows = filings.select("employer_fein", "job_title", "soc_code", "decision_date", "wage_rate_of_pay_from", "wage_unit_of_pay", _salary().alias("annual_salary"), normalize_soc_code(F.col("soc_code")).alias("code")).where("annual_salary IS NOT NULL")
    members = units.select("consolidation_key", F.explode("member_feins").alias("employer_fein"))
    return rows.join(F.broadcast(codes), "code").join(members, "employer_fein")


def _recent(rows: DataFrame, filings: DataFrame, years: int) -> DataFrame:
    newest = filings.agg(F.max("decision_date").alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).where(F.col("decision_date") >= F.add_months("newest", -12 * years)).drop("newest")


def _first(rows: DataFrame, order: list[Column], places: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("consolidation_key").orderBy(*order))).where(F.col("place") <= places)


def lowest_salaries(filings: DataFrame, units: DataFrame, target_soc: DataFrame, limit: int | None = 90_000, years: int | None = 3, places: int = 30) -> DataFrame:
    """Per unit, the lowest salaries of target occupations: under the limit and in the data set's last years, or of all."""
    rows = _target_salaries(filings, units, target_soc)
    rows = rows.where(F.col("annual_salary") < limit) if limit else rows
    rows = _recent(rows, filings, years) if years else rows
    order = [F.col("annual_salary"), F.desc("decision_date"), F.col("employer_fein"), F.col("job_title"), F.col("soc_code"), F.col("wage_unit_of_pay"), F.col("wage_rate_of_pay_from")]
    return _first(rows, order, places).select("consolidation_key", "place", "employer_fein", "job_title", "soc_code", "soc_title", "decision_date", "wage_rate_of_pay_from", "wage_unit_of_pay", "annual_salary")


def below_salary(filings: DataFrame, units: DataFrame, target_soc: DataFrame, limit: int = 90_000, years: int = 3, places: int = 20) -> DataFrame:
    """Per unit, the titles with most filings of target occupations under the limit in the last years, their lowest and highest salary."""
    rows = _recent(_target_salaries(filings, units, target_soc).where(F.col("annual_salary") < limit), filings, years)
    counted = rows.groupBy("consolidation_key", "job_title", "soc_title").agg(F.count("*").alias("filings_under"), F.min("annual_salary").alias("min_salary"), F.max("annual_salary").alias("max_salary"))
    return _first(counted, [F.desc("filings_under"), F.col("min_salary"), F.col("job_title"), F.col("soc_title")], places)


def posting_totals(postings: DataFrame) -> DataFrame:
    """One row: postings, active and closed ones, and distinct titles; titles are grouped first."""
    titles = postings.groupBy("normalized_title").agg(F.count("*").alias("n"), F.count_if("active").alias("a"), F.count_if(~F.col("active")).alias("c"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return titles.agg(total("n").alias("total_posting_rows"), total("a").alias("active_rows"), total("c").alias("closed_rows"), F.count("normalized_title").alias("distinct_titles"), F.count_if((F.col("a") > 0) & F.col("normalized_title").isNotNull()).alias("active_distinct_titles"))


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select("normalized_title", F.col("classification_status").alias("status"))
    return postings.join(known, "normalized_title", "left").withColumn("role_status", F.coalesce("status", F.lit("review"))).drop("status")


def posting_mix(postings: DataFrame, labels: DataFrame, ref_date: str) -> DataFrame:
    """All postings by their title's decision: jobs, active and closed ones, distinct titles and companies; and of the active US ones of the year the same.

    Titles' companies are grouped first, so that distinct ones are counted over few rows.
    """
    rows = _labelled(postings, labels).withColumn("us", is_posting_us(ref_date))
    pairs = rows.groupBy("role_status", "normalized_title", "consolidation_key").agg(F.count("*").alias("n"), F.count_if("active").alias("a"), F.count_if(~F.col("active")).alias("c"), F.count_if("us").alias("u"))
    us = lambda c: F.when(F.col("u") > 0, F.col(c))
    return pairs.groupBy("role_status").agg(
        F.sum("n").alias("jobs"), F.sum("a").alias("active_jobs"), F.sum("c").alias("closed_jobs"), F.count_distinct("normalized_title").alias("titles"), F.count_distinct("consolidation_key").alias("companies"),
        F.sum("u").alias("us_active_jobs"), F.count_distinct(us("normalized_title")).alias("us_titles"), F.count_distinct(us("consolidation_key")).alias("us_companies"),
    )


def calendar_counts(surface: DataFrame, labels: DataFrame, now: str, days: int = 14) -> DataFrame:
    """US postings by each of the last local days: new, closed, seen, and new ones by decision. A posting counts for at most three days."""
    first, closed, seen = (local_date(F.col(c)) for c in ("first_seen_at", "closed_at", "last_seen_at"))
    dated = _labelled(surface, labels).select("role_status", first.alias("first"), closed.alias("closed"), seen.alias("seen"))
    each = dated.select("*", F.explode(F.array_distinct(F.filter(F.array("first", "closed", "seen"), lambda d: d.isNotNull()))).alias("day"))
    new = F.col("first") == F.col("day")
    counted = each.groupBy("day").agg(
        F.count_if(new).alias("new_rows"), F.count_if(F.col("closed") == F.col("day")).alias("closed_rows"), F.count_if(F.col("seen") == F.col("day")).alias("seen_rows"),
        F.count_if(new & (F.col("role_status") == "target")).alias("new_target_rows"), F.count_if(new & (F.col("role_status") == "review")).alias("new_review_rows"),
    )
    today = local_date(F.lit(now).cast("timestamp"))
    calendar = surface.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day"))
    return calendar.join(counted, "day", "left").na.fill(0)


def label_changes(history: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Label changes of the last days by local day, who made them, and the new status."""
    recent = history.where(F.col("changed_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(local_date(F.col("changed_at")).alias("changed_day"), "labeled_by", "new_status").agg(F.count("*").alias("labels_changed"))


def label_versions(labels: DataFrame) -> DataFrame:
    """Labelled titles by status and version of the rules."""
    return labels.groupBy("classification_status", F.coalesce("rule_version", F.lit("manual_or_unknown")).alias("rule_version")).agg(F.count("*").alias("titles"))


def model_averages(predictions: DataFrame, places: int = 20) -> DataFrame:
    """Predictions by model, status and whether they were applied, with their mean confidence; the newest models first."""
    g = predictions.groupBy("model_version", F.col("classification_status").alias("predicted_status"), "applied").agg(F.count("*").alias("titles"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))
    return g.orderBy(F.desc("model_version"), F.desc("applied"), F.desc("titles"), "predicted_status").limit(places)


def evidence_only(filings: DataFrame, members: DataFrame, target_soc: DataFrame, targets: DataFrame, kind: tuple[str, str] = CHIEF) -> DataFrame:
    """Enabled targets by tier whose one target occupation is ``kind`` (code, title): it occurs, and no other active code does.

    members: (consolidation_key, fein) of every unit. One pass over filings gives both flags of an employer.
    """
    code, title = kind
    codes = target_soc.where("active").where(F.col("normalized_soc_code") != code).select("normalized_soc_code", F.lit(True).alias("other")).distinct()
    rows = filings.select(F.col("employer_fein").alias("fein"), normalize_soc_code(F.col("soc_code")).alias("normalized_soc_code"), "soc_title").join(F.broadcast(codes), "normalized_soc_code", "left")
    this = (F.coalesce(F.col("normalized_soc_code") == code, F.lit(False))) | F.coalesce(F.lower("soc_title") == title, F.lit(False))
    employers = rows.groupBy("fein").agg(F.bool_or(this).alias("this"), F.bool_or(F.coalesce("other", F.lit(False))).alias("other"))
    units = employers.join(members, "fein").groupBy("consolidation_key").agg(F.bool_or("this").alias("this"), F.bool_or("other").alias("other")).where("this AND NOT other")
    return targets.where("enabled").join(units, "consolidation_key", "left_semi").groupBy("priority_tier").agg(F.count("*").alias("companies"))


def discovery_features(targets: DataFrame, sites: DataFrame, source: str) -> DataFrame:
    """Per target, what one search service has left: candidates by kind, best score, services, and the first candidate's columns."""
    order = F.struct(F.col("candidate_rank").isNull(), "candidate_rank", -F.coalesce(F.col("candidate_score"), F.lit(float("-inf"))), "site_id")
    first = F.struct("site_url", F.col("normalized_domain").alias("domain"), "source_type", "evidence_title", "evidence_snippet")
    g = sites.where(F.col("discovery_source") == source).groupBy("consolidation_key").agg(
        F.count("*").alias("retained"), F.count_if(F.col("source_type") != "generic_html").alias("structured"), F.count_if(_verified()).alias("verified"), F.bool_or(F.col("last_success_at").isNotNull()).alias("has_successful_crawl"),
        F.max("candidate_score").alias("best_candidate_score"), F.sort_array(F.collect_set("source_type")).alias("types"), F.min_by(first, order).alias("first"),
    )
    rows = targets.select("consolidation_key", "last_discovery_at").join(g, "consolidation_key", "left")
    return rows.select(
        "consolidation_key", F.col("last_discovery_at").isNotNull().alias("searched"), F.col("last_discovery_at").alias("last_searched_at"),
        *(_none(a).cast("int").alias(b) for a, b in (("retained", "retained_candidate_count"), ("structured", "structured_candidate_count"), ("verified", "verified_candidate_count"))),
        _none("has_successful_crawl", False).alias("has_successful_crawl"), "best_candidate_score", F.coalesce(F.array_join("types", ","), F.lit("")).alias("candidate_source_types"),
        *(F.col(f"first.{c}").alias(f"rank1_{c}") for c in ("site_url", "domain", "source_type", "evidence_title", "evidence_snippet")),
    )


def pilot_sites(targets: DataFrame, sites: DataFrame, tier: str = "P1", places: int = 25) -> DataFrame:
    """The first places of a pilot: each company's best plain career page, if it is among the best pages of all.

    Both ranks run over all eligible pages. The global one is taken by a sort with a limit, not in one task.
    """
    done = sites.where(_open()).select("consolidation_key").distinct()
    url = F.lower("site_url")
    plain = sites.where((F.col("source_type") == "generic_html") & _unverified() & ~F.col("crawl_enabled") & (url.contains("/career") | url.contains("/job")))
    rows = plain.join(targets.where(F.col("enabled") & (F.col("priority_tier") == tier)).select("consolidation_key", "priority_tier", "priority_score"), "consolidation_key").join(done, "consolidation_key", "left_anti")
    own = F.struct(-F.coalesce(F.col("candidate_score"), F.lit(float("-inf"))), F.col("candidate_rank").isNull(), "candidate_rank", "site_id")
    best = rows.groupBy("consolidation_key").agg(F.min_by("site_id", own).alias("site_id"))
    first = rows.orderBy(F.col("priority_score").desc_nulls_first(), F.col("candidate_score").desc_nulls_last(), "site_id").limit(places).select("site_id", "priority_tier")
    return first.join(best, "site_id", "left_semi")
