"""Registered status reports, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.market import market_scope
from hirelake.functions.titles import PRODUCT_ROLES
from hirelake.functions.urls import CAREER_PATH, MISSED
from hirelake.operators import status
from hirelake.operators.activity import ZONE
from hirelake.operators.dashboard import postings_us
from hirelake.operators.filings import employer_filing_stats
from hirelake.operators.scoring import score_companies
from hirelake.operators.sites import schedule_queue
from hirelake.plans.catalog import _LOW, _PRODUCT, _SALARY, _SOC, SCOPE
from hirelake.plans.companies import _QUEUE, FEIN, SITE_ROWS, STATUS, TARGETS, _matched, consolidated_scores
from hirelake.plans.companies import ORACLES as COMPANY_SQL
from hirelake.plans.fixtures import AS_OF, FILINGS, RUNS, SOCS, SOURCES, SPLIT, TARGET_SOC, TITLES, pick, view
from hirelake.plans.jobs import _CURRENT, _PATTERN, HOSTS, JOBS, LABEL_ROWS, PATHS
from hirelake.plans.reports import UNITS

NOW = "2024-01-25 18:00:00"
SOC_TITLES = tuple(zip(TARGET_SOC, ("Software Developers", "Architects", "Data Scientists", "Managers", "Marketing"), strict=True))
ERRORS = ("HTTPError: HTTP Error 429: Too Many", "HTTPError: HTTP Error 432", "httperror: http error 503", "URLError: no route", "TimeoutError: read", "HTTPError: HTTP Error 404", "boom", None)
ATTEMPTS = f"""
SELECT concat('run-', CAST(user_id % 40 AS varchar(9))) AS run_id, {pick(('p0', 'p1', None), 'user_id')} AS cohort, user_id % 5 <> 0 AND (user_id % 5 < 3 OR event_type <> 'error') AS search_succeeded,
       CASE WHEN user_id % 5 = 1 THEN 1 + event_id % 3 ELSE event_id % 4 END AS candidate_count, {pick(ERRORS, 'event_id')} AS error_message, ts AS attempted_at FROM events"""
SEARCHES = f"""
SELECT event_id AS run_id, {pick(('p0', 'p1', 'sample'), 'user_id')} AS cohort, event_id % 9 AS target_count, event_id % 17 AS candidate_count, event_id % 3 AS error_count, event_id % 4 AS estimated_credits, ts AS started_at FROM events"""
SITES = (
    SITE_ROWS.replace(FEIN.format("page_id % 60"), FEIN.format("page_id % 97 * 3")).replace("page_id % 5 <> 1 AS crawl_enabled", "page_id % 7 = 1 AS crawl_enabled")
    .replace(pick(STATUS, "page_id"), pick(("unverified", "verified", "verified", "unverified", "rejected", "unverified", "unverified"), "page_id"))
    .replace(pick(SOURCES, "page_id"), pick((*SOURCES, "generic_html", "generic_html", "generic_html"), "page_id"))
    .replace(" FROM pages", f""", concat('https://', {pick(HOSTS, 'page_id')}, {pick((*PATHS, '/en-us/jobs/7', '/Jobs/list?x=1', '/join-us', '/p/12ab/34'), 'page_id % 77')}) AS site_url, CASE WHEN page_id % 4 = 0 THEN NULL ELSE {pick(HOSTS, 'page_id')} END AS normalized_domain,
       {pick(('system:auto_trust', 'ann', None), 'page_id')} AS reviewed_by, CAST({pick((None, '2024-01-28 00:00:00', '2024-01-30 00:00:00'), 'page_id')} AS timestamp) AS last_crawled_at, CASE WHEN page_id % 6 = 5 THEN NULL ELSE CAST(page_id * 37 % 100 AS double) END AS candidate_score,
       {pick(('web_search', 'web_search', 'by_hand'), 'page_id')} AS discovery_source, concat('Jobs ', CAST(page_id AS varchar(20))) AS evidence_title, CASE WHEN page_id % 2 = 0 THEN 'seen' END AS evidence_snippet FROM pages""")
)
WIDE_TARGETS = TARGETS.replace(" FROM customer", f", {pick(('pending', 'found', 'not_found'), 'c_custkey')} AS discovery_status, CAST({pick((None, '2024-01-10 00:00:00', '2024-01-11 00:00:00'), 'c_custkey')} AS timestamp) AS last_discovery_at FROM customer")
WIDE_RUNS = RUNS.replace("user_id % 20 AS site_id", "user_id % 90 AS site_id").replace(" FROM events", ", event_id % 7 AS new_job_count, event_id % 5 AS closed_job_count, event_id % 11 AS target_job_count, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 END AS review_job_count FROM events")
#: Employers of product roles only, of mostly such, and of all kinds; and employers of one occupation.
COHORTS = FILINGS.replace(
    pick(TITLES, "l.l_partkey"),
    f"CASE o.o_custkey % 4 WHEN 0 THEN {pick(('Product Manager', 'Senior Product Manager'), 'o.o_custkey % 8')} WHEN 1 THEN CASE WHEN l.l_partkey % 10 = 0 THEN 'Warehouse Associate' ELSE {pick(('Product Manager', 'Senior Product Manager', 'Technical Program Manager'), 'l.l_partkey')} END ELSE {pick(TITLES, 'l.l_partkey')} END",
)
CHIEFS = FILINGS.replace(pick(SOCS, "l.l_partkey"), f"CASE WHEN o.o_custkey % 5 = 0 THEN '11-1011' ELSE {pick(SOCS, 'l.l_partkey')} END").replace(" AS soc_code,", " AS soc_code, CASE WHEN l.l_partkey % 7 = 0 AND o.o_custkey % 5 = 0 THEN 'Chief Executives' END AS soc_title,")
HISTORY = f"SELECT ts AS changed_at, {pick(('manual', 'rules-v2', None), 'event_id')} AS labeled_by, {pick(('review', 'target', 'non_target'), 'user_id')} AS new_status FROM events"
PREDICTIONS = f"SELECT {pick(('v4', 'v5', 'v3'), 'user_id')} AS model_version, {pick(('target', 'non_target'), 'event_id')} AS classification_status, event_id % 3 = 0 AS applied, CAST(event_id % 101 AS double) / 100 AS confidence FROM events"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SITES, "pages")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, WIDE_TARGETS, "customer")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule_queue(_sites(spark, sf_dir), _targets(spark, sf_dir), AS_OF)


def _soc(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*x, True) for x in SOC_TITLES], "normalized_soc_code string, representative_title string, active boolean")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, UNITS, "customer").groupBy("consolidation_key").agg(F.collect_set("fein").alias("member_feins"))


def _filings(spark: SparkSession, sf_dir: str, sql: str = FILINGS) -> DataFrame:
    return view(spark, sf_dir, sql, "lineitem", "orders")


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies, matches = _matched(spark, sf_dir)
    return score_companies(companies, employer_filing_stats(_filings(spark, sf_dir, COHORTS), _soc(spark)), matches)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, JOBS, "events").withColumn("market_scope", market_scope(F.col("location")))


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings_us(_jobs(spark, sf_dir), SPLIT[:10])


def attempt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.attempt_summary(view(spark, sf_dir, ATTEMPTS, "events"))


def credits_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.credits_by_day(view(spark, sf_dir, SEARCHES, "events"))


def paid_runs_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.paid_runs_of_day(view(spark, sf_dir, SEARCHES, "events"), NOW)


def crawl_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.crawl_funnel(consolidated_scores(spark, sf_dir), _targets(spark, sf_dir), _sites(spark, sf_dir), _queue(spark, sf_dir))


def coverage_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.coverage_by_tier(_targets(spark, sf_dir), _sites(spark, sf_dir), _queue(spark, sf_dir))


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.review_progress(_targets(spark, sf_dir), _sites(spark, sf_dir))


def crawl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.crawl_state(_targets(spark, sf_dir), _sites(spark, sf_dir), _queue(spark, sf_dir))


def blocked_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.blocked_templates(_targets(spark, sf_dir), _sites(spark, sf_dir))


def today_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.today_progress(view(spark, sf_dir, WIDE_RUNS, "events"), _sites(spark, sf_dir), _targets(spark, sf_dir), NOW)


def pool_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.pool_breakdown(consolidated_scores(spark, sf_dir), _targets(spark, sf_dir))


def outside_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.outside_reasons(consolidated_scores(spark, sf_dir), _targets(spark, sf_dir))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.score_histogram(consolidated_scores(spark, sf_dir))


def component_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.component_patterns(consolidated_scores(spark, sf_dir), "3.0")


def component_patterns_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.component_patterns(consolidated_scores(spark, sf_dir), "2.0")


def product_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.product_share(_shares(spark, sf_dir))


def product_share_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.product_share_buckets(_shares(spark, sf_dir))


def product_share_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.product_share_sizes(_shares(spark, sf_dir))


def product_share_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.product_share_patterns(_shares(spark, sf_dir), _filings(spark, sf_dir, COHORTS))


def product_share_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.product_share_titles(_shares(spark, sf_dir), _filings(spark, sf_dir, COHORTS))


def lowest_salaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.lowest_salaries(_filings(spark, sf_dir), _units(spark, sf_dir), _soc(spark))


def least_salaries_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.lowest_salaries(_filings(spark, sf_dir), _units(spark, sf_dir), _soc(spark), None, None, 15)


def below_salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.below_salary(_filings(spark, sf_dir), _units(spark, sf_dir), _soc(spark))


def posting_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.posting_totals(view(spark, sf_dir, JOBS, "events"))


def posting_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.posting_mix(_jobs(spark, sf_dir), spark.sql(LABEL_ROWS), SPLIT[:10])


def calendar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.calendar_counts(_surface(spark, sf_dir), spark.sql(LABEL_ROWS), NOW)


def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.label_changes(view(spark, sf_dir, HISTORY, "events"), NOW)


def label_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = view(spark, sf_dir, JOBS, "events").select("normalized_title").distinct()
    return status.label_versions(spark.sql(LABEL_ROWS).join(used, "normalized_title", "left_semi"))


def model_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.model_averages(view(spark, sf_dir, PREDICTIONS, "events"))


def evidence_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = view(spark, sf_dir, TARGETS, "customer").select("consolidation_key", F.col("consolidation_key").alias("fein"))
    return status.evidence_only(_filings(spark, sf_dir, CHIEFS), members, _soc(spark), _targets(spark, sf_dir))


def discovery_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.discovery_features(_targets(spark, sf_dir), _sites(spark, sf_dir), "web_search")


def pilot_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.pilot_sites(_targets(spark, sf_dir), _sites(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        attempt_summary, credits_by_day, paid_runs_of_day, crawl_funnel, coverage_by_tier, review_progress, crawl_state, blocked_templates, today_progress, pool_breakdown, outside_reasons, score_histogram,
        component_patterns, component_patterns_of_two, product_share, product_share_buckets, product_share_sizes, product_share_patterns, product_share_titles, lowest_salaries, least_salaries_ever, below_salary, posting_totals,
        posting_mix, calendar_counts, label_changes, label_versions, model_averages, evidence_only, discovery_features, pilot_sites,
    )
}

_local = f"timezone('{ZONE}', timezone('UTC', CAST({{}} AS timestamp)))"
_day = f"CAST({_local} AS date)"
_T = f"t AS ({WIDE_TARGETS}), s AS ({SITES})"
_Q = _QUEUE.replace(SITE_ROWS, SITES).replace("crawl_status\n", "crawl_status, last_crawled_at\n")
_TIERS = f"priority_tier IN {status.TIERS!r}"
_V, _U = "verification_status = 'verified'", "verification_status = 'unverified'"
_O = f"{_V} AND crawl_enabled"
_ROLLUP = f"""
r AS (SELECT consolidation_key, bool_or({_V}) AS has_verified_site, bool_or({_O}) AS has_enabled_site, bool_or({_O} AND last_crawled_at IS NOT NULL) AS has_attempt, bool_or({_O} AND last_success_at IS NOT NULL) AS has_success,
             bool_or({_O} AND crawl_status = 'failed') AS has_failed, count(*) FILTER ({_U} AND source_type = 'generic_html') AS generic_candidates, count(*) FILTER ({_U} AND source_type <> 'generic_html') AS structured_candidates,
             count(*) FILTER ({_U}) AS unverified_candidates, count(*) FILTER (verification_status = 'rejected') AS rejected_candidates FROM s GROUP BY 1)"""
_SCORES = f"c AS ({COMPANY_SQL['consolidated_scores']})"
_SHARES = f"c AS ({COMPANY_SQL['company_scores'].replace(FILINGS, COHORTS)})"
_SURFACE = f"j AS (SELECT *, {SCOPE} AS market_scope FROM ({JOBS})), p AS (SELECT j.*, coalesce(classification_status, 'review') AS role FROM j LEFT JOIN ({LABEL_ROWS}) l USING (normalized_title) WHERE active AND market_scope = 'US' AND {_CURRENT})"
_POOL = f"{_SCORES}, t AS ({WIDE_TARGETS}), b AS (SELECT c.*, coalesce(t.enabled, false) AND coalesce(t.priority_tier IN ('P0', 'P1', 'P2'), false) AS inside FROM c LEFT JOIN t USING (consolidation_key))"
_SOC_TITLE = f"CASE {_SOC} {' '.join(f'WHEN {a!r} THEN {b!r}' for a, b in SOC_TITLES)} END"
_PAID = f"f AS (SELECT * FROM (SELECT *, {_SALARY} AS annual_salary, {_SOC_TITLE} AS soc_title FROM ({FILINGS})) JOIN (SELECT consolidation_key, fein AS employer_fein FROM ({UNITS})) u USING (employer_fein) WHERE annual_salary IS NOT NULL AND soc_title IS NOT NULL)"
_LATE = f"decision_date >= CAST((SELECT max(decision_date) FROM ({FILINGS})) - INTERVAL 36 MONTH AS date)"
_LOWEST = "SELECT consolidation_key, CAST(row_number() OVER (PARTITION BY consolidation_key ORDER BY annual_salary, decision_date DESC, employer_fein, job_title, soc_code, wage_unit_of_pay, wage_rate_of_pay_from) AS integer) AS place, employer_fein, job_title, soc_code, soc_title, decision_date, wage_rate_of_pay_from, wage_unit_of_pay, annual_salary FROM f"
_PASSING = " OR ".join(f"error_message ILIKE '{e}%'" for e in status.TRANSIENT)
_CATEGORY = f"CASE WHEN {_PRODUCT} THEN CASE {' '.join(f'WHEN contains({_LOW}, {p!r}) THEN {c!r}' for c, p in PRODUCT_ROLES)} END END"


def _bands(column: str, *bands: tuple[str, str], last: str) -> str:
    return f"CASE {' '.join(f'WHEN {column} {test} THEN {name!r}' for test, name in bands)} ELSE {last!r} END"


_BUCKET = _bands("priority_score", ("= 0", "0"), ("<= 1", "0-1"), ("<= 2", "1-2"), ("<= 3", "2-3"), ("<= 4", "3-4"), ("<= 5", "4-5"), last="5+")
_SHARE_BAND = _bands("product_role_lca_pct", ("= 0", "0%"), ("<= 10", "1-10%"), ("<= 25", "11-25%"), ("<= 50", "26-50%"), ("<= 75", "51-75%"), last="76-100%")
_SIZE_BAND = _bands("lca_count", ("= 1", "1 filing"), ("BETWEEN 2 AND 5", "2-5 filings"), ("BETWEEN 6 AND 20", "6-20 filings"), last="21+ filings")
_FAMILY = f"CASE {' '.join(f'WHEN host LIKE {p!r} THEN {n + "_domain_missed"!r}' for p, n in MISSED)} WHEN regexp_matches(path, '{CAREER_PATH}') THEN 'corporate_careers_page' ELSE 'generic_or_corporate_page' END"

ORACLES = {
    "attempt_summary": f"""
WITH g AS (SELECT run_id, cohort, count(*) AS companies, count(*) FILTER (search_succeeded) AS succeeded_searches, count(*) FILTER (search_succeeded AND candidate_count > 0) AS searches_with_candidates,
  count(*) FILTER (search_succeeded AND candidate_count = 0) AS searched_no_candidate, count(*) FILTER (NOT search_succeeded) AS failed_searches, count(*) FILTER (NOT search_succeeded AND ({_PASSING})) AS transient_failures,
  min(attempted_at) AS first_attempted_at, max(attempted_at) AS last_attempted_at FROM ({ATTEMPTS}) GROUP BY run_id, cohort)
SELECT *, CASE WHEN companies > 0 AND failed_searches = companies THEN 'full_batch_failed' WHEN failed_searches > 0 THEN 'partial_failures' WHEN searched_no_candidate > 0 THEN 'completed_with_no_candidate' ELSE 'completed_with_candidates' END AS run_quality FROM g""",
    "credits_by_day": f"""
SELECT {_day.format('started_at')} AS local_day, cohort, count(*) AS runs, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('target_count', 'candidate_count', 'error_count', 'estimated_credits'))}, min({_local.format('started_at')}) AS first_run_at, max({_local.format('started_at')}) AS last_run_at
FROM ({SEARCHES}) WHERE estimated_credits > 0 GROUP BY 1, 2""",
    "paid_runs_of_day": f"SELECT run_id, cohort, target_count, candidate_count, error_count, estimated_credits, {_local.format('started_at')} AS started_local FROM ({SEARCHES}) WHERE estimated_credits > 0 AND {_day.format('started_at')} = {_day.format(f"TIMESTAMP '{NOW}'")}",
    "crawl_funnel": f"""
WITH {_SCORES}, {_T}, {_Q}
SELECT (SELECT count(*) FROM c) AS all_companies, (SELECT count(*) FROM c WHERE target_role_score = 1) AS target_soc_companies, {', '.join(f"(SELECT count(*) FROM c WHERE crawl_priority_tier = '{t}') AS {t.lower()}_companies" for t in status.TIERS)},
  (SELECT count(*) FROM t WHERE enabled) AS enabled_targets, (SELECT count(DISTINCT consolidation_key) FROM s WHERE {_U}) AS companies_with_candidates, (SELECT count(DISTINCT consolidation_key) FROM s WHERE {_V}) AS companies_with_verified_site,
  (SELECT count(*) FROM s WHERE {_V} AND target_country_code = 'US' AND scope_method <> 'unknown') AS us_ready_sites, (SELECT count(*) FROM s WHERE {_V} AND source_type IN {status.SUPPORTED!r}) AS adapter_supported_sites,
  (SELECT count(*) FROM queue) AS schedulable_sites, (SELECT count(*) FROM queue WHERE is_due) AS due_sites, (SELECT count(*) FROM queue WHERE last_crawled_at IS NULL) AS never_crawled_schedulable_sites""",
    "coverage_by_tier": f"""
WITH {_T}, {_Q}, a AS (SELECT priority_tier, count(*) AS companies FROM t WHERE enabled AND {_TIERS} GROUP BY 1),
b AS (SELECT priority_tier, count(DISTINCT s.consolidation_key) FILTER ({_U}) AS companies_with_candidates, count(DISTINCT s.consolidation_key) FILTER ({_V}) AS companies_with_verified_site,
  count(DISTINCT s.consolidation_key) FILTER ({_V} AND coalesce(reviewed_by, '') NOT LIKE 'system:%') AS human_verified_companies, count(DISTINCT s.consolidation_key) FILTER ({_V} AND reviewed_by LIKE 'system:%') AS auto_trusted_companies,
  count(*) FILTER ({_O}) AS verified_enabled_sites FROM s JOIN t USING (consolidation_key) WHERE enabled AND {_TIERS} GROUP BY 1),
d AS (SELECT priority_tier, count(*) AS schedulable_sites, count(*) FILTER (is_due) AS due_now, count(*) FILTER (last_crawled_at IS NULL) AS never_crawled FROM queue GROUP BY 1)
SELECT priority_tier, companies, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('companies_with_candidates', 'companies_with_verified_site', 'human_verified_companies', 'auto_trusted_companies', 'verified_enabled_sites', 'schedulable_sites', 'due_now', 'never_crawled'))},
  round(coalesce(companies_with_verified_site, 0) / companies, 4) AS verified_company_rate FROM a LEFT JOIN b USING (priority_tier) LEFT JOIN d USING (priority_tier)""",
    "review_progress": f"""
WITH {_T}, {_ROLLUP}, g AS (SELECT priority_tier, count(*) AS companies, count(*) FILTER (coalesce(has_verified_site, false)) AS site_reviewed_verified, count(*) FILTER (coalesce(unverified_candidates, 0) > 0) AS waiting_site_review,
  count(*) FILTER (coalesce(has_enabled_site, false)) AS can_crawl, count(*) FILTER (coalesce(has_attempt, false)) AS crawled_at_least_once, count(*) FILTER (coalesce(has_success, false)) AS crawled_successfully,
  count(*) FILTER (NOT coalesce(has_verified_site, false) AND coalesce(unverified_candidates, 0) = 0) AS no_site_candidate_yet, count(*) FILTER (coalesce(rejected_candidates, 0) > 0) AS has_rejected_candidates
  FROM t LEFT JOIN r USING (consolidation_key) WHERE enabled AND {_TIERS} GROUP BY 1)
SELECT *, round(100.0 * CAST(site_reviewed_verified AS double) / companies, 2) AS verified_pct, round(100.0 * CAST(crawled_successfully AS double) / companies, 2) AS success_pct FROM g""",
    "crawl_state": f"""
WITH {_T}, {_Q}, {_ROLLUP}, d AS (SELECT consolidation_key, count(*) FILTER (is_due) AS due_sites FROM queue GROUP BY 1),
x AS (SELECT t.priority_tier, CASE WHEN coalesce(has_success, false) THEN '01 successfully crawled' WHEN coalesce(has_failed, false) THEN '02 adapter/site failed' WHEN coalesce(due_sites, 0) > 0 THEN '03 enabled and due' WHEN coalesce(has_enabled_site, false) THEN '04 enabled not due'
  WHEN coalesce(structured_candidates, 0) > 0 THEN '05 structured candidate not enabled' WHEN coalesce(generic_candidates, 0) > 0 THEN '06 generic HTML needs resolution' WHEN discovery_status = 'pending' THEN '07 not searched yet' ELSE '08 searched no usable candidate' END AS crawl_state
  FROM t LEFT JOIN r USING (consolidation_key) LEFT JOIN d USING (consolidation_key) WHERE enabled AND t.{_TIERS})
SELECT priority_tier, crawl_state, count(*) AS companies, round(100.0 * CAST(count(*) AS double) / sum(count(*)) OVER (PARTITION BY priority_tier), 2) AS pct_within_tier FROM x GROUP BY 1, 2""",
    "blocked_templates": f"""
WITH {_T}, {_ROLLUP}, g AS (SELECT priority_tier, s.consolidation_key, lower(regexp_replace(coalesce(normalized_domain, split_part(regexp_replace(site_url, '^https?://', ''), '/', 1)), '^www\\.', '')) AS host, lower(regexp_replace(regexp_replace(site_url, '^https?://[^/]+', ''), '[?#].*$', '')) AS path
  FROM s JOIN t USING (consolidation_key) LEFT JOIN r USING (consolidation_key) WHERE enabled AND {_TIERS} AND source_type = 'generic_html' AND {_U} AND NOT crawl_enabled AND NOT coalesce(has_enabled_site, false) AND NOT coalesce(has_success, false))
SELECT priority_tier, {_FAMILY} AS template_family, {_PATTERN} AS path_pattern, count(DISTINCT consolidation_key) AS companies, count(*) AS site_rows FROM g GROUP BY 1, 2, 3""",
    "today_progress": f"""
WITH {_T} SELECT priority_tier, count(*) AS site_attempts_today, count(DISTINCT consolidation_key) AS companies_attempted_today, count(DISTINCT consolidation_key) FILTER (status = 'succeeded') AS companies_succeeded_today, count(*) FILTER (status = 'failed') AS failed_site_attempts_today,
  {', '.join(f'CAST(coalesce(sum({k}_job_count), 0) AS BIGINT) AS {k}_jobs_today' for k in ('parsed', 'new', 'closed', 'target', 'review'))}
FROM ({WIDE_RUNS}) r JOIN (SELECT site_id, consolidation_key FROM s) USING (site_id) JOIN t USING (consolidation_key) WHERE {_day.format('started_at')} >= {_day.format(f"TIMESTAMP '{NOW}'")} AND {_TIERS} GROUP BY 1""",
    "pool_breakdown": f"""
WITH {_POOL} SELECT CASE WHEN inside THEN 'in_enabled_p_pool' ELSE 'outside_enabled_p_pool' END AS pool, count(*) AS companies, count(*) FILTER (recent_lca) AS recent_lca, count(*) FILTER (target_role_lca_count > 0) AS has_target_lca_rows, count(*) FILTER (salary_score > 0) AS has_salary_score,
  count(*) FILTER (executive_only_excluded) AS executive_only_excluded, round(CAST(sum(priority_score) AS double) / count(*), 3) AS avg_priority_score FROM b GROUP BY 1""",
    "outside_reasons": f"""
WITH {_POOL} SELECT CASE WHEN executive_only_excluded THEN 'executive_only_excluded' WHEN coalesce(target_role_lca_count, 0) = 0 AND coalesce(target_role_score, 0) = 0 THEN 'no_target_soc_role_signal' WHEN coalesce(priority_score, 0) < 2 THEN 'has_target_signal_but_score_below_p2' ELSE 'other_not_in_enabled_pool' END AS outside_reason,
  count(*) AS companies, count(*) FILTER (recent_lca) AS recent_lca, count(*) FILTER (lca_count >= 5) AS lca_ge_5, count(*) FILTER (target_role_lca_count > 0) AS has_target_lca_rows FROM b WHERE NOT inside GROUP BY 1""",
    "score_histogram": f"WITH {_SCORES} SELECT {_BUCKET} AS bucket, count(*) AS companies, min(priority_score) AS lowest FROM c GROUP BY 1",
    "component_patterns": f"WITH {_SCORES} SELECT {', '.join(status.SCORES)}, count(*) AS companies FROM c WHERE priority_score = 3.0 GROUP BY {', '.join(status.SCORES)} ORDER BY companies DESC, {', '.join(status.SCORES)} LIMIT 15",
    "component_patterns_of_two": f"WITH {_SCORES} SELECT {', '.join(status.SCORES)}, count(*) AS companies FROM c WHERE priority_score = 2.0 GROUP BY {', '.join(status.SCORES)} ORDER BY companies DESC, {', '.join(status.SCORES)} LIMIT 15",
    "product_share": f"""
WITH {_SHARES}, x AS (SELECT *, product_role_lca_pct = 100 AS full_share, product_role_lca_pct >= 76 AND product_role_lca_pct < 100 AS high FROM c WHERE target_role_score > 0)
SELECT count(*) FILTER (full_share) AS companies_at_100_pct, count(*) FILTER (high) AS companies_76_to_99_pct, count(*) FILTER (full_share OR high) AS companies_76_plus_pct,
  round(100.0 * CAST(count(*) FILTER (full_share AND single_lca_company) AS double) / nullif(count(*) FILTER (full_share), 0), 1) AS pct_single_at_100, round(100.0 * CAST(count(*) FILTER (high AND single_lca_company) AS double) / nullif(count(*) FILTER (high), 0), 1) AS pct_single_76_to_99 FROM x""",
    "product_share_buckets": f"WITH {_SHARES} SELECT {_SHARE_BAND} AS product_share_bucket, count(*) AS companies, round(100.0 * CAST(count(*) AS double) / sum(count(*)) OVER (), 1) AS pct_of_target_companies FROM c WHERE target_role_score > 0 GROUP BY 1",
    "product_share_sizes": f"WITH {_SHARES} SELECT {_SIZE_BAND} AS lca_count_bucket, count(*) AS companies, round(100.0 * CAST(count(*) AS double) / sum(count(*)) OVER (), 1) AS pct_of_100_pct_cohort FROM c WHERE target_role_score > 0 AND product_role_lca_pct = 100 GROUP BY 1",
    "product_share_patterns": f"""
WITH {_SHARES}, x AS (SELECT c.fein, any_value(lca_count) AS lca_count, count(DISTINCT job_title) AS titles, count(DISTINCT job_title) FILTER ({_PRODUCT}) AS product_titles FROM c JOIN ({COHORTS}) l ON l.employer_fein = c.fein WHERE target_role_score > 0 AND product_role_lca_pct >= 76 GROUP BY 1)
SELECT CASE WHEN titles = 1 THEN 'single raw job title total' WHEN product_titles = 1 THEN 'multiple titles, one product title' ELSE 'multiple product titles' END AS title_pattern, count(*) AS companies, round(CAST(sum(lca_count) AS double) / count(*), 1) AS avg_lca_count,
  round(100.0 * CAST(count(*) AS double) / sum(count(*)) OVER (), 1) AS pct_of_76_plus_cohort FROM x GROUP BY 1""",
    "product_share_titles": f"""
WITH {_SHARES}, x AS (SELECT CASE WHEN product_role_lca_pct = 100 THEN '100%' ELSE '76-99%' END AS cohort, job_title, count(DISTINCT fein) AS companies, count(*) AS filings, {_CATEGORY} AS category, round(100.0 * CAST(count(*) FILTER ({_PRODUCT}) AS double) / count(*), 1) AS pct_product_rows
  FROM c JOIN ({COHORTS}) l ON l.employer_fein = c.fein WHERE target_role_score > 0 AND product_role_lca_pct >= 76 GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY cohort ORDER BY companies DESC, filings DESC, job_title) AS integer) AS place FROM x QUALIFY place <= 20""",
    "lowest_salaries": f"WITH {_PAID} {_LOWEST} WHERE annual_salary < 90000 AND {_LATE} QUALIFY place <= 30",
    "least_salaries_ever": f"WITH {_PAID} {_LOWEST} QUALIFY place <= 15",
    "below_salary": f"""
WITH {_PAID}, g AS (SELECT consolidation_key, job_title, soc_title, count(*) AS filings_under, min(annual_salary) AS min_salary, max(annual_salary) AS max_salary FROM f WHERE annual_salary < 90000 AND {_LATE} GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY consolidation_key ORDER BY filings_under DESC, min_salary, job_title, soc_title) AS integer) AS place FROM g QUALIFY place <= 20""",
    "posting_totals": f"SELECT count(*) AS total_posting_rows, count(*) FILTER (active) AS active_rows, count(*) FILTER (NOT active) AS closed_rows, count(DISTINCT normalized_title) AS distinct_titles, count(DISTINCT normalized_title) FILTER (active) AS active_distinct_titles FROM ({JOBS})",
    "posting_mix": f"""
WITH j AS (SELECT *, {SCOPE} AS market_scope FROM ({JOBS})), p AS (SELECT j.*, coalesce(classification_status, 'review') AS role, active AND market_scope = 'US' AND {_CURRENT} AS us FROM j LEFT JOIN ({LABEL_ROWS}) l USING (normalized_title))
SELECT role AS role_status, count(*) AS jobs, count(*) FILTER (active) AS active_jobs, count(*) FILTER (NOT active) AS closed_jobs, count(DISTINCT normalized_title) AS titles, count(DISTINCT consolidation_key) AS companies,
  count(*) FILTER (us) AS us_active_jobs, count(DISTINCT normalized_title) FILTER (us) AS us_titles, count(DISTINCT consolidation_key) FILTER (us) AS us_companies FROM p GROUP BY 1""",
    "calendar_counts": f"""
WITH {_SURFACE}, x AS (SELECT role, {', '.join(f'{_day.format(c)} AS {c}' for c in ('first_seen_at', 'closed_at', 'last_seen_at'))} FROM p),
days AS (SELECT CAST(d AS date) AS day FROM generate_series({_day.format(f"TIMESTAMP '{NOW}'")} - INTERVAL 13 DAY, CAST({_day.format(f"TIMESTAMP '{NOW}'")} AS timestamp), INTERVAL 1 DAY) AS g(d))
SELECT day, count(*) FILTER (first_seen_at = day) AS new_rows, count(*) FILTER (closed_at = day) AS closed_rows, count(*) FILTER (last_seen_at = day) AS seen_rows, count(*) FILTER (first_seen_at = day AND role = 'target') AS new_target_rows, count(*) FILTER (first_seen_at = day AND role = 'review') AS new_review_rows
FROM days LEFT JOIN x ON first_seen_at = day OR closed_at = day OR last_seen_at = day GROUP BY day""",
    "label_changes": f"SELECT {_day.format('changed_at')} AS changed_day, labeled_by, new_status, count(*) AS labels_changed FROM ({HISTORY}) WHERE changed_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY 1, 2, 3",
    "label_versions": f"SELECT classification_status, coalesce(rule_version, 'manual_or_unknown') AS rule_version, count(*) AS titles FROM ({LABEL_ROWS}) WHERE normalized_title IN (SELECT normalized_title FROM ({JOBS})) GROUP BY 1, 2",
    "model_averages": f"SELECT model_version, classification_status AS predicted_status, applied, count(*) AS titles, round(avg(confidence), 3) AS avg_confidence FROM ({PREDICTIONS}) GROUP BY 1, 2, 3 ORDER BY model_version DESC, applied DESC, titles DESC, predicted_status LIMIT 20",
    "evidence_only": f"""
WITH f AS (SELECT *, {_SOC} AS code FROM ({CHIEFS})), this AS (SELECT DISTINCT employer_fein FROM f WHERE code = '11101100' OR lower(soc_title) = 'chief executives'), other AS (SELECT DISTINCT employer_fein FROM f WHERE code IN {TARGET_SOC!r} AND code <> '11101100')
SELECT priority_tier, count(*) AS companies FROM ({WIDE_TARGETS}) t WHERE enabled AND consolidation_key IN (SELECT employer_fein FROM this) AND consolidation_key NOT IN (SELECT employer_fein FROM other) GROUP BY 1""",
    "discovery_features": f"""
WITH {_T}, w AS (SELECT *, row_number() OVER (PARTITION BY consolidation_key ORDER BY candidate_rank NULLS LAST, candidate_score DESC NULLS LAST, site_id) AS k FROM s WHERE discovery_source = 'web_search')
SELECT consolidation_key, last_discovery_at IS NOT NULL AS searched, any_value(last_discovery_at) AS last_searched_at, CAST(count(site_id) AS integer) AS retained_candidate_count, CAST(count(site_id) FILTER (source_type <> 'generic_html') AS integer) AS structured_candidate_count,
  CAST(count(site_id) FILTER ({_V}) AS integer) AS verified_candidate_count, bool_or(last_success_at IS NOT NULL) AS has_successful_crawl, max(candidate_score) AS best_candidate_score, coalesce(string_agg(DISTINCT source_type, ',' ORDER BY source_type), '') AS candidate_source_types,
  max(site_url) FILTER (k = 1) AS rank1_site_url, max(normalized_domain) FILTER (k = 1) AS rank1_domain, max(source_type) FILTER (k = 1) AS rank1_source_type, max(evidence_title) FILTER (k = 1) AS rank1_evidence_title, max(evidence_snippet) FILTER (k = 1) AS rank1_evidence_snippet
FROM t LEFT JOIN w USING (consolidation_key) GROUP BY consolidation_key, last_discovery_at IS NOT NULL""",
    "pilot_sites": f"""
WITH {_T}, x AS (SELECT site_id, priority_tier, row_number() OVER (PARTITION BY consolidation_key ORDER BY candidate_score DESC NULLS LAST, candidate_rank NULLS LAST, site_id) AS site_rank, row_number() OVER (ORDER BY priority_score DESC, candidate_score DESC NULLS LAST, site_id) AS pilot_rank
  FROM s JOIN t USING (consolidation_key) WHERE enabled AND priority_tier = 'P1' AND source_type = 'generic_html' AND {_U} AND NOT crawl_enabled AND (site_url ILIKE '%/career%' OR site_url ILIKE '%/job%') AND consolidation_key NOT IN (SELECT consolidation_key FROM s WHERE {_O}))
SELECT site_id, priority_tier FROM x WHERE site_rank = 1 AND pilot_rank <= 25""",
}
