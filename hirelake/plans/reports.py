"""Registered reports on filings, postings, sites and runs, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.market import market_scope
from hirelake.functions.titles import EXECUTIVE, HIGH_SENIORITY, NEXT_ACTIONS, NOT_PRODUCT_V1, OTHER_ACTION, PRODUCT_ROLES, PRODUCT_V1, is_product_role_v1, next_action
from hirelake.operators import reports
from hirelake.operators.activity import ZONE
from hirelake.operators.sites import due_sites
from hirelake.plans.catalog import _LOW, _PRODUCT, _SALARY, _SOC, SCOPE
from hirelake.plans.companies import ALIASES, CITIES, COMPANIES, FEIN, HISTORY, LABELS, SEARCH_KEYS, SITE_ROWS, STATES, TARGETS, _companies, crawl_schedule
from hirelake.plans.companies import ORACLES as COMPANY_SQL
from hirelake.plans.companies import company_scores as _company_scores
from hirelake.plans.fixtures import AS_OF, ERRORS, FILINGS, RUNS, TARGET_SOC, TITLES, pick, view

NOW = "2024-01-25 18:00:00"
WIDE = FILINGS.replace(
    "CAST(l.l_shipdate AS date) AS decision_date",
    f"CAST(l.l_shipdate AS date) AS decision_date, CASE WHEN l.l_linestatus = 'O' THEN 'Certified' ELSE 'Withdrawn' END AS case_status, CAST(o.o_orderdate AS date) AS received_date, {pick(CITIES, 'l.l_suppkey')} AS worksite_city, {pick(STATES, 'l.l_suppkey')} AS worksite_state",
)
ATTEMPTS = f"""
SELECT concat('run-', CAST(user_id % 10 AS varchar(9))) AS run_id, {pick(('p0', 'p1', 'sample'), 'user_id')} AS cohort, event_type <> 'error' AS search_succeeded, event_id % 4 AS candidate_count,
       CASE WHEN event_type = 'error' THEN {pick(ERRORS, 'event_id')} END AS error_message, ts AS attempted_at FROM events"""
CHANGES = f"""
SELECT ts AS changed_at, {pick(('manual', 'model', None), 'event_id')} AS source, {pick(('review', 'target', 'non_target'), 'user_id')} AS classification_status, CAST(event_id % 100 AS integer) AS confidence FROM events"""
POSTINGS = f"SELECT h.*, first_seen_at AS last_seen_at, {FEIN.format('site_id % 60')} AS consolidation_key FROM ({HISTORY}) h"
APPEARANCES = f"SELECT {pick(('north', 'south', 'east'), 'c_nationkey')} AS region, concat('employer ', CAST(c_custkey % 40 AS varchar(9))) AS employer_name, CAST(c_custkey % 97 AS integer) AS rank FROM customer"
ACTION_ROWS = f"SELECT site_id, external_job_id, {pick(('saved', 'applied', None, 'dismissed', 'referred'), 'event_id')} AS action_status FROM ({HISTORY}) h"
UNITS = f"SELECT concat('unit-', CAST(c_custkey % 500 AS varchar(9))) AS consolidation_key, {FEIN.format('c_custkey')} AS fein, concat('Unit ', CAST(c_custkey % 500 AS varchar(9))) AS canonical_name FROM customer"
COMPONENTS = ["target_role_score", "lca_count_score", "chicago_score", "product_role_score", "product_manager_score", "linkedin_top_employer_score"]
TEXT = "amazon"


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, WIDE, "lineitem", "orders")


def _soc(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT explode(array({})) AS normalized_soc_code, true AS active".format(", ".join(map(repr, TARGET_SOC))))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POSTINGS, "events").withColumn("market_scope", market_scope(F.col("location")))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SITE_ROWS, "pages")


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TARGETS, "customer")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, UNITS, "customer").groupBy("consolidation_key", "canonical_name").agg(F.sort_array(F.collect_set("fein")).alias("member_feins"))


def salary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.salary_report(_filings(spark, sf_dir), F.col("worksite_state"))


def soc_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.soc_review_summary(_filings(spark, sf_dir))


def role_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.role_profile(_filings(spark, sf_dir), _units(spark, sf_dir), _soc(spark))


def product_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.product_titles(_filings(spark, sf_dir), 2)




def filings_by_year_and_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.filings_by_year_and_place(_filings(spark, sf_dir))



def product_v1_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filings(spark, sf_dir).where(is_product_role_v1(F.col("job_title"))).groupBy("job_title").agg(F.count("*").alias("filings"))







def label_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.label_log(view(spark, sf_dir, CHANGES, "events"))


def repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.repeat_runs(_sites(spark, sf_dir), view(spark, sf_dir, RUNS, "events"))






def rank_in_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rank_in_tier(_targets(spark, sf_dir), 25)


def page_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.page_of_targets(_targets(spark, sf_dir), 20, 30)


def company_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.company_lookup(_companies(spark, sf_dir), TEXT)


def never_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.never_searched(_targets(spark, sf_dir), _sites(spark, sf_dir), 50)


def scope_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scope_readiness(_sites(spark, sf_dir))


def review_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.review_details(_sites(spark, sf_dir))


def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.capped_sample(_postings(spark, sf_dir).select("site_id", "external_job_id", "title"), "title", ["site_id", "external_job_id"], 10)


def title_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.title_examples(_postings(spark, sf_dir))



def action_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.action_mix(view(spark, sf_dir, ACTION_ROWS, "events"))


def ranked_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ranked_appearances(view(spark, sf_dir, APPEARANCES, "customer"))


def employer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.employer_numbers(_companies(spark, sf_dir), view(spark, sf_dir, ALIASES, "customer"), TEXT)


def identity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.identity_search(_units(spark, sf_dir), _companies(spark, sf_dir), view(spark, sf_dir, ALIASES, "customer"), view(spark, sf_dir, SEARCH_KEYS, "customer"))


def due_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return due_sites(crawl_schedule(spark, sf_dir), 25).select("site_id", "priority_tier", "priority_score")


def failure_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, f"SELECT page_id AS site_id, {pick(ERRORS, 'page_id')} AS last_error FROM pages", "pages")
    return sites.groupBy(next_action(F.col("last_error")).alias("next_action")).agg(F.count("*").alias("sites"))


QUERIES = {
    f.__name__: f
    for f in (
        salary_report, soc_review_summary, role_profile, product_titles, filings_by_year_and_place, product_v1_filings,
        label_log, repeat_runs, rank_in_tier, page_of_targets, company_lookup, never_searched,
        scope_readiness, review_details, capped_sample, title_examples, action_mix, ranked_appearances, employer_numbers, identity_search, due_queue, failure_actions,
    )
}

_local = f"CAST(timezone('{ZONE}', timezone('UTC', CAST({{}} AS timestamp))) AS date)"
_NUM = f"f AS (SELECT *, CAST({_SALARY} AS double) AS salary, {_SOC} AS code FROM ({WIDE}))"
_POST = f"p AS (SELECT *, {SCOPE} AS market_scope FROM ({POSTINGS}))"
_TITLE = "regexp_matches(lower(coalesce(job_title, '')), '{}')"
_CATEGORY_SQL = COMPANY_SQL["company_scores"]
_V = "verification_status = 'verified'"
_DUE = f"({_V} AND crawl_enabled AND coalesce(next_crawl_at, TIMESTAMP '{AS_OF}') <= TIMESTAMP '{AS_OF}')"


def _categories() -> str:
    return f"CASE WHEN {_PRODUCT} THEN CASE {' '.join(f'WHEN contains({_LOW}, {p!r}) THEN {c!r}' for c, p in PRODUCT_ROLES)} END END"


ORACLES = {
    "salary_report": f"""
WITH {_NUM} SELECT worksite_state AS group_key, count(*) AS n, round(quantile_cont(salary, 0.25), 2) AS p25, round(quantile_cont(salary, 0.5), 2) AS p50, round(quantile_cont(salary, 0.75), 2) AS p75,
  count(*) FILTER (salary >= 90000) AS at_least_90000, count(*) FILTER (salary >= 150000) AS at_least_150000, round(quantile_cont(salary, 0.5) FILTER ({_TITLE.format(EXECUTIVE)}), 2) AS executive_median
FROM f WHERE salary IS NOT NULL AND worksite_state IS NOT NULL GROUP BY 1""",
    "soc_review_summary": f"""
WITH {_NUM}, t AS (SELECT code, job_title, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT code, arg_min(job_title, (-n, job_title)) AS representative_title, count(job_title) AS raw_title_count FROM t GROUP BY code)
SELECT f.code AS normalized_soc_code, count(*) AS lca_count, count(DISTINCT employer_fein) AS company_count, count(*) FILTER (case_status = 'Certified') AS certified_count, min(decision_date) AS first_decision_date,
  max(decision_date) AS last_decision_date, CAST(min(salary) AS decimal(14,2)) AS min_yearly_wage, CAST(max(salary) AS decimal(14,2)) AS max_yearly_wage, any_value(representative_title) AS representative_title,
  any_value(raw_title_count) AS raw_title_count, round(quantile_cont(salary, 0.5), 2) AS median_yearly_wage
FROM f JOIN b ON f.code IS NOT DISTINCT FROM b.code GROUP BY f.code""",
    "role_profile": f"""
WITH {_NUM} SELECT consolidation_key, code AS normalized_soc_code, job_title, count(*) AS lca_count, count(*) FILTER (case_status = 'Certified') AS certified_count, min(decision_date) AS first_decision_date,
  max(decision_date) AS last_decision_date, CAST(min(salary) AS decimal(14,2)) AS min_yearly_wage, CAST(max(salary) AS decimal(14,2)) AS max_yearly_wage, coalesce(code IN {TARGET_SOC!r}, false) AS is_target
FROM f JOIN ({UNITS}) u ON u.fein = f.employer_fein GROUP BY consolidation_key, code, job_title""",
    "product_titles": f"""
WITH {_NUM}, g AS (SELECT {_categories()} AS category, job_title, count(*) AS lca_count, count(DISTINCT employer_fein) AS company_count FROM f GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY lca_count DESC, job_title) AS integer) AS place FROM g WHERE category IS NOT NULL QUALIFY place <= 2""",
    "filings_by_year_and_place": f"SELECT CAST(year(received_date) AS integer) AS received_year, worksite_city, worksite_state, count(*) AS filings, count(*) FILTER (case_status = 'Certified') AS certified FROM ({WIDE}) GROUP BY ALL",
    "product_v1_filings": f"SELECT job_title, count(*) AS filings FROM ({WIDE}) WHERE {_TITLE.format(PRODUCT_V1)} AND NOT {_TITLE.format(NOT_PRODUCT_V1)} GROUP BY 1",
    "label_log": f"SELECT {_local.format('changed_at')} AS day, coalesce(source, 'unknown') AS source, classification_status, count(*) AS changes, avg(confidence) AS avg_confidence FROM ({CHANGES}) GROUP BY ALL",
    "repeat_runs": f"""
WITH r AS (SELECT site_id, count(*) AS runs, count(*) FILTER (status = 'succeeded') AS successes, min(parsed_job_count) FILTER (status = 'succeeded') AS fewest_jobs, max(parsed_job_count) FILTER (status = 'succeeded') AS most_jobs, max(started_at) AS last_run_at FROM ({RUNS}) GROUP BY 1)
SELECT site_id, source_type, coalesce(runs, 0) AS runs, coalesce(successes, 0) AS successes, fewest_jobs, most_jobs, last_run_at FROM ({SITE_ROWS}) s LEFT JOIN r USING (site_id)""",
    "rank_in_tier": f"""
SELECT consolidation_key, priority_tier, priority_score, CAST(row_number() OVER (PARTITION BY priority_tier ORDER BY priority_score DESC NULLS LAST, canonical_name, consolidation_key) AS integer) AS tier_rank, count(*) OVER (PARTITION BY priority_tier) AS tier_companies
FROM ({TARGETS}) WHERE enabled QUALIFY tier_rank <= 25""",
    "page_of_targets": f"SELECT consolidation_key, canonical_name, priority_tier, priority_score FROM ({TARGETS}) WHERE enabled ORDER BY priority_tier, priority_score DESC NULLS LAST, canonical_name, consolidation_key LIMIT 30 OFFSET 20",
    "company_lookup": f"SELECT fein, name, lca_count FROM ({COMPANIES}) WHERE name ILIKE '%{TEXT}%'",
    "never_searched": f"SELECT consolidation_key, priority_tier, priority_score FROM ({TARGETS}) WHERE enabled AND consolidation_key NOT IN (SELECT consolidation_key FROM ({SITE_ROWS})) ORDER BY priority_tier, priority_score DESC NULLS LAST, consolidation_key LIMIT 50",
    "scope_readiness": f"""
WITH s AS (SELECT *, target_country_code = 'US' AND scope_method <> 'unknown' AS ready FROM ({SITE_ROWS}) WHERE {_V} AND crawl_enabled)
SELECT source_type, count(*) AS sites, count(*) FILTER (ready) AS us_ready, count(*) FILTER (NOT ready) AS not_ready FROM s GROUP BY 1""",
    "review_details": f"SELECT site_id, consolidation_key, source_type, candidate_rank, company_candidates FROM (SELECT *, count(*) OVER (PARTITION BY consolidation_key) AS company_candidates FROM ({SITE_ROWS})) WHERE verification_status = 'unverified'",
    "capped_sample": f"SELECT site_id, external_job_id, title FROM ({POSTINGS}) QUALIFY row_number() OVER (PARTITION BY title ORDER BY site_id, external_job_id) <= 10",
    "title_examples": f"""
WITH d AS (SELECT DISTINCT normalized_title, consolidation_key FROM ({POSTINGS})), r AS (SELECT *, row_number() OVER (PARTITION BY normalized_title ORDER BY consolidation_key) AS k FROM d)
SELECT normalized_title, string_agg(consolidation_key, ', ' ORDER BY consolidation_key) FILTER (k <= 3) AS example_companies, count(*) AS company_count FROM r GROUP BY 1""",
    "action_mix": f"SELECT action_status, count(*) AS jobs, CAST(round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS double) AS pct FROM ({ACTION_ROWS}) GROUP BY 1",
    "ranked_appearances": f"SELECT employer_name, min(rank) AS best_rank, count(*) AS appearances, string_agg(DISTINCT region, '|' ORDER BY region) AS regions FROM ({APPEARANCES}) GROUP BY 1",
    "employer_numbers": f"SELECT fein FROM ({COMPANIES}) WHERE name ILIKE '%{TEXT}%' UNION SELECT fein FROM ({ALIASES}) WHERE alias_name ILIKE '%{TEXT}%'",
    "identity_search": f"""
WITH u AS ({UNITS}), t AS (SELECT consolidation_key, canonical_name AS term, 1 AS priority FROM u UNION ALL SELECT consolidation_key, name, 2 FROM u JOIN ({COMPANIES}) c USING (fein)
  UNION ALL SELECT consolidation_key, alias_name, 3 FROM u JOIN ({ALIASES}) a USING (fein) UNION ALL SELECT consolidation_key, search_key, 4 FROM u JOIN ({SEARCH_KEYS}) k USING (fein)),
b AS (SELECT consolidation_key, lower(term) AS low, min((priority, length(term), term)) AS m FROM t WHERE trim(term) <> '' GROUP BY 1, 2)
SELECT consolidation_key, string_agg(m[3], ' | ' ORDER BY m) AS search_terms, count(*) AS terms FROM b GROUP BY 1""",
    "due_queue": f"SELECT site_id, priority_tier, priority_score FROM ({COMPANY_SQL['crawl_schedule']}) WHERE is_due ORDER BY priority_tier, priority_score DESC NULLS LAST, site_id LIMIT 25",
    "failure_actions": f"""
SELECT CASE {' '.join(f"WHEN {' OR '.join(f'contains(lower(e), {t!r})' for t in found)} THEN {action!r}" for action, found in NEXT_ACTIONS)} ELSE '{OTHER_ACTION}' END AS next_action, count(*) AS sites
FROM (SELECT {pick(ERRORS, 'page_id')} AS e FROM pages) GROUP BY 1""",
}
