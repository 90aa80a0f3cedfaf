"""Registered queries on companies, sites and activity, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.market import market_scope
from hirelake.functions.money import CHICAGO
from hirelake.operators.activity import daily_activity, fail_stale_runs, retention_candidates
from hirelake.operators.matching import build_consolidation, match_top_employers
from hirelake.operators.scoring import score_companies, score_consolidated
from hirelake.operators.sites import CRAWLED, INTERVALS, REVIEWED, STRUCTURED, TRUSTED, review_precision, schedule_queue, site_alerts, site_selection_scores
from hirelake.plans.catalog import ORACLES as BASE
from hirelake.plans.catalog import SCOPE, filing_stats
from hirelake.plans.fixtures import AS_OF, FILINGS, RUNS, SEEN_EVER, SOURCES, SPLIT, TITLES, pick, view
from hirelake.sources.shared import kept

BRANDS = (
    "Amazon.com Services LLC", "Amazonia Foods Inc", "Apple Inc.", "EY LLP", "Ernst & Young U.S. LLP", "Sage Software Inc.", "Sage Therapeutics", "AT&T Services",
    "Amazon Web Services", "Northwind Traders", "Apple Orchards Co", "Contoso Consulting", "EY Advisory", "Fabrikam Labs", "Litware Systems", "Tailspin Toys",
)
CITIES = ("Chicago", "Naperville", "Springfield", "Austin", "Seattle", "New York", "Chicago", None)
STATES = ("IL", "IL", "IL", "TX", "WA", "NY", "IN", None)
LATER = "2024-02-15 00:00:00"


def rows_sql(names: str, *rows: tuple) -> str:
    """A small dimension as SQL that both engines read."""
    text = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {text}) AS t({names})"


TERMS = rows_sql(
    "employer_key, linkedin_name, match_key, match_kind",
    ("amazon", "Amazon", "amazon", "prefix"), ("amazon", "Amazon", "amazon-com", "prefix"), ("apple", "Apple", "apple", "prefix"), ("ey", "EY", "ey-llp", "prefix"), ("ey", "EY", "ernst-and-young", "prefix"),
    ("sage", "Sage", "sage", "prefix"), ("att", "AT&T", "at-and-t", "prefix"), ("contoso", "Contoso", "contoso", "exact"), ("fabrikam", "Fabrikam", "fabrikam", "prefix"),
)
POLICIES = rows_sql(
    "employer_key, linkedin_name, policy, min_feins, name_allow_regex",
    ("amazon", "Amazon", "merge_all", 2, None), ("apple", "Apple", "merge_strict", 2, "^apple inc"), ("ey", "EY", "merge_all", 2, None), ("sage", "Sage", "skip", 2, None), ("att", "AT&T", "merge_all", 100000000, None),
)
EXCLUDES = rows_sql("employer_key, notes", ("fabrikam", "x"))
DENIES = ("advisory", "foods")
OVERRIDES = rows_sql("consolidation_key, override_tier, active", ("amazon", "P0", 1), ("000000003", "P0", 1), ("000000007", "P1", 0))
LABELS = rows_sql("normalized_title, classification_status", *((t.lower(), ("review", "target", "non_target")[k % 3]) for k, t in enumerate(TITLES) if k % 8))
FEIN = "lpad(CAST({} AS varchar(20)), 9, '0')"
NAME = f"concat({pick(BRANDS, 'c_custkey')}, CASE WHEN c_custkey < 16 THEN '' ELSE concat(' ', CAST(c_custkey AS varchar(20))) END)"
COMPANIES = f"""
SELECT {FEIN.format('c_custkey')} AS fein, {NAME} AS name, {pick(CITIES, 'c_nationkey')} AS city, {pick(STATES, 'c_nationkey')} AS state, coalesce(n, 0) AS lca_count, coalesce(certified, 0) AS certified_count
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS certified FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) f ON c_custkey = o_custkey"""
ALIASES = f"SELECT {FEIN.format('c_custkey')} AS fein, CASE WHEN c_custkey % 3 = 0 THEN {pick(BRANDS, 'c_custkey')} END AS alias_name FROM customer"
SEARCH_KEYS = f"SELECT {FEIN.format('c_custkey')} AS fein, CASE WHEN c_custkey % 2 = 0 THEN replace(lower({pick(BRANDS, 'c_custkey + 1')}), ' ', '-') END AS search_key FROM customer"
TARGETS = f"SELECT {FEIN.format('c_custkey')} AS consolidation_key, c_name AS canonical_name, {pick(('P0', 'P1', 'P2', 'P3'), 'c_custkey')} AS priority_tier, CAST(c_custkey % 23 AS integer) AS priority_score, c_custkey % 11 <> 0 AS enabled FROM customer"
STATUS = ("unverified", "verified", "verified", "verified", "rejected")
SITE_ROWS = f"""
SELECT page_id AS site_id, {FEIN.format('page_id % 60')} AS consolidation_key, {pick(SOURCES, 'page_id')} AS source_type, CASE WHEN page_id % 13 = 0 THEN NULL ELSE page_id % 3 + 1 END AS candidate_rank,
       {pick(STATUS, 'page_id')} AS verification_status, page_id % 5 <> 1 AS crawl_enabled, {pick(('US', 'US', 'CA'), 'page_id')} AS target_country_code, {pick(('url', 'text', 'unknown', 'url'), 'page_id')} AS scope_method,
       CAST({pick((AS_OF, None), 'page_id')} AS timestamp) AS last_success_at, CAST({pick((None, '2024-01-28 00:00:00', '2024-01-31 12:00:00', '2024-02-03 00:00:00'), 'page_id')} AS timestamp) AS next_crawl_at,
       {pick(('succeeded', 'failed', 'pending'), 'page_id')} AS crawl_status, CAST(page_id % 6 AS integer) AS consecutive_failures, CAST({pick((AS_OF, AS_OF, None), 'page_id')} AS timestamp) AS reviewed_at FROM pages"""
HISTORY = f"SELECT *, lower(title) AS normalized_title, CASE WHEN active THEN NULL ELSE ts + INTERVAL '1' DAY END AS closed_at, ts AS first_seen_at FROM ({SEEN_EVER}) seen WHERE latest = 1"
ACTIONS = f"SELECT site_id, CASE WHEN event_id % 7 = 0 THEN external_job_id END AS external_job_id FROM ({SEEN_EVER}) seen WHERE latest = 1"


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, COMPANIES, "customer", "lineitem", "orders")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, HISTORY, "events").withColumn("market_scope", market_scope(F.col("location")))


def top_employer_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases, keys = view(spark, sf_dir, ALIASES, "customer"), view(spark, sf_dir, SEARCH_KEYS, "customer")
    return match_top_employers(spark.sql(TERMS), _companies(spark, sf_dir), aliases, keys, spark.sql(POLICIES), spark.sql(EXCLUDES))


def consolidation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members = build_consolidation(top_employer_matches(spark, sf_dir), _companies(spark, sf_dir), spark.sql(POLICIES), DENIES)
    return members.join(groups, "group_id")


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Companies and their matches, which scores read several times, written once."""
    companies = kept(_companies(spark, sf_dir), "companies")
    aliases, keys = view(spark, sf_dir, ALIASES, "customer"), view(spark, sf_dir, SEARCH_KEYS, "customer")
    return companies, kept(match_top_employers(spark.sql(TERMS), companies, aliases, keys, spark.sql(POLICIES), spark.sql(EXCLUDES)), "matches")


def company_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies, matches = _matched(spark, sf_dir)
    return score_companies(companies, filing_stats(spark, sf_dir), matches)


def consolidated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    companies, matches = _matched(spark, sf_dir)
    groups, members = build_consolidation(matches, companies, spark.sql(POLICIES), DENIES)
    overrides = spark.sql(OVERRIDES).withColumn("active", F.col("active") == 1)
    return score_consolidated(companies, filing_stats(spark, sf_dir), groups, members, matches, overrides)


def site_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_selection_scores(view(spark, sf_dir, SITE_ROWS, "pages"), view(spark, sf_dir, TARGETS, "customer"))


def crawl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule_queue(view(spark, sf_dir, SITE_ROWS, "pages"), view(spark, sf_dir, TARGETS, "customer"), AS_OF)


def crawl_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = schedule_queue(view(spark, sf_dir, SITE_ROWS, "pages"), view(spark, sf_dir, TARGETS, "customer"), AS_OF)
    return site_alerts(queue, _postings(spark, sf_dir), AS_OF)


def site_review_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_precision(view(spark, sf_dir, SITE_ROWS, "pages"))


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention_candidates(_postings(spark, sf_dir), spark.sql(LABELS), view(spark, sf_dir, ACTIONS, "events"), LATER)


def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fail_stale_runs(view(spark, sf_dir, RUNS, "events"), SPLIT)
    return runs.groupBy("site_id", "status").agg(F.count("*").alias("runs"), F.count("error_code").alias("stale"))


def activity_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_activity(_postings(spark, sf_dir), spark.sql(LABELS), view(spark, sf_dir, RUNS, "events"), AS_OF)


QUERIES = {
    f.__name__: f
    for f in (top_employer_matches, consolidation_members, company_scores, consolidated_scores, site_selection, crawl_schedule, crawl_alerts, site_review_precision, retention_prune, stale_runs, activity_by_day)
}

_KEY = r"trim(regexp_replace(regexp_replace(lower(replace({}, '&', ' and ')), '[^a-z0-9\s-]', ' ', 'g'), '\s+', '-', 'g'), '-')"
_MATCHES = f"""
companies AS ({COMPANIES}), terms AS ({TERMS}), policies AS ({POLICIES}),
keys AS (SELECT fein, search_key AS key, 'search_key' AS match_source FROM ({SEARCH_KEYS}) UNION ALL SELECT fein, {_KEY.format('alias_name')}, 'company_alias' FROM ({ALIASES})
         UNION ALL SELECT fein, {_KEY.format('name')}, 'company_name' FROM companies),
matches AS (SELECT DISTINCT fein, t.employer_key, c.name AS company_name, match_source, match_key, t.linkedin_name
            FROM terms t JOIN keys k ON k.key = t.match_key OR (t.match_kind = 'prefix' AND starts_with(k.key, t.match_key || '-')) JOIN companies c USING (fein) LEFT JOIN policies p ON p.employer_key = t.employer_key
            WHERE t.employer_key NOT IN (SELECT employer_key FROM ({EXCLUDES})) AND coalesce(policy, '') <> 'skip' AND (coalesce(policy, '') <> 'merge_strict' OR coalesce(regexp_matches(c.name, name_allow_regex, 'i'), false)))"""
_GROUPS = f"""{_MATCHES},
found AS (SELECT DISTINCT p.employer_key AS group_id, p.linkedin_name AS canonical_name, p.policy, p.min_feins, m.fein, m.company_name, c.lca_count FROM policies p JOIN matches m USING (employer_key) JOIN companies c USING (fein)
          WHERE p.policy <> 'skip' AND NOT ({' OR '.join(f"contains(lower(m.company_name), '{d}')" for d in DENIES)}) AND (p.policy = 'merge_all' OR regexp_matches(m.company_name, name_allow_regex, 'i'))),
groups AS (SELECT group_id, canonical_name, group_id AS linkedin_employer_key, policy, count(*) AS member_fein_count FROM found GROUP BY ALL HAVING count(*) >= min(min_feins))"""
_CITY = f"(upper(trim(state)) = 'IL' AND lower(trim(city)) IN {CHICAGO!r})"
_PERCENT = "((20000 * product_role_lca_count + lca_count) // nullif(2 * lca_count, 0)) / 100.0"
_RECENT = "coalesce(last_decision_date >= (SELECT max(dataset_max_decision_date) FROM stats) - 365, false)"
_SUM = "CAST(coalesce(sum({0}), 0) AS BIGINT) AS {0}"


def _scores(target: str, **rules: tuple[str, str]) -> str:
    each = {name: f"CASE WHEN {condition.replace('TARGET', target)} THEN {points} ELSE 0 END" for name, (condition, points) in rules.items()}
    columns = [f"CAST({e} AS decimal(4,2)) AS {n}" for n, e in each.items()]
    return ", ".join(columns) + f", CAST({' + '.join(each.values())} AS decimal(4,2)) AS priority_score"


_POSTINGS = f"postings AS (SELECT *, {SCOPE} AS market_scope FROM ({HISTORY})), labels AS ({LABELS})"
_QUEUE = f"""
queue AS (SELECT site_id, consolidation_key, canonical_name, priority_tier, priority_score, source_type, CAST(CASE priority_tier {' '.join(f"WHEN '{t}' THEN {h}" for t, h in INTERVALS.items())} END AS integer) AS recommended_interval_hours,
                 next_crawl_at, coalesce(next_crawl_at <= TIMESTAMP '{AS_OF}', true) AS is_due, consecutive_failures, crawl_status
          FROM ({SITE_ROWS}) JOIN ({TARGETS}) USING (consolidation_key)
          WHERE enabled AND verification_status = 'verified' AND crawl_enabled AND target_country_code = 'US' AND scope_method <> 'unknown' AND source_type IN {CRAWLED!r})"""

ORACLES = {
    "top_employer_matches": f"WITH {_MATCHES} SELECT * FROM matches",
    "consolidation_members": f"WITH {_GROUPS} SELECT group_id, fein, company_name, lca_count, groups.canonical_name, linkedin_employer_key, groups.policy, member_fein_count FROM found JOIN groups USING (group_id)",
    "company_scores": f"""
WITH {_MATCHES}, stats AS ({BASE['filing_stats']}),
b AS (SELECT fein, name, city, state, lca_count, certified_count, coalesce(target_role_lca_count, 0) AS target_role_lca_count, coalesce(product_role_lca_count, 0) AS product_role_lca_count, has_product_role_job, has_product_manager_job, last_decision_date
      FROM companies LEFT JOIN stats USING (fein))
SELECT fein, name AS company_name, city AS employer_city, state AS employer_state, lca_count, certified_count, lca_count = 1 AS single_lca_company, target_role_lca_count, last_decision_date, {_RECENT} AS recent_lca, product_role_lca_count, {_PERCENT} AS product_role_lca_pct,
       {_scores('target_role_lca_count > 0', target_role_score=('TARGET', '1'), lca_count_score=('TARGET AND lca_count > 1', '1'), chicago_score=('TARGET AND ' + _CITY, '0.5'), product_role_score=('TARGET AND has_product_role_job', '1'),
                product_manager_score=('TARGET AND has_product_manager_job', '0.25'), linkedin_top_employer_score=('fein IN (SELECT fein FROM matches)', '1'))} FROM b""",
    "consolidated_scores": f"""
WITH {_GROUPS}, stats AS ({BASE['filing_stats']}),
members AS (SELECT group_id, fein FROM found SEMI JOIN groups USING (group_id)),
units AS (SELECT group_id AS consolidation_key, canonical_name, true AS is_merged_group, linkedin_employer_key, fein FROM members JOIN groups USING (group_id)
          UNION ALL SELECT fein, name, false, NULL, fein FROM companies WHERE fein NOT IN (SELECT fein FROM members)),
g AS (SELECT consolidation_key, min(canonical_name) AS canonical_name, bool_or(is_merged_group) AS is_merged_group, min(linkedin_employer_key) AS linkedin_employer_key, count(DISTINCT u.fein) AS member_fein_count,
             string_agg(u.fein, ',' ORDER BY u.fein) AS member_feins, first(u.fein ORDER BY lca_count DESC, name, u.fein) AS primary_fein, first(city ORDER BY lca_count DESC, name, u.fein) AS employer_city,
             first(state ORDER BY lca_count DESC, name, u.fein) AS employer_state, CAST(sum(lca_count) AS BIGINT) AS lca_count, CAST(sum(certified_count) AS BIGINT) AS certified_count, {_SUM.format('lca_case_count')},
             {_SUM.format('executive_level_lca_count')}, {_SUM.format('target_role_lca_count')}, {_SUM.format('product_role_lca_count')}, min(target_role_min_annual_salary) AS target_role_min_annual_salary,
             bool_or(has_product_role_job) AS product, bool_or(has_product_manager_job) AS manager, max(last_decision_date) AS last_decision_date, coalesce(bool_or({_CITY}), false) AS chicago, bool_or(u.fein IN (SELECT fein FROM matches)) AS matched
      FROM units u JOIN companies c ON u.fein = c.fein LEFT JOIN stats s ON s.fein = c.fein GROUP BY consolidation_key),
x AS (SELECT *, lca_case_count BETWEEN 1 AND 2 AND executive_level_lca_count = lca_case_count AS executive_only_excluded FROM g),
s AS (SELECT *, {_scores('NOT executive_only_excluded AND target_role_lca_count > 0', target_role_score=('TARGET', '1'), lca_count_score=('TARGET AND lca_count > 1', '1'), chicago_score=('TARGET AND chicago', '0.5'), product_role_score=('TARGET AND product', '1'),
                product_manager_score=('TARGET AND manager', '0.25'), salary_score=('TARGET AND target_role_min_annual_salary >= 90000', '1'), linkedin_top_employer_score=('TARGET AND (matched OR linkedin_employer_key IS NOT NULL)', '1'))} FROM x),
t AS (SELECT *, CASE WHEN executive_only_excluded THEN NULL WHEN priority_score > 3 THEN 'P1' WHEN priority_score IN (3.0, 2.5) THEN 'P2' WHEN priority_score > 1 THEN 'P3' END AS computed_crawl_priority_tier FROM s)
SELECT t.* EXCLUDE (lca_case_count, executive_level_lca_count, product, manager, chicago, matched), {_PERCENT} AS product_role_lca_pct, {_RECENT} AS recent_lca,
       CASE WHEN NOT executive_only_excluded THEN coalesce(override_tier, computed_crawl_priority_tier) END AS crawl_priority_tier
FROM t LEFT JOIN (SELECT consolidation_key, override_tier FROM ({OVERRIDES}) WHERE active = 1) o USING (consolidation_key)""",
    "site_selection": f"""
WITH sites AS ({SITE_ROWS})
SELECT site_id, consolidation_key, source_type, candidate_rank,
       CAST(CASE verification_status WHEN 'verified' THEN 100 WHEN 'rejected' THEN -200 ELSE 0 END + CASE WHEN source_type IN {STRUCTURED!r} THEN 45 WHEN source_type = 'icims' THEN 20 WHEN source_type = 'generic_html' THEN -30 ELSE 0 END
       + CASE candidate_rank WHEN 1 THEN 25 WHEN 2 THEN 10 WHEN 3 THEN 5 ELSE 0 END + CASE WHEN target_country_code = 'US' AND scope_method <> 'unknown' THEN 20 ELSE 0 END + CASE WHEN last_success_at IS NOT NULL THEN 30 ELSE 0 END
       + CASE WHEN crawl_status = 'succeeded' THEN 15 ELSE 0 END - CASE WHEN consecutive_failures >= 3 THEN 40 ELSE 0 END AS integer) AS selection_score,
       CASE WHEN verification_status = 'verified' THEN 'selected_verified' WHEN verification_status = 'rejected' THEN 'rejected'
            WHEN source_type IN {TRUSTED!r} AND candidate_rank = 1 AND consolidation_key NOT IN (SELECT consolidation_key FROM sites WHERE verification_status = 'verified') THEN 'auto_trust_rank1_structured_ats'
            WHEN source_type IN {REVIEWED!r} AND candidate_rank = 1 THEN 'supported_but_needs_specific_review' WHEN source_type = 'icims' THEN 'needs_icims_us_scope_review'
            WHEN source_type = 'generic_html' THEN 'manual_or_later_generic_html' ELSE 'review_candidate' END AS selection_decision
FROM sites JOIN ({TARGETS}) USING (consolidation_key) WHERE enabled""",
    "crawl_schedule": f"WITH {_QUEUE} SELECT * FROM queue",
    "crawl_alerts": f"""
WITH {_POSTINGS}, {_QUEUE}, a AS (SELECT *, CASE WHEN consecutive_failures >= 3 THEN 'repeated_failure' WHEN crawl_status = 'succeeded' AND site_id NOT IN (SELECT site_id FROM postings WHERE active) THEN 'zero_active_jobs'
      WHEN next_crawl_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 'overdue' END AS alert_type FROM queue)
SELECT site_id, consolidation_key, priority_tier, source_type, alert_type, consecutive_failures FROM a WHERE alert_type IS NOT NULL""",
    "site_review_precision": f"""
WITH g AS (SELECT source_type, candidate_rank, count(reviewed_at) AS reviewed_candidates, count(*) FILTER (verification_status = 'verified') AS verified_candidates, count(*) FILTER (verification_status = 'rejected') AS rejected_candidates FROM ({SITE_ROWS}) GROUP BY ALL)
SELECT *, round(CASE WHEN reviewed_candidates > 0 THEN CAST(verified_candidates AS double) / reviewed_candidates END, 4) AS precision FROM g""",
    "retention_prune": f"""
WITH {_POSTINGS}, r AS (SELECT site_id, external_job_id, CASE WHEN market_scope <> 'US' AND closed_at < TIMESTAMP '{LATER}' - INTERVAL 30 DAY THEN 'closed_non_us_or_unknown_30d'
      WHEN coalesce(classification_status, 'review') = 'non_target' AND closed_at < TIMESTAMP '{LATER}' - INTERVAL 30 DAY THEN 'closed_non_target_30d'
      WHEN coalesce(classification_status, 'review') = 'review' AND closed_at < TIMESTAMP '{LATER}' - INTERVAL 180 DAY THEN 'closed_review_180d' END AS retention_reason
      FROM postings LEFT JOIN labels USING (normalized_title) ANTI JOIN ({ACTIONS}) a USING (site_id, external_job_id) WHERE NOT active)
SELECT * FROM r WHERE retention_reason IS NOT NULL""",
    "stale_runs": f"""
WITH r AS (SELECT site_id, status, status = 'running' AND started_at < TIMESTAMP '{SPLIT}' - INTERVAL 60 MINUTE AS stale FROM ({RUNS}))
SELECT site_id, CASE WHEN stale THEN 'failed' ELSE status END AS status, count(*) AS runs, count(*) FILTER (stale) AS stale FROM r GROUP BY ALL""",
    # All times are in winter, when the local zone is six hours behind.
    "activity_by_day": f"""
WITH {_POSTINGS}, days AS (SELECT CAST(d AS date) AS activity_date FROM generate_series(TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR - INTERVAL 29 DAY, TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR, INTERVAL 1 DAY) AS t(d)),
us AS (SELECT *, coalesce(classification_status, 'review') AS role FROM postings LEFT JOIN labels USING (normalized_title) WHERE market_scope = 'US'),
n AS (SELECT CAST(first_seen_at - INTERVAL 6 HOUR AS date) AS activity_date, count(*) AS new_jobs, count(*) FILTER (role = 'target') AS new_target_jobs, count(*) FILTER (role = 'review') AS new_review_jobs FROM us WHERE active GROUP BY 1),
c AS (SELECT CAST(closed_at - INTERVAL 6 HOUR AS date) AS activity_date, count(*) AS closed_jobs FROM us WHERE closed_at IS NOT NULL AND role = 'target' GROUP BY 1),
r AS (SELECT CAST(started_at - INTERVAL 6 HOUR AS date) AS activity_date, count(*) AS crawl_runs, count(*) FILTER (status = 'succeeded') AS successful_runs, count(*) FILTER (status = 'failed') AS failed_runs FROM ({RUNS}) GROUP BY 1)
SELECT activity_date, {', '.join(f'coalesce({c}, 0) AS {c}' for c in 'new_jobs new_target_jobs new_review_jobs closed_jobs crawl_runs successful_runs failed_runs'.split())}
FROM days LEFT JOIN n USING (activity_date) LEFT JOIN c USING (activity_date) LEFT JOIN r USING (activity_date)""",
}
