"""Registered queries on titles, queues and samples, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.market import market_scope
from hirelake.operators import queues, titles
from hirelake.plans.catalog import SCOPE
from hirelake.plans.companies import FEIN, HISTORY, LABELS, SITE_ROWS, TARGETS, rows_sql
from hirelake.plans.fixtures import SOURCES, TARGET_SOC, TITLES, pick, view

CODES = ("15125200", "11101100", "15129908", "29114100", "15205100", "41903100", "13111100")
MAPPINGS = f"SELECT concat(' ', CASE WHEN p_partkey % 24 < 20 THEN '' ELSE 'unseen ' END, {pick(TITLES, 'p_partkey')}) AS normalized_job_title, {pick(CODES, 'p_partkey % 24 % 7 + CASE WHEN p_partkey % 24 < 8 THEN p_size % 2 ELSE 0 END')} AS normalized_soc_code FROM part"
RULES = rows_sql(
    "rule_type, canonical_role, term, regex_pattern, decision_reason, priority",
    ("non_target", None, "senior", "(^|[^a-z])senior([^a-z]|$)", titles.SENIOR_RULE, 10), ("non_target", None, "intern", "(^|[^a-z])intern([^a-z]|$)", "avoid_intern", 20), ("non_target", None, "nurse", "nurse", "avoid_field", 50),
    ("non_target", None, "warehouse", "warehouse|driver", "avoid_field", 50), ("target", "product", "product manager", "product manager", "for_product", 10), ("target", "data", "data", "data (analyst|engineer)", "for_data", 20),
    ("target", "program", "program manager", "program manager", "for_program", 10), ("target", "engineer", "engineer", "engineer", "for_engineer", 20), ("target", "systems", "systems engineer", "systems engineer", "for_systems", 20),
)
SUGGESTIONS = f"SELECT concat(CASE WHEN event_id % 24 < 18 THEN '' ELSE 'unseen ' END, lower({pick(TITLES, 'event_id')})) AS normalized_title, CAST((event_id % 97) * 0.01 AS decimal(6,5)) AS ml_confidence, ts AS created_at, event_id AS suggestion_id FROM events"
ELIGIBLE = f"SELECT {FEIN.format('c_custkey')} AS consolidation_key, {pick(('P1', 'P2'), 'c_custkey')} AS priority_tier, CAST(c_custkey % 23 AS integer) AS priority_score, CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 0 END AS chicago_score, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS linkedin_top_employer_score, c_custkey % 200 AS lca_count FROM customer"
#: Fewer companies, so that some have several sites of one kind.
DENSE = SITE_ROWS.replace("page_id % 60", "page_id % 12")
DAY, PLACES, CUTS, KINDS = "2024-02-01", 60, (50, 100), SOURCES[:4]


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lpad((F.col("site_id") % 60).cast("string"), 9, "0")
    return view(spark, sf_dir, HISTORY, "events").withColumns({"market_scope": market_scope(F.col("location")), "consolidation_key": key})


def _resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    soc = spark.sql("SELECT explode(array({})) AS normalized_soc_code, true AS active".format(", ".join(map(repr, TARGET_SOC))))
    return titles.soc_resolution(view(spark, sf_dir, MAPPINGS, "part"), soc)


def title_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.title_catalog(_postings(spark, sf_dir), spark.sql(LABELS))


def soc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.soc_match_candidates(title_catalog(spark, sf_dir), _resolution(spark, sf_dir))


def soc_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.soc_match_coverage(_postings(spark, sf_dir), _resolution(spark, sf_dir))


def title_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(RULES).withColumn("active", F.lit(True))
    return titles.decide_titles(_postings(spark, sf_dir), rules)


def learning_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.learning_queue(title_catalog(spark, sf_dir), view(spark, sf_dir, SUGGESTIONS, "events"), 20)


def company_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.stratified_sample(view(spark, sf_dir, ELIGIBLE, "customer"), DAY, PLACES)


def duplicate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.duplicate_sites(view(spark, sf_dir, DENSE, "pages"), KINDS)


def rank_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.rank_coverage(view(spark, sf_dir, TARGETS, "customer"), view(spark, sf_dir, SITE_ROWS, "pages"), CUTS)


def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.top_candidates(view(spark, sf_dir, SITE_ROWS, "pages"))


QUERIES = {f.__name__: f for f in (title_catalog, soc_candidates, soc_coverage, title_decisions, learning_queue, company_sample, duplicate_sites, rank_coverage, top_candidates)}

_BASE = f"postings AS (SELECT *, {SCOPE} AS market_scope, {FEIN.format('site_id % 60')} AS consolidation_key FROM ({HISTORY})), labels AS ({LABELS})"
_CATALOG = f"""{_BASE}, catalog AS (
SELECT p.normalized_title, min(title) AS example_title, count(*) AS posting_count, count(DISTINCT consolidation_key) AS company_count, count(*) FILTER (active) AS active_posting_count, coalesce(any_value(l.classification_status), 'review') AS classification_status
FROM postings p LEFT JOIN labels l ON p.normalized_title = l.normalized_title GROUP BY p.normalized_title)"""
_RESOLVED = f"""resolved AS (
SELECT lower(trim(normalized_job_title)) AS normalized_title, count(DISTINCT normalized_soc_code) AS matched_soc_count, count(DISTINCT normalized_soc_code) FILTER (normalized_soc_code IN {TARGET_SOC!r}) AS target_soc_count,
       count(DISTINCT normalized_soc_code) FILTER (normalized_soc_code NOT IN {TARGET_SOC!r}) AS non_target_soc_count, string_agg(DISTINCT normalized_soc_code, ', ' ORDER BY normalized_soc_code) AS matched_soc_codes
FROM ({MAPPINGS}) GROUP BY 1)"""


def _match(target: str, other: str, mixed: str, unknown: str) -> str:
    return f"CASE WHEN target_soc_count IS NULL THEN '{unknown}' WHEN target_soc_count > 0 AND non_target_soc_count = 0 THEN '{target}' WHEN target_soc_count = 0 AND non_target_soc_count > 0 THEN '{other}' ELSE '{mixed}' END"


_BUCKET = "CASE WHEN chicago_score > 0 AND linkedin_top_employer_score > 0 THEN 'chicago_and_linkedin' WHEN chicago_score > 0 THEN 'chicago' WHEN linkedin_top_employer_score > 0 THEN 'linkedin_top_employer' WHEN lca_count >= 100 THEN 'large_lca_sponsor' ELSE 'diverse_random' END"
_EXCEPTED = f"(regexp_matches(t, '{titles.SENIOR}') AND regexp_matches(t, '{titles.MANAGERS}'))"

ORACLES = {
    "title_catalog": f"WITH {_CATALOG} SELECT * FROM catalog",
    "soc_candidates": f"""
WITH {_CATALOG}, {_RESOLVED}
SELECT c.*, r.* EXCLUDE (normalized_title), {_match('target', 'non_target', 'review', 'review')} AS suggested_status,
       {_match('exact_target_soc_only', 'exact_non_target_soc_only', 'mixed_soc_conflict', 'no_exact_raw_title_match')} AS suggestion_reason
FROM catalog c LEFT JOIN resolved r ON c.normalized_title = r.normalized_title""",
    "soc_coverage": f"""
WITH {_BASE}, {_RESOLVED}, observed AS (SELECT normalized_title, count(*) AS n FROM postings WHERE active AND market_scope = 'US' GROUP BY 1)
SELECT {_match('auto_target', 'auto_non_target', 'soc_conflict_review', 'no_exact_match')} AS match_result, count(*) AS distinct_titles, CAST(sum(n) AS BIGINT) AS active_us_postings,
       CAST(round(100.0 * sum(n) / sum(sum(n)) OVER (), 2) AS double) AS posting_pct
FROM observed LEFT JOIN resolved USING (normalized_title) GROUP BY 1""",
    "title_decisions": f"""
WITH titles AS (SELECT DISTINCT normalized_title AS t FROM ({HISTORY})), rules AS ({RULES}),
hits AS (SELECT t, rule_type, canonical_role, decision_reason, row_number() OVER (PARTITION BY t, rule_type ORDER BY priority, length(term) DESC, term) AS k
         FROM titles JOIN rules ON regexp_matches(t, regex_pattern) AND NOT (rule_type = 'non_target' AND decision_reason = '{titles.SENIOR_RULE}' AND {_EXCEPTED})),
j AS (SELECT t, a.decision_reason AS against, coalesce(f.decision_reason, CASE WHEN {_EXCEPTED} THEN 'profile_target_pm_senior_exception' END) AS why,
             CASE WHEN f.t IS NOT NULL THEN f.canonical_role WHEN {_EXCEPTED} THEN 'candidate_profile_track: product' END AS role
      FROM titles LEFT JOIN (SELECT * FROM hits WHERE k = 1 AND rule_type = 'non_target') a USING (t) LEFT JOIN (SELECT * FROM hits WHERE k = 1 AND rule_type = 'target') f USING (t))
SELECT t AS normalized_title, CASE WHEN against IS NOT NULL THEN 'non_target' WHEN why IS NOT NULL THEN 'target' ELSE 'review' END AS classification_status,
       CASE WHEN against IS NULL THEN role END AS canonical_role, coalesce(against, why, 'profile_no_rule_match') AS decision_reason FROM j""",
    "learning_queue": f"""
WITH {_CATALOG}, latest AS (SELECT normalized_title, ml_confidence FROM ({SUGGESTIONS}) QUALIFY row_number() OVER (PARTITION BY normalized_title ORDER BY created_at DESC, suggestion_id DESC) = 1)
SELECT normalized_title, active_posting_count, company_count, CAST(active_posting_count + company_count * 3 + CASE WHEN ml_confidence IS NULL THEN 25 ELSE round((1 - ml_confidence) * 50) END AS BIGINT) AS learning_priority_score
FROM catalog LEFT JOIN latest USING (normalized_title) WHERE classification_status = 'review'
ORDER BY learning_priority_score DESC, active_posting_count DESC, company_count DESC, normalized_title LIMIT 20""",
    "company_sample": f"""
WITH rows AS (SELECT *, {_BUCKET} AS sample_bucket FROM ({ELIGIBLE})), ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_bucket ORDER BY priority_score DESC, md5(concat(consolidation_key, '{DAY}'))) AS k FROM rows),
chosen AS (SELECT * FROM ranked WHERE k <= CASE sample_bucket {' '.join(f"WHEN '{b}' THEN {n}" for b, n in queues.QUOTAS.items())} END ORDER BY md5(concat(consolidation_key, 'quota')) LIMIT {PLACES}),
fill AS (SELECT * FROM ranked WHERE consolidation_key NOT IN (SELECT consolidation_key FROM chosen) ORDER BY md5(concat(consolidation_key, '{DAY}', 'fill')) LIMIT (SELECT {PLACES} - count(*) FROM chosen))
SELECT consolidation_key, priority_tier, priority_score, sample_bucket FROM (SELECT * FROM chosen UNION ALL SELECT * FROM fill)""",
    "duplicate_sites": f"""
SELECT site_id FROM (SELECT site_id, row_number() OVER (PARTITION BY consolidation_key, source_type ORDER BY last_success_at DESC NULLS LAST, site_id) AS k
FROM ({DENSE}) WHERE source_type IN {KINDS!r} AND verification_status = 'verified' AND crawl_enabled) WHERE k > 1""",
    "rank_coverage": f"""
WITH ranked AS (SELECT *, row_number() OVER (ORDER BY priority_tier, priority_score DESC NULLS LAST, canonical_name, consolidation_key) AS overall_rank FROM ({TARGETS}) WHERE enabled),
rollup AS (SELECT consolidation_key, bool_or(verification_status = 'verified') AS v, bool_or(verification_status = 'verified' AND crawl_enabled) AS e, bool_or(verification_status = 'verified' AND crawl_enabled AND last_success_at IS NOT NULL) AS s FROM ({SITE_ROWS}) GROUP BY 1),
buckets AS (SELECT * FROM (VALUES {', '.join(f'({c})' for c in CUTS)}, (CAST(NULL AS integer))) b(max_rank))
SELECT max_rank, count(*) AS companies, count(*) FILTER (coalesce(v, false)) AS verified_site_companies, count(*) FILTER (coalesce(e, false)) AS can_crawl, count(*) FILTER (coalesce(s, false)) AS crawled_successfully,
       CAST(round(100.0 * count(*) FILTER (coalesce(s, false)) / count(*), 2) AS double) AS success_pct
FROM buckets JOIN ranked ON max_rank IS NULL OR overall_rank <= max_rank LEFT JOIN rollup USING (consolidation_key) GROUP BY max_rank""",
    "top_candidates": f"""
WITH best AS (SELECT *, row_number() OVER (PARTITION BY consolidation_key ORDER BY candidate_rank NULLS LAST, site_id) AS k FROM ({SITE_ROWS}) QUALIFY k <= 3)
SELECT consolidation_key, max(site_id) FILTER (k = 1) AS site_1, max(site_id) FILTER (k = 2) AS site_2, max(site_id) FILTER (k = 3) AS site_3, count(*) AS candidates FROM best GROUP BY 1""",
}
