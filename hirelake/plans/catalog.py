"""Registered queries of the library's own operators, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions.market import CODED, COUNTRY, NAMED, OUTSIDE, market_scope
from hirelake.functions.titles import EXECUTIVE, FAILURES, PRODUCT_ROLES
from hirelake.operators.filings import employer_filing_stats, salary_percentiles
from hirelake.operators.postings import apply_snapshot, snapshot_counts
from hirelake.operators.runs import adapter_health, failure_breakdown
from hirelake.plans.fixtures import AS_OF, FILINGS, RUNS, SEEN, SITES, SPLIT, TARGET_SOC, view


def filing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    soc = spark.sql("SELECT explode(array({})) AS normalized_soc_code, true AS active".format(", ".join(map(repr, TARGET_SOC))))
    return employer_filing_stats(view(spark, sf_dir, FILINGS, "lineitem", "orders"), soc)


def salary_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salary_percentiles(view(spark, sf_dir, FILINGS, "lineitem", "orders"), F.col("job_title"))


def crawl_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter_health(view(spark, sf_dir, RUNS, "events"), view(spark, sf_dir, SITES, "pages"), AS_OF)


def crawl_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failure_breakdown(view(spark, sf_dir, SITES, "pages"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = view(spark, sf_dir, SEEN.format("<"), "events").where("latest = 1").withColumn("market_scope", market_scope(F.col("location")))
    history = old.select("site_id", "external_job_id", "title", "market_scope", "active", F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"), F.when(~F.col("active"), F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("closed_at"))
    stage = view(spark, sf_dir, SEEN.format(">="), "events").where("latest = 1").withColumn("market_scope", market_scope(F.col("location")))
    return snapshot_counts(apply_snapshot(history, stage, SPLIT))


QUERIES = {f.__name__: f for f in (filing_stats, salary_quartiles, crawl_health, crawl_failures, snapshot_diff)}

_LOW = "lower(coalesce(job_title, ''))"
_PRODUCT = f"(({' OR '.join(f'contains({_LOW}, {p!r})' for _, p in PRODUCT_ROLES)}) AND NOT (contains({_LOW}, 'program manager') AND NOT contains({_LOW}, 'technical program manager')))"
_MANAGER = f"({_PRODUCT} AND CASE {' '.join(f'WHEN contains({_LOW}, {p!r}) THEN {c!r}' for c, p in PRODUCT_ROLES)} END = 'product_manager')"
_SALARY = "CAST(wage_rate_of_pay_from * CASE wage_unit_of_pay WHEN 'Year' THEN 1 WHEN 'Month' THEN 12 WHEN 'Bi-Weekly' THEN 26 WHEN 'Week' THEN 52 WHEN 'Hour' THEN 2080 END AS decimal(14,2))"
_SOC = r"CASE WHEN regexp_matches(soc_code, '^\s*\d{2}-\d{4}') THEN regexp_extract(soc_code, '^\s*(\d{2})-', 1) || regexp_extract(soc_code, '^\s*\d{2}-(\d{4})', 1) || lpad(regexp_extract(soc_code, '^\s*\d{2}-\d{4}(\.(\d{1,2}))?', 2), 2, '0') END"
SCOPE = rf"CASE WHEN location = '' THEN 'unknown' WHEN regexp_matches(lower(location), '{COUNTRY}') OR regexp_matches(location, '\bUS-[A-Z]{{2}}\b') OR regexp_matches(lower(location), '{NAMED}') OR regexp_matches(location, '{CODED}') THEN 'US' WHEN regexp_matches(lower(location), '{OUTSIDE}') THEN 'non-US' ELSE 'unknown' END"
_REASON = f"CASE {' '.join(f'WHEN {" OR ".join(f"contains(lower(last_error), {t!r})" for t in found)} THEN {reason!r}' for reason, found in FAILURES)} WHEN last_error = '' THEN 'unknown' ELSE 'other' END"

ORACLES = {
    "filing_stats": f"""
WITH filings AS ({FILINGS}),
rows AS (SELECT employer_fein AS fein, decision_date, regexp_matches({_LOW}, '{EXECUTIVE}') AS executive, {_PRODUCT} AS product, {_MANAGER} AS manager, {_SALARY} AS salary,
                CASE WHEN {_SOC} IN {TARGET_SOC!r} THEN {_SOC} END AS target FROM filings)
SELECT fein, count(*) AS lca_case_count, count(*) FILTER (executive) AS executive_level_lca_count, count(target) AS target_role_lca_count,
       min(salary) FILTER (target IS NOT NULL) AS target_role_min_annual_salary, count(*) FILTER (target IS NOT NULL AND salary IS NOT NULL) AS target_role_valid_salary_lca_count,
       count(*) FILTER (target IS NOT NULL AND salary IS NULL) AS target_role_invalid_salary_lca_count, coalesce(bool_or(product), false) AS has_product_role_job,
       coalesce(bool_or(manager), false) AS has_product_manager_job, count(*) FILTER (product) AS product_role_lca_count, max(decision_date) AS last_decision_date,
       (SELECT max(decision_date) FROM filings) AS dataset_max_decision_date
FROM rows GROUP BY fein""",
    "salary_quartiles": f"""
WITH filings AS ({FILINGS}), rows AS (SELECT job_title AS group_key, CAST({_SALARY} AS double) AS salary FROM filings)
SELECT group_key, count(*) AS n, round(quantile_cont(salary, 0.25) + 1e-7, 2) AS p25, round(quantile_cont(salary, 0.5) + 1e-7, 2) AS p50, round(quantile_cont(salary, 0.75) + 1e-7, 2) AS p75
FROM rows WHERE salary IS NOT NULL GROUP BY group_key""",
    "crawl_health": f"""
WITH runs AS ({RUNS}), sites AS ({SITES}), rows AS (SELECT *, started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS recent FROM runs JOIN sites USING (site_id)),
g AS (SELECT source_type, count(*) FILTER (recent) AS runs, count(*) FILTER (recent AND status = 'succeeded') AS successes, count(*) FILTER (recent AND status = 'failed') AS failures,
             CAST(coalesce(sum(parsed_job_count) FILTER (recent), 0) AS BIGINT) AS parsed_jobs, max(started_at) AS last_run_at FROM rows GROUP BY source_type)
SELECT *, round(CASE WHEN runs > 0 THEN CAST(successes AS double) / runs END, 4) AS success_rate FROM g""",
    "crawl_failures": f"""
WITH sites AS ({SITES}), g AS (SELECT source_type, {_REASON} AS failure_reason, count(*) AS failed_sites FROM sites GROUP BY ALL)
SELECT *, CAST(round(failed_sites * 100.0 / sum(failed_sites) OVER (), 2) AS double) AS pct_all_failed FROM g""",
    "snapshot_diff": f"""
WITH old AS (SELECT *, {SCOPE} AS scope FROM ({SEEN.format("<")}) WHERE latest = 1), stage AS (SELECT *, {SCOPE} AS scope FROM ({SEEN.format(">=")}) WHERE latest = 1),
seen AS (SELECT site_id, external_job_id FROM stage WHERE scope = 'US'),
j AS (SELECT coalesce(o.site_id, s.site_id) AS site_id, o.site_id IS NOT NULL AS known, s.site_id IS NOT NULL AS present, o.active, o.scope
      FROM old o FULL JOIN seen s ON o.site_id = s.site_id AND o.external_job_id = s.external_job_id)
SELECT site_id, count(*) FILTER (present AND NOT known) AS new_jobs, count(*) FILTER (present AND known AND active) AS updated_jobs, count(*) FILTER (present AND known AND NOT active) AS reopened_jobs,
       count(*) FILTER (NOT present AND active AND scope = 'US' AND site_id IN (SELECT site_id FROM stage)) AS closed_jobs
FROM j GROUP BY site_id""",
}
