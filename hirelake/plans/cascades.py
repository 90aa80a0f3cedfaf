"""Registered queries of changes to several tables and of writes that are read back, with the same results in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hirelake.functions.market import market_scope
from hirelake.functions.money import next_crawl
from hirelake.operators import dashboard, discovery, labels, pages
from hirelake.operators.cascades import FOUND, STALE_SITE, fail_stale, finalize_runs, refresh_run_counts, resolve_failed_sites
from hirelake.operators.runs import adapter_health
from hirelake.operators.sites import INTERVALS
from hirelake.plans.catalog import SCOPE
from hirelake.plans.companies import FEIN, SITE_ROWS, STATES, TARGETS, rows_sql
from hirelake.plans.fixtures import AS_OF, ERRORS, RUNS, SEEN_EVER, SITES, SOURCES, SPLIT, TITLES, pick, view
from hirelake.plans.jobs import _D, DECISIONS, FULL_SITES, HOSTS, LABEL_ROWS, PATHS, QUEUED, _surface
from hirelake.plans.jobs import ORACLES as JOB_SQL
from hirelake.plans.status import SITES as STATUS_SITES
from hirelake.plans.status import WIDE_TARGETS
from hirelake.sources.shared import shared_root
from hirelake.sources.tables import delete_keys, export_csv, fitting_rows, malformed_rows, overwrite_partitions

RESULTS = f"""
SELECT {pick(('r1', 'r2', 'r3'), 'c_custkey')} AS run_id, {FEIN.format('c_custkey')} AS consolidation_key, c_name AS canonical_name, concat(c_name, ' careers') AS search_query, c_custkey % 5 <> 0 AS search_succeeded, c_custkey % 4 AS candidate_count,
       CASE WHEN c_custkey % 5 = 0 THEN 'boom' ELSE '' END AS error_message FROM customer WHERE c_custkey % 2 = 0"""
LEDGER = rows_sql("run_id, cohort, target_count, search_count, candidate_count, error_count, estimated_credits, status", ("r2", "old", 5, 5, 7, 1, 5, "running"), ("r9", "old", 1, 1, 1, 0, 1, "running"))
TRIED = f"SELECT {pick(('r1', 'r2', 'r3'), 'c_custkey')} AS run_id, 'old' AS cohort, {FEIN.format('c_custkey')} AS consolidation_key, 'old name' AS canonical_name, 'P9' AS priority_tier, 'q' AS search_query, false AS search_succeeded, 0 AS candidate_count, 'old' AS error_message, TIMESTAMP '{SPLIT}' AS attempted_at FROM customer WHERE c_custkey % 4 < 2"
_CANDIDATE = f"CAST(page_id % 3 + 1 AS integer) AS candidate_rank, CAST(page_id % 90 AS double) AS candidate_score, concat('q', CAST(page_id % 8 AS varchar(9))) AS search_query, CASE WHEN page_id % 6 = 0 THEN '' ELSE 'Jobs' END AS evidence_title"
_SITE = f"{FEIN.format('page_id % 60')} AS consolidation_key, concat('https://', {pick(HOSTS, 'page_id')}, {pick(PATHS, 'page_id')}, '/', CAST(page_id AS varchar(20))) AS site_url, {pick(HOSTS, 'page_id')} AS normalized_domain, {pick(SOURCES, 'page_id')} AS source_type"
CANDIDATES = f"SELECT {pick(('r1', 'r2', 'r3'), 'page_id % 60')} AS run_id, {_SITE}, {_CANDIDATE} FROM pages WHERE page_id % 3 <> 0"
LISTED = f"SELECT {_SITE.replace(pick(SOURCES, 'page_id'), pick(SOURCES, 'page_id + 1'))}, {_CANDIDATE.replace('page_id % 90', 'page_id % 7')}, 'by_hand' AS discovery_source, 'verified' AS verification_status, true AS crawl_enabled, 'succeeded' AS crawl_status, TIMESTAMP '{SPLIT}' AS last_discovered_at FROM pages WHERE page_id % 2 = 0"
BATCH_RUNS = RUNS.replace(" FROM events", ", user_id % 30 AS batch_id, CAST(NULL AS varchar(9)) AS error_code, CASE WHEN event_id % 2 = 0 THEN NULL ELSE ts END AS finished_at FROM events").replace("event_id % 97 = 0", "event_id % 997 = 0")
BATCHES = f"SELECT DISTINCT user_id % 30 AS batch_id, {pick(('running', 'completed'), 'user_id % 30')} AS status, CAST(user_id % 30 % 3 AS integer) AS failed_target_count, CAST(NULL AS timestamp) AS finished_at FROM events"
BATCH_TARGETS = "SELECT DISTINCT user_id % 30 AS batch_id, user_id % 20 AS site_id, 'succeeded' AS status FROM events"
CRAWLED = f"SELECT page_id AS site_id, 'succeeded' AS crawl_status, CAST(page_id % 4 AS integer) AS consecutive_failures, {pick(ERRORS, 'page_id')} AS last_error, TIMESTAMP '{SPLIT}' AS next_crawl_at FROM pages"
#: A table by state; then some states come anew, and some companies go.
STORED = f"SELECT {FEIN.format('c_custkey')} AS fein, c_name AS name, c_custkey % 50 AS lca_count, {pick(STATES, 'c_nationkey')} AS state FROM customer"
FRESH = f"SELECT fein, name, lca_count + 1000 AS lca_count, state FROM ({STORED}) s WHERE state IN ('TX', 'NY') AND lca_count % 2 = 0"
GONE = f"SELECT {FEIN.format('c_custkey')} AS fein FROM customer WHERE c_mktsegment = 'BUILDING'"
#: Titles with what CSV has to quote.
EXPORTED = f"SELECT concat({pick(TITLES, 'l_partkey')}, {pick((', senior', ' “x” \"y\"', '', ' a;b'), 'l_suppkey')}) AS title, count(*) AS postings, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE 'note' END AS note FROM lineitem GROUP BY 1"


def _finalized(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    customers = lambda sql: view(spark, sf_dir, sql, "customer")
    pages = lambda sql: view(spark, sf_dir, sql, "pages")
    at = F.lit(SPLIT).cast("timestamp")
    ledger = spark.sql(LEDGER).withColumns({"started_at": at, "finished_at": F.lit(None).cast("timestamp")})
    targets = customers(QUEUED).join(customers(TARGETS).select("consolidation_key", "priority_tier", "priority_score"), "consolidation_key")
    return finalize_runs(customers(RESULTS), pages(CANDIDATES), targets, ledger, customers(TRIED), pages(LISTED), "p1", "web_search", AS_OF)


def _stale(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = lambda sql: view(spark, sf_dir, sql, "events")
    return fail_stale(events(BATCH_RUNS), events(BATCH_TARGETS), events(BATCHES), view(spark, sf_dir, CRAWLED, "pages"), SPLIT)


def discovery_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finalized(spark, sf_dir)["runs"]


def discovery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finalized(spark, sf_dir)["attempts"]


def discovery_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finalized(spark, sf_dir)["sites"]


def discovery_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finalized(spark, sf_dir)["targets"]


def stale_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stale(spark, sf_dir)["batches"]


def stale_batch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stale(spark, sf_dir)["batch_targets"]


def stale_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stale(spark, sf_dir)["sites"]


def refreshed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_root(spark)}/states-{uuid.uuid4().hex}"
    customers = lambda sql: view(spark, sf_dir, sql, "customer")
    overwrite_partitions(customers(STORED), path, ["state"])
    overwrite_partitions(customers(FRESH), path, ["state"])
    return delete_keys(spark.read.parquet(path), customers(GONE), ["fein"])


def exported_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sorted export reads back as, with the place of each row in the files."""
    path = f"{shared_root(spark)}/titles-{uuid.uuid4().hex}"
    export_csv(view(spark, sf_dir, EXPORTED, "lineitem"), path, [F.desc("postings"), "title"])
    schema = StructType([StructField("title", StringType()), StructField("postings", LongType()), StructField("note", StringType())])
    rows = fitting_rows(spark, path, schema).select("*", F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("line"))
    # The places of a part start after the rows of all parts before it; parts are few.
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    first = rows.groupBy("part").agg(F.min("line").alias("first"))
    placed = rows.join(F.broadcast(before), "part").join(F.broadcast(first), "part")
    bad = F.broadcast(malformed_rows(spark, path, schema).agg(F.count("*").alias("malformed")))
    return placed.crossJoin(bad).select("title", "postings", "note", (F.col("before") + F.col("line") - F.col("first") + 1).alias("place"), "malformed")


HEALTH_RUNS = RUNS.replace(" FROM events", ", event_id % 9 AS requests_count, event_id % 800 AS latency_ms FROM events")
#: Pages of two boards: a listing of three jobs, and a content list of two.
LISTING = f"""
SELECT page_id % 40 AS site_id, page_id AS fetched_at, 'https://acme.wd5.example.com/jobs' AS base_url, concat('{{{{"jobPostings":[{{{{"title":" ', {pick(TITLES, 'page_id')}, ' &amp; Co","externalPath":"/job/', CAST(page_id % 7 AS varchar(9)), '","locationsText":"', {pick(('Chicago, IL', 'London', '2 Locations'), 'page_id')},
       '","postedOn":"Posted Today","bulletFields":[', CASE WHEN page_id % 3 = 0 THEN concat('"R-', CAST(page_id % 5 AS varchar(9)), '"') ELSE '' END, ']}}}},{{{{"title":"","externalPath":"/x"}}}},{{{{"title":"Analyst","externalPath":"/job/a","timeType":"Full time"}}}}]}}}}') AS body FROM pages"""
CONTENT = f"""
SELECT page_id % 40 AS site_id, page_id AS fetched_at, 'acme' AS token, concat('{{{{"content":[{{{{"id":', CASE WHEN page_id % 4 = 0 THEN '""' ELSE CAST(page_id % 6 AS varchar(9)) END, ',"refNumber":"REF', CAST(page_id % 3 AS varchar(9)), '","name":"', {pick(TITLES, 'page_id')}, '","location":{{{{"city":"', {pick(('Austin, TX', 'Berlin, Germany', ''), 'page_id')}, '","region":"TX"}}}},"department":',
       {pick(('{{"label":"Eng"}}', '"Ops"', '{{"name":"Sales","id":"4"}}', 'null'), 'page_id')}, ',"industry":"IT","releasedDate":"2024-01-02","experienceLevel":"Senior"', CASE WHEN page_id % 2 = 0 THEN ',"ref":"https://r/1"' ELSE '' END, '}}}}]}}}}') AS body FROM pages"""
MARKED = f"SELECT made.*, event_id % 7 = 0 AS applied FROM ({DECISIONS}) made"
OUTCOME = f"SELECT c_custkey AS site_id, c_custkey % 3 <> 0 AS succeeded, CAST(c_custkey % 9 AS integer) AS failures, {pick(('P0', 'P1', 'P2', 'P3', None), 'c_custkey')} AS tier, TIMESTAMP '{AS_OF}' AS ended_at FROM customer"


FINISHED = f"""
SELECT r.*, run_id % 30 AS batch_id, started_at + INTERVAL '1' HOUR AS finished_at, CAST(run_id % 4 AS bigint) AS target_job_count, CAST(run_id % 3 AS bigint) AS review_job_count FROM ({RUNS}) r"""
COUNTED = "SELECT DISTINCT event_id % 30 AS batch_id, CAST(-1 AS bigint) AS target_job_count, CAST(-1 AS bigint) AS review_job_count FROM events"
SEEN_LAST = f"SELECT site_id, external_job_id, title, lower(title) AS normalized_title, location, active, event_id AS last_run_id FROM ({SEEN_EVER}) s WHERE latest = 1"
LATE = "2024-01-29 06:00:00"
FAILED_SITES = f"SELECT s.*, {pick(('HTTP Error 404', 'x 404 y', 'Timed out', '403', 'boom', None), 'site_id % 23')} AS last_error FROM ({STATUS_SITES}) s"
FAILED_TARGETS = f"SELECT t.*, TIMESTAMP '{SPLIT}' AS next_discovery_at FROM ({WIDE_TARGETS}) t"


def _refreshed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    events = lambda sql: view(spark, sf_dir, sql, "events")
    seen = events(SEEN_LAST).withColumn("market_scope", market_scope(F.col("location")))
    return refresh_run_counts(events(FINISHED), events(COUNTED), seen, spark.sql(LABEL_ROWS), LATE, 96)


def _resolved(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    failed = F.when(F.col("site_id") % 4 != 0, "failed").otherwise(F.col("crawl_status"))
    sites = view(spark, sf_dir, FAILED_SITES, "pages").withColumns({"crawl_status": failed, "crawl_enabled": F.col("crawl_enabled") | (F.col("site_id") % 7 == 2)})
    return resolve_failed_sites(sites, view(spark, sf_dir, FAILED_TARGETS, "customer"), AS_OF)


def refreshed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)["runs"].select("run_id", "batch_id", "target_job_count", "review_job_count")


def refreshed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)["batches"]


def resolved_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)["sites"].select("site_id", "verification_status", "crawl_status", "crawl_enabled", "next_crawl_at", "reviewed_by")


def resolved_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)["targets"].select("consolidation_key", "discovery_status", "next_discovery_at")


def application_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.application_mix(_surface(spark, sf_dir))


def adapter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter_health(view(spark, sf_dir, HEALTH_RUNS, "events"), view(spark, sf_dir, SITES, "pages"), AS_OF)


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    decisions = view(spark, sf_dir, MARKED, "events")
    _, history = labels.apply_model_decisions(spark.sql(LABEL_ROWS), decisions.where("NOT applied").select("normalized_title", "classification_status", "confidence", "created_at"), 5, AS_OF)
    return decisions, history


def model_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.mark_applied(*_applied(spark, sf_dir)).groupBy("normalized_title", "applied").agg(F.count("*").alias("decisions"))


def model_applied_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.applied_counts(_applied(spark, sf_dir)[1])


def discovery_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discovery_dates(view(spark, sf_dir, SITE_ROWS, "pages"), view(spark, sf_dir, TARGETS, "customer"), AS_OF)


def trusted_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, FULL_SITES, "pages").withColumns({"verification_status": F.when(F.col("site_id") % 9 < 7, "unverified").otherwise(F.col("verification_status")), "reviewed_by": F.lit("ann")})
    return discovery.auto_trust_sites(sites, view(spark, sf_dir, TARGETS, "customer")).select("site_id", "verification_status", "crawl_enabled", "crawl_status", "scope_method", "reviewed_by")


def listing_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.normalize_listing_payloads(view(spark, sf_dir, LISTING, "pages"))


def content_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.normalize_content_payloads(view(spark, sf_dir, CONTENT, "pages"))


def next_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OUTCOME, "customer").select("site_id", next_crawl(F.col("ended_at"), F.col("succeeded"), F.col("failures"), F.col("tier"), INTERVALS).alias("next_crawl_at"))


QUERIES = {f.__name__: f for f in (discovery_runs, discovery_attempts, discovery_sites, discovery_targets, stale_batches, stale_batch_targets, stale_sites, refreshed_states, exported_titles,
        application_mix, adapter_report, model_applied, model_applied_counts, discovery_dates, trusted_sites, listing_jobs, content_jobs, next_crawls,
        refreshed_runs, refreshed_batches, resolved_sites, resolved_targets)}

_S = f"s AS (SELECT * REPLACE (nullif(error_message, '') AS error_message) FROM ({RESULTS}))"
_LATE = f"late AS (SELECT run_id, batch_id, site_id FROM ({BATCH_RUNS}) WHERE status = 'running' AND started_at < TIMESTAMP '{SPLIT}' - INTERVAL 60 MINUTE)"
_NORMAL = "trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_+#./-]+', ' ', 'g'), ' +', ' ', 'g'))"
_COUNTS = f"""
p AS (SELECT last_run_id, classification_status AS st FROM (SELECT *, {SCOPE} AS scope FROM ({SEEN_LAST})) JOIN ({LABEL_ROWS}) l USING (normalized_title) WHERE active AND scope = 'US'),
k AS (SELECT last_run_id AS run_id, count(*) FILTER (st = 'target') AS t, count(*) FILTER (st = 'review') AS v FROM p GROUP BY 1),
n AS (SELECT run_id, batch_id, hit, CASE WHEN hit THEN t ELSE target_job_count END AS target_job_count, CASE WHEN hit THEN v ELSE review_job_count END AS review_job_count FROM (SELECT *, t IS NOT NULL AND status = 'succeeded' AND finished_at >= TIMESTAMP '{LATE}' - INTERVAL 96 HOUR AS hit FROM ({FINISHED}) f LEFT JOIN k USING (run_id)))"""
_RESOLVED = f"""
s AS (SELECT * REPLACE (CASE WHEN site_id % 4 <> 0 THEN 'failed' ELSE crawl_status END AS crawl_status, crawl_enabled OR site_id % 7 = 2 AS crawl_enabled) FROM ({FAILED_SITES})),
d AS (SELECT site_id, s.consolidation_key, CASE WHEN contains(e, '404') AND priority_tier = 'P1' AND consecutive_failures >= 2 THEN 'reject' WHEN contains(e, '404') THEN 'demote' WHEN regexp_matches(e, 'timeout|timed out|403|forbidden') THEN 'retry' END AS action
  FROM (SELECT *, lower(coalesce(last_error, '')) AS e FROM s) s JOIN ({FAILED_TARGETS}) t USING (consolidation_key) WHERE enabled AND verification_status = 'verified' AND crawl_enabled AND crawl_status = 'failed'),
z AS (SELECT site_id, consolidation_key, CASE action WHEN 'reject' THEN 'rejected' WHEN 'demote' THEN 'unverified' ELSE verification_status END AS verification_status, CASE action WHEN 'reject' THEN 'paused' WHEN 'demote' THEN 'pending' WHEN 'retry' THEN 'pending' ELSE crawl_status END AS crawl_status,
  crawl_enabled AND coalesce(action, '') NOT IN ('reject', 'demote') AS crawl_enabled, CASE WHEN action IN ('reject', 'demote') THEN NULL WHEN action = 'retry' THEN TIMESTAMP '{AS_OF}' ELSE next_crawl_at END AS next_crawl_at, CASE WHEN action = 'demote' THEN 'system:failed-site-cleanup' ELSE reviewed_by END AS reviewed_by
  FROM s LEFT JOIN (SELECT site_id, action FROM d) USING (site_id))"""
_APPLIED = f"""
m AS (SELECT * FROM ({MARKED})), x AS (SELECT normalized_title, arg_max((classification_status, confidence), (created_at, classification_status)) AS x FROM m WHERE NOT applied GROUP BY 1), l AS ({LABEL_ROWS}),
r AS (SELECT normalized_title, x[1] AS st FROM x WHERE (x[1] = 'target' AND x[2] >= 0.88 OR x[1] = 'non_target' AND x[2] >= 0.84) AND normalized_title IN (SELECT normalized_title FROM l WHERE classification_status = 'review' AND NOT coalesce(rule_version LIKE 'manual%', false)) ORDER BY x[2] DESC, normalized_title LIMIT 5)"""

ORACLES = {
    "discovery_runs": f"""
WITH {_S}, g AS (SELECT run_id, 'p1' AS cohort, count(*) AS target_count, count(*) AS search_count, CAST(sum(candidate_count) AS BIGINT) AS candidate_count, count(*) FILTER (NOT search_succeeded) AS error_count, count(*) AS estimated_credits FROM s GROUP BY 1),
u AS (SELECT run_id, cohort, target_count, search_count, candidate_count, error_count, estimated_credits, status, TIMESTAMP '{SPLIT}' AS started_at FROM ({LEDGER}) UNION ALL SELECT *, 'running', TIMESTAMP '{AS_OF}' FROM g WHERE run_id NOT IN (SELECT run_id FROM ({LEDGER})))
SELECT * EXCLUDE (status), CASE WHEN run_id IN (SELECT run_id FROM s) THEN 'completed' ELSE status END AS status, CASE WHEN run_id IN (SELECT run_id FROM s) THEN TIMESTAMP '{AS_OF}' END AS finished_at FROM u""",
    "discovery_attempts": f"""
WITH {_S} SELECT run_id, 'p1' AS cohort, consolidation_key, s.canonical_name, priority_tier, search_query, search_succeeded, candidate_count, error_message, TIMESTAMP '{AS_OF}' AS attempted_at FROM s LEFT JOIN ({TARGETS}) t USING (consolidation_key)
UNION ALL SELECT * FROM ({TRIED}) a WHERE (run_id, consolidation_key) NOT IN (SELECT (run_id, consolidation_key) FROM s)""",
    "discovery_sites": f"""
WITH c AS (SELECT * FROM ({CANDIDATES}) QUALIFY row_number() OVER (PARTITION BY consolidation_key, site_url ORDER BY run_id DESC, candidate_rank) = 1), l AS ({LISTED})
SELECT c.consolidation_key, c.site_url, {', '.join(f"nullif(c.{x}, '') AS {x}" if x == 'evidence_title' else f'c.{x}' for x in FOUND)}, coalesce(l.discovery_source, 'web_search') AS discovery_source, coalesce(l.verification_status, 'unverified') AS verification_status, coalesce(l.crawl_enabled, false) AS crawl_enabled, coalesce(l.crawl_status, 'pending') AS crawl_status, TIMESTAMP '{AS_OF}' AS last_discovered_at
FROM c LEFT JOIN l USING (consolidation_key, site_url)
UNION ALL SELECT consolidation_key, site_url, {', '.join(FOUND)}, discovery_source, verification_status, crawl_enabled, crawl_status, last_discovered_at FROM l ANTI JOIN c USING (consolidation_key, site_url)""",
    "discovery_targets": f"""
WITH {_S} SELECT consolidation_key, CASE WHEN search_succeeded IS NULL THEN discovery_status WHEN search_succeeded AND candidate_count > 0 THEN 'review_pending' WHEN search_succeeded THEN 'not_found' ELSE 'retry' END AS discovery_status,
  CASE WHEN search_succeeded IS NULL THEN next_discovery_at WHEN search_succeeded AND candidate_count > 0 THEN NULL WHEN search_succeeded THEN TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY ELSE TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY END AS next_discovery_at,
  CASE WHEN search_succeeded IS NULL THEN consecutive_discovery_failures WHEN search_succeeded THEN 0 ELSE consecutive_discovery_failures + 1 END AS consecutive_discovery_failures, priority_tier, priority_score
FROM ({QUEUED}) q JOIN (SELECT consolidation_key, priority_tier, priority_score FROM ({TARGETS})) t USING (consolidation_key) LEFT JOIN s USING (consolidation_key)""",
    "stale_batches": f"""
WITH {_LATE}, b AS (SELECT *, status = 'running' AND batch_id IN (SELECT batch_id FROM late) AS fails FROM ({BATCHES}))
SELECT batch_id, CASE WHEN fails THEN 'failed' ELSE status END AS status, CASE WHEN fails THEN greatest(failed_target_count, 1) ELSE failed_target_count END AS failed_target_count, CASE WHEN fails THEN coalesce(finished_at, TIMESTAMP '{SPLIT}') ELSE finished_at END AS finished_at FROM b""",
    "stale_batch_targets": f"WITH {_LATE} SELECT batch_id, site_id, CASE WHEN (batch_id, site_id) IN (SELECT (batch_id, site_id) FROM late) THEN 'failed' ELSE status END AS status FROM ({BATCH_TARGETS})",
    "stale_sites": f"""
WITH {_LATE}, x AS (SELECT *, site_id IN (SELECT site_id FROM late) AS hit FROM ({CRAWLED}))
SELECT site_id, CASE WHEN hit THEN 'failed' ELSE crawl_status END AS crawl_status, consecutive_failures + CAST(hit AS integer) AS consecutive_failures, CASE WHEN hit THEN '{STALE_SITE}' ELSE last_error END AS last_error, CASE WHEN hit THEN TIMESTAMP '{SPLIT}' + INTERVAL 6 HOUR ELSE next_crawl_at END AS next_crawl_at FROM x""",
    "application_mix": f"WITH {_D}, c AS (SELECT application_status, count(*) AS jobs FROM d WHERE role_status = 'target' AND priority_tier IN ('P0', 'P1', 'P2', 'P3') GROUP BY 1) SELECT application_status, jobs, round(100.0 * CAST(jobs AS double) / sum(jobs) OVER (), 1) AS pct FROM c",
    "adapter_report": f"""
WITH rows AS (SELECT *, started_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AS recent FROM ({HEALTH_RUNS}) r JOIN ({SITES}) s USING (site_id)),
g AS (SELECT source_type, count(*) FILTER (recent) AS runs, count(*) FILTER (recent AND status = 'succeeded') AS successes, count(*) FILTER (recent AND status = 'failed') AS failures, CAST(coalesce(sum(parsed_job_count) FILTER (recent), 0) AS BIGINT) AS parsed_jobs, max(started_at) AS last_run_at,
  CAST(coalesce(sum(requests_count) FILTER (recent), 0) AS BIGINT) AS requests, round(avg(latency_ms) FILTER (recent)) AS avg_latency_ms FROM rows GROUP BY source_type)
SELECT *, round(CASE WHEN runs > 0 THEN CAST(successes AS double) / runs END, 4) AS success_rate FROM g""",
    "model_applied": f"WITH {_APPLIED} SELECT normalized_title, applied OR normalized_title IN (SELECT normalized_title FROM r) AS applied, count(*) AS decisions FROM m GROUP BY 1, 2",
    "model_applied_counts": f"WITH {_APPLIED} SELECT count(*) AS applied_count, count(*) FILTER (st = 'target') AS target_count, count(*) FILTER (st = 'non_target') AS non_target_count FROM r",
    "discovery_dates": f"""
WITH r AS (SELECT consolidation_key, bool_or(verification_status = 'verified') AS v, bool_or(verification_status = 'unverified') AS u FROM ({SITE_ROWS}) GROUP BY 1), x AS (SELECT consolidation_key, CASE WHEN v THEN 'found' WHEN u THEN 'review_pending' ELSE 'not_found' END AS discovery_status FROM ({TARGETS}) LEFT JOIN r USING (consolidation_key))
SELECT *, CASE WHEN discovery_status = 'not_found' THEN TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY END AS next_discovery_at FROM x""",
    "trusted_sites": f"""
WITH s AS (SELECT * REPLACE (CASE WHEN site_id % 9 < 7 THEN 'unverified' ELSE verification_status END AS verification_status) FROM ({FULL_SITES})), h AS (SELECT site_id FROM ({JOB_SQL['auto_trusted']}))
SELECT site_id, CASE WHEN hit THEN 'verified' ELSE verification_status END AS verification_status, hit OR crawl_enabled AS crawl_enabled, CASE WHEN hit THEN 'pending' ELSE crawl_status END AS crawl_status, CASE WHEN hit THEN 'local_filter' ELSE scope_method END AS scope_method, CASE WHEN hit THEN 'system:structured-ats-best' ELSE 'ann' END AS reviewed_by
FROM (SELECT *, site_id IN (SELECT site_id FROM h) AS hit FROM s)""",
    "listing_jobs": f"""
WITH j AS (SELECT page_id % 40 AS site_id, page_id, 0 AS k, CASE WHEN page_id % 3 = 0 THEN concat('R-', page_id % 5) ELSE concat('/job/', page_id % 7) END AS external_job_id, concat({pick(TITLES, 'page_id')}, ' & Co') AS title, {pick(('Chicago, IL', 'London', '2 Locations'), 'page_id')} AS location, concat('/job/', page_id % 7) AS path, 'Posted Today' AS posted_text, '' AS employment_type FROM pages
  UNION ALL SELECT page_id % 40, page_id, 2, '/job/a', 'Analyst', '', '/job/a', '', 'Full time' FROM pages), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY site_id, external_job_id ORDER BY page_id DESC, k DESC) = 1)
SELECT site_id, external_job_id, title, {_NORMAL} AS normalized_title, location, '' AS category, concat('https://acme.wd5.example.com/jobs', path) AS job_url, '' AS description_snippet, {SCOPE} AS market_scope, posted_text, employment_type FROM l""",
    "content_jobs": f"""
WITH j AS (SELECT page_id, page_id % 40 AS site_id, CASE WHEN page_id % 4 = 0 THEN concat('REF', page_id % 3) ELSE CAST(page_id % 6 AS varchar) END AS external_job_id, {pick(TITLES, 'page_id')} AS title, {pick(('Austin, TX', 'Berlin, Germany', 'TX'), 'page_id')} AS location, {pick(('Eng', 'Ops', 'Sales', 'IT'), 'page_id')} AS category FROM pages),
l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY site_id, external_job_id ORDER BY page_id DESC) = 1)
SELECT site_id, external_job_id, title, {_NORMAL} AS normalized_title, location, category, CASE WHEN page_id % 2 = 0 THEN 'https://r/1' ELSE concat('https://jobs.smartrecruiters.com/acme/', external_job_id) END AS job_url, '' AS description_snippet, {SCOPE} AS market_scope, '2024-01-02' AS posted_text, 'Senior' AS employment_type FROM l""",
    "next_crawls": f"SELECT site_id, ended_at + to_hours(CAST(CASE WHEN succeeded THEN CASE tier {' '.join(f"WHEN '{t}' THEN {h}" for t, h in INTERVALS.items())} ELSE 168 END ELSE least(24, greatest(1, pow(2, failures))) END AS BIGINT)) AS next_crawl_at FROM ({OUTCOME})",
    "refreshed_runs": f"WITH {_COUNTS} SELECT run_id, batch_id, target_job_count, review_job_count FROM n",
    "refreshed_batches": f"""
WITH {_COUNTS}, l AS (SELECT batch_id, arg_max(target_job_count, run_id) AS t, arg_max(review_job_count, run_id) AS v FROM n WHERE batch_id IN (SELECT batch_id FROM n WHERE hit) GROUP BY 1)
SELECT batch_id, coalesce(t, target_job_count) AS target_job_count, coalesce(v, review_job_count) AS review_job_count FROM ({COUNTED}) b LEFT JOIN l USING (batch_id)""",
    "resolved_sites": f"WITH {_RESOLVED} SELECT site_id, verification_status, crawl_status, crawl_enabled, next_crawl_at, reviewed_by FROM z",
    "resolved_targets": f"""
WITH {_RESOLVED}, g AS (SELECT DISTINCT consolidation_key FROM d WHERE action = 'reject' AND consolidation_key NOT IN (SELECT consolidation_key FROM z WHERE verification_status = 'verified' AND crawl_enabled))
SELECT consolidation_key, CASE WHEN consolidation_key IN (SELECT consolidation_key FROM g) THEN 'review_pending' ELSE discovery_status END AS discovery_status, CASE WHEN consolidation_key IN (SELECT consolidation_key FROM g) THEN NULL ELSE next_discovery_at END AS next_discovery_at FROM ({FAILED_TARGETS})""",
    "refreshed_states": f"SELECT * FROM (SELECT * FROM ({STORED}) WHERE state IS NULL OR state NOT IN (SELECT state FROM ({FRESH})) UNION ALL SELECT * FROM ({FRESH})) WHERE fein NOT IN (SELECT fein FROM ({GONE}))",
    "exported_titles": f"SELECT title, postings, note, row_number() OVER (ORDER BY postings DESC, title) AS place, CAST(0 AS BIGINT) AS malformed FROM ({EXPORTED})",
}
