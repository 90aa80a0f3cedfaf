"""Registered jobs on postings, titles, sites and pages, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.functions import roles, titles as T
from hirelake.functions.market import OUTSIDE, STATES, market_scope
from hirelake.functions.money import annual_salary
from hirelake.functions.urls import PATH_PATTERNS, classify_url, path_pattern, posting_id, url_host, url_parts, url_path
from hirelake.operators import dashboard, discovery, labels, pages, postings, queues, repair, reports, title_model
from hirelake.operators.activity import ZONE, posting_is_current_year
from hirelake.operators.titles import soc_match_candidates, title_catalog
from hirelake.plans.catalog import SCOPE
from hirelake.plans.companies import FEIN, HISTORY, SITE_ROWS, TARGETS, rows_sql
from hirelake.plans.fixtures import AS_OF, ERRORS, SEEN_EVER, SPLIT, TITLES, UNITS, pick, view
from hirelake.plans.reports import ACTION_ROWS, NOW, POSTINGS, UNITS as UNIT_ROWS
from hirelake.plans.titles import ORACLES as TITLE_SQL
from hirelake.plans.titles import _resolution
from hirelake.sources.shared import kept
from hirelake.sources.tables import cast_stage, insert_absent, merge_upsert

KIND, POSTED = pick(("Full-time", "Contract", "", "Part time", None), "event_id"), pick(("2024-01-05", "Posted 2023", "", "30+ days ago", "1704067200", "1672531200000"), "event_id")
JOBS = f"SELECT p.*, {KIND} AS employment_type, {POSTED} AS posted_text FROM ({POSTINGS}) p"
TRACKS = (f"{roles.TRACK}product", f"{roles.TRACK}software/data", f"{roles.TRACK}customer_success", None, "Financial and Investment Analysts")
LABEL_ROWS = rows_sql(
    "normalized_title, classification_status, canonical_role, rule_version",
    *((t.lower(), ("review", "target", "non_target", "target")[k % 4], TRACKS[k % 5] if k % 4 in (1, 3) else None, "manual-v1" if k % 5 == 0 else None) for k, t in enumerate(TITLES) if k % 8),
)
SNIPPETS = ("We will not sponsor visas", "sponsorship available", "", None, "modern technology and a visa card", "authorized to work without sponsorship")
STAGE = f"""
SELECT site_id, external_job_id, title, lower(title) AS normalized_title, location, {pick(('Eng', '', None), 'event_id')} AS category, concat('/jobs/', external_job_id) AS job_url, {pick(SNIPPETS, 'event_id')} AS description_snippet,
       {POSTED} AS posted_text, {KIND} AS employment_type, ts, event_id FROM ({SEEN_EVER}) s WHERE latest = 1"""
KNOWN = f"""
SELECT site_id, external_job_id, title, lower(title) AS normalized_title, location, CAST(NULL AS varchar(9)) AS category, 'old' AS job_url, CAST(NULL AS varchar(9)) AS description_snippet, CAST(NULL AS varchar(9)) AS posted_text,
       CAST(NULL AS varchar(9)) AS employment_type, active, ts AS first_seen_at, ts AS last_seen_at, CASE WHEN active THEN NULL ELSE ts END AS closed_at, event_id
FROM (SELECT user_id % 20 AS site_id, concat(CASE WHEN event_id % 3 = 0 THEN 'gone-' ELSE '' END, event_type, '-', regexp_extract(props, '([0-9]+)', 1)) AS external_job_id, {pick(TITLES, 'event_id')} AS title, {pick(('Chicago, IL', 'London', 'Remote'), 'event_id')} AS location,
      value < 30 AS active, ts, event_id, row_number() OVER (PARTITION BY user_id % 20, concat(CASE WHEN event_id % 3 = 0 THEN 'gone-' ELSE '' END, event_type, '-', regexp_extract(props, '([0-9]+)', 1)) ORDER BY ts, event_id) AS k FROM events) e WHERE k = 1"""
HOSTS = ("boards.greenhouse.io", "jobs.lever.co", "acme.wd5.myworkdayjobs.com", "www.example.com", "careers.smartrecruiters.com", "apply.workable.com", "jobs.uber.com", "x.icims.com", "recruiting.paylocity.com", "www.linkedin.com", "sub.indeed.com", "jobs.jobvite.com")
PATHS = ("/acme", "/acme/jobs/12", "/careers/acme", "/", "/a/b/c/d", "/about", "/jobs/list", "")
LINKS = f"SELECT page_id, concat('https://', {pick(HOSTS, 'page_id')}, {pick(PATHS, 'page_id % 77')}, CASE WHEN page_id % 4 = 0 THEN '?x=1' ELSE '' END) AS url FROM pages"
EXCLUDED = rows_sql("domain", ("linkedin.com",), ("indeed.com",))
RESULTS = f"SELECT {FEIN.format('page_id % 60')} AS consolidation_key, 'Acme Holdings Inc' AS canonical_name, l.url, {pick(('Official Careers at Acme', 'Jobs', '', 'News'), 'page_id')} AS title, CAST(page_id % 120 AS double) / 100 AS score FROM ({LINKS}) l"
#: What stands before and after a declared posting (lists, graphs in lists, a broken script) and how it names its type.
BEFORE = ('{{"@graph":[', '[[{{"@graph":[[{{"@graph":[{{"@graph":[', "", "{{", "[", '[{{"@type":"Other"}},')
AFTER = (',{{"@type":"Other"}}]}}', "]}}]}}]]}}]]", "", "", "]", "]")
KINDS = ('"JobPosting"', '["Thing","JobPosting"]', '"JobPosting"', '"Event"', '["JobPosting"]')
CARDS = f"""
SELECT page_id AS site_id, concat('https://jobs.example.org/p/', CAST(page_id AS varchar(20))) AS url,
       concat('<script id=x type="application/ld+json">', {pick(BEFORE, 'page_id')}, '{{{{"@type":', {pick(KINDS, 'page_id')}, ',"title":"', {pick(TITLES, 'page_id')}, ' &amp; Co","url":"/jobs/', CAST(page_id AS varchar(20)),
              '","jobLocation":{{{{"address":{{{{"addressLocality":"', {pick(('Chicago', 'London', 'Austin'), 'page_id')}, '","addressRegion":"', {pick(('IL', '', 'TX'), 'page_id')}, '"}}}}}}}},"description":"<p>Good   work</p>","datePosted":"2024-01-0', CAST(page_id % 9 + 1 AS varchar(9)), '"}}}}', {pick(AFTER, 'page_id')}, '</script>', coalesce(html, '')) AS html FROM pages"""
PLACES = ("Chicago, IL", "anywhere", "Remote", "Toronto, Canada", "in New Jersey", "Austin, TX")
LABELS = ("<b>Software</b> Engineer", "Apply now", "Data Analyst &amp; more", "Gardener", "Senior   Product Manager", "Engineer, Canada", "QA")
LINKED = f"""
SELECT page_id AS site_id, url, concat(coalesce(html, ''), '<p>', {pick(PLACES, 'page_id')}, '</p><a id="k" href="/jobs/', CAST(page_id AS varchar(20)), '?a=1&amp;b=2">', {pick(LABELS, 'page_id')}, '</a>', CASE WHEN page_id % 4 = 0 THEN repeat('filler ', 70) ELSE '' END,
       '<a href="/jobs/', CAST(page_id % 9 AS varchar(20)), '">', {pick(LABELS, 'page_id % 11')}, '</a> ', {pick(PLACES, 'page_id % 13')}, '<a href="/open">Data') AS html FROM pages"""
ANCHORS = f"SELECT page_id AS site_id, {FEIN.format('page_id % 60')} AS consolidation_key, 'Acme Holdings Inc' AS canonical_name, 'https://example.org/about' AS url, concat('<a class=x href=\"', l.url, '\">Careers</a>', coalesce(html, '')) AS html FROM ({LINKS.replace('SELECT page_id,', 'SELECT page_id, html,')}) l"
PAYLOADS = f"""
SELECT page_id % 40 AS site_id, page_id AS fetched_at, concat('{{{{"jobs":[{{{{"id":', CAST(page_id % 7 AS varchar(9)), ',"title":"', {pick(TITLES, 'page_id')}, '","location":{{{{"name":"', {pick(('Chicago, IL', 'London', 'Remote'), 'page_id')},
       '"}}}},"absolute_url":"https://x/', CAST(page_id AS varchar(9)), '","content":"&lt;b&gt;Hi&lt;/b&gt; there","updated_at":"2024-01-02","departments":[{{{{"name":"Eng"}}}},{{{{"name":"Ops"}}}}]}}}}]}}}}') AS body FROM pages"""
KEYED = f"SELECT o_orderkey AS lca_case_id, concat('I-200-', lpad(CAST(o_orderkey AS varchar(20)), 10, '0')) AS case_number, {FEIN.format('o_custkey')} AS employer_fein, CAST(o_totalprice AS decimal(14,2)) AS wage_rate_of_pay_from, {pick(UNITS, 'o_orderkey')} AS wage_unit_of_pay, CAST(o_orderdate AS date) AS decision_date FROM orders"
REPAIRS = "SELECT concat('I-200-', lpad(CAST(o_orderkey AS varchar(20)), 10, '0')) AS case_number, CAST(CAST(o_totalprice AS decimal(14,2)) AS varchar(30)) AS wage_rate_of_pay_from, 'Year' AS wage_unit_of_pay FROM orders"
SPAN = ("1992-01-01", "1999-12-31")
DECISIONS = f"SELECT lower({pick(TITLES, 'event_id')}) AS normalized_title, {pick(('target', 'non_target', 'bad', 'review'), 'event_id % 11')} AS classification_status, {pick((None, '', 'role x'), 'event_id')} AS canonical_role, ts AS decided_at, ts AS created_at, CAST(event_id % 101 AS double) / 100 AS confidence, event_id FROM events"
SCORED = f"SELECT {FEIN.format('c_custkey + 5')} AS consolidation_key, concat('new ', c_name) AS canonical_name, {pick(('P1', 'P2', None, 'P3'), 'c_custkey')} AS crawl_priority_tier, {pick(('P1', 'P3', 'P2'), 'c_custkey')} AS computed_crawl_priority_tier, CAST(c_custkey % 9 AS integer) AS priority_score FROM customer"
FORCED = f"SELECT {FEIN.format('c_custkey')} AS consolidation_key, 'by hand' AS reason, {pick(('P0', 'P1'), 'c_custkey')} AS override_tier, c_custkey % 3 <> 0 AS active FROM customer"
CHOICES = f"SELECT {FEIN.format('c_custkey')} AS consolidation_key, {pick(('P0', 'AUTO', 'P2', 'none'), 'c_custkey')} AS decision, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS bigint) AS site_id, TIMESTAMP '{AS_OF}' AS decided_at FROM customer"
FULL_SITES = f"SELECT s.*, {pick(HOSTS, 'site_id')} AS normalized_domain, concat('https://', {pick(HOSTS, 'site_id')}, {pick(PATHS, 'site_id % 77')}) AS site_url, CAST(site_id % 50 AS double) AS candidate_score, {pick(ERRORS, 'site_id')} AS last_error FROM ({SITE_ROWS}) s"
OUTCOMES = f"SELECT {FEIN.format('c_custkey')} AS consolidation_key, c_custkey % 5 <> 0 AS search_succeeded, c_custkey % 3 AS candidate_count FROM customer"
QUEUED = f"SELECT consolidation_key, {pick(('pending', 'found'), 'CAST(consolidation_key AS bigint)')} AS discovery_status, TIMESTAMP '{AS_OF}' AS next_discovery_at, CAST(CAST(consolidation_key AS bigint) % 4 AS integer) AS consecutive_discovery_failures FROM ({TARGETS}) t"
MERGES = f"SELECT {FEIN.format('c_custkey')} AS old_key, {FEIN.format('c_custkey + 1000')} AS new_key FROM customer"
QUERY = "manager chicago"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, JOBS, "events").withColumn("market_scope", market_scope(F.col("location")))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TARGETS, "customer")


def _surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = view(spark, sf_dir, ACTION_ROWS, "events")
    return dashboard.dashboard_jobs(dashboard.postings_us(_jobs(spark, sf_dir), SPLIT[:10]), _targets(spark, sf_dir), spark.sql(LABEL_ROWS), actions)


def _labels(spark: SparkSession) -> DataFrame:
    return spark.sql(LABEL_ROWS)


def current_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).groupBy("posted_text", posting_is_current_year(F.col("posted_text"), F.lit(SPLIT[:10]).cast("date")).alias("current")).agg(F.count("*").alias("postings"))


def dashboard_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surface(spark, sf_dir).drop("first_seen_at")


def dashboard_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.bucket_counts(_surface(spark, sf_dir))


def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.search_jobs(_surface(spark, sf_dir), QUERY).select("site_id", "external_job_id", "title", "location")


def job_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.job_mix(_surface(spark, sf_dir), NOW)


def hiring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.hiring_summary(_surface(spark, sf_dir), "000001")


def title_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = _jobs(spark, sf_dir).where("market_scope = 'US'")
    catalog = soc_match_candidates(title_catalog(us, _labels(spark)), _resolution(spark, sf_dir))
    return dashboard.title_review_queue(catalog, reports.title_examples(us))


def local_day_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).where(dashboard.local_day_window(F.col("first_seen_at"), "2024-01-18", ZONE)).groupBy("site_id").agg(F.count("*").alias("postings"))


def job_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = view(spark, sf_dir, ACTION_ROWS, "events").withColumn("updated_at", F.lit(None).cast("timestamp"))
    chosen = view(spark, sf_dir, f"SELECT site_id, external_job_id, {pick(('applied', 'unknown', 'saved'), 'event_id')} AS action_status, ts AS decided_at FROM ({STAGE}) s", "events")
    return dashboard.apply_actions(actions, chosen, AS_OF).groupBy("action_status").agg(F.count("*").alias("jobs"), F.count("updated_at").alias("updated"))


def snapshot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = lambda sql: view(spark, sf_dir, sql, "events").withColumn("market_scope", market_scope(F.col("location")))
    stage = scoped(STAGE)
    return postings.apply_snapshot(scoped(KNOWN).drop("event_id"), postings.admitted(stage), AS_OF, crawled=stage.select("site_id"))


def snapshot_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = view(spark, sf_dir, STAGE, "events").withColumn("market_scope", market_scope(F.col("location")))
    return postings.register_titles(_labels(spark), postings.admitted(stage)).select("normalized_title", "classification_status")


def snapshot_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = view(spark, sf_dir, STAGE, "events").withColumn("market_scope", market_scope(F.col("location")))
    return postings.run_counts(postings.admitted(stage), _labels(spark))


def manual_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.apply_manual_labels(_labels(spark), view(spark, sf_dir, DECISIONS, "events").select("normalized_title", "classification_status", "canonical_role", "decided_at"), AS_OF)[0]


def manual_label_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.apply_manual_labels(_labels(spark), view(spark, sf_dir, DECISIONS, "events").select("normalized_title", "classification_status", "canonical_role", "decided_at"), AS_OF)[1].select("normalized_title", "classification_status", "previous_status", "source")


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.apply_model_decisions(_labels(spark), view(spark, sf_dir, DECISIONS, "events").select("normalized_title", "classification_status", "confidence", "created_at"), 5, AS_OF)[0].select("normalized_title", "classification_status", "rule_version")


def soc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = soc_match_candidates(title_catalog(_jobs(spark, sf_dir), _labels(spark)), _resolution(spark, sf_dir))
    return labels.apply_soc_labels(_labels(spark), catalog.select("normalized_title", "suggested_status")).select("normalized_title", "classification_status", "rule_version")


def wage_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_wages(view(spark, sf_dir, KEYED, "orders"), view(spark, sf_dir, REPAIRS, "orders"), *SPAN)[0]


def wage_repair_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_backup(view(spark, sf_dir, KEYED, "orders"), view(spark, sf_dir, REPAIRS, "orders"), *SPAN)


def wage_repair_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.guard_counts(view(spark, sf_dir, KEYED, "orders"), view(spark, sf_dir, REPAIRS, "orders"), *SPAN)


def wage_repair_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed, backup = repair.repair_wages(view(spark, sf_dir, KEYED, "orders"), view(spark, sf_dir, REPAIRS, "orders"), *SPAN)
    members = view(spark, sf_dir, UNIT_ROWS, "customer").select("consolidation_key", "fein")
    return repair.rescored_units(fixed, backup, members, annual_salary(F.col("wage_rate_of_pay_from"), F.col("wage_unit_of_pay")))


def staged_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = view(spark, sf_dir, KEYED, "orders").select("case_number", "wage_rate_of_pay_from", "wage_unit_of_pay").schema
    return cast_stage(view(spark, sf_dir, f"SELECT case_number, CASE WHEN length(case_number) % 2 = 0 THEN concat(' ', wage_rate_of_pay_from) ELSE 'n/a' END AS wage_rate_of_pay_from, ' ' AS wage_unit_of_pay FROM ({REPAIRS}) r", "orders"), kinds)


def merged_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _targets(spark, sf_dir).select("consolidation_key", "canonical_name", "priority_score"), view(spark, sf_dir, SCORED, "customer").select("consolidation_key", "canonical_name", "priority_score")
    return merge_upsert(base, new, ["consolidation_key"], {"canonical_name": "keep", "priority_score": "greatest"})


def inserted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _targets(spark, sf_dir).select("consolidation_key", "canonical_name"), view(spark, sf_dir, SCORED, "customer").select("consolidation_key", "canonical_name")
    return insert_absent(base, new, ["consolidation_key"])


def synced_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.sync_targets(_targets(spark, sf_dir), view(spark, sf_dir, SCORED, "customer"), view(spark, sf_dir, FORCED, "customer"))


def auto_trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.auto_trusted(view(spark, sf_dir, FULL_SITES, "pages").withColumn("verification_status", F.when(F.col("site_id") % 9 < 7, "unverified").otherwise(F.col("verification_status"))), _targets(spark, sf_dir))


def reviewed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.apply_site_reviews(view(spark, sf_dir, SITE_ROWS, "pages"), view(spark, sf_dir, CHOICES, "customer")).select("site_id", "verification_status", "crawl_enabled")


def discovery_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.discovery_status(view(spark, sf_dir, SITE_ROWS, "pages"), _targets(spark, sf_dir))


def priority_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.apply_priority_overrides(view(spark, sf_dir, FORCED, "customer").drop("reason"), view(spark, sf_dir, CHOICES, "customer"))


def site_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, FULL_SITES, "pages").withColumn("host", url_host(F.col("site_url"))).withColumn("url", F.col("site_url"))
    return discovery.site_hygiene(sites, spark.sql(EXCLUDED))



def review_workbench(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, SITE_ROWS, "pages")
    verified = sites.where("verification_status = 'verified'").groupBy("consolidation_key").agg(F.min("site_id").alias("verified_site"))
    targets = _targets(spark, sf_dir).withColumn("signal", F.when(F.col("priority_score") % 3 == 0, "chicago").when(F.col("priority_score") % 3 == 1, "large_lca_sponsor"))
    bench = discovery.review_workbench(targets, queues.top_candidates(sites.where("verification_status = 'unverified'")), verified)
    return bench.select("consolidation_key", "action_status", "site_1", "verified_site", "review_rank")


def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.rank_discovery_candidates(view(spark, sf_dir, RESULTS, "pages"), spark.sql(EXCLUDED)).select("consolidation_key", "candidate_rank", "candidate_score", "site_url")


def finalized_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.finalize_discovery(view(spark, sf_dir, QUEUED, "customer"), view(spark, sf_dir, OUTCOMES, "customer"), AS_OF)


def rekeyed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.rekey_companies(view(spark, sf_dir, SITE_ROWS, "pages").select("site_id", "consolidation_key"), view(spark, sf_dir, MERGES, "customer"))


def classified_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LINKS, "pages").withColumn("c", classify_url(url_parts(F.col("url")))).select("page_id", "c.*")


def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, LINKS, "pages").select(url_host(F.col("url")).alias("host"), path_pattern(url_path(F.col("url"))).alias("pattern"), posting_id(F.col("url"), F.lit("t"), F.lit("l")).alias("id"))
    return rows.groupBy("host", "pattern").agg(F.count("*").alias("urls"), F.min("id").alias("first_id"))


def declared_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_jobposting_jsonld(view(spark, sf_dir, CARDS, "pages"))


def linked_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.link_jobs(view(spark, sf_dir, LINKED, "pages"))


def payload_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.normalize_payloads(view(spark, sf_dir, PAYLOADS, "pages"))


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = pages.page_links(view(spark, sf_dir, ANCHORS, "pages"))
    return pages.resolve_ats_links(links, spark.sql(EXCLUDED), discovery.TRUSTED).select("consolidation_key", "candidate_rank", "candidate_score", "site_url", "source_type")


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles of all pages, labelled by their language."""
    title = F.trim(F.lower(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(title.alias("normalized_title"), F.when(F.contains("html", F.lit('<html lang="en"')), "target").otherwise("non_target").alias("classification_status"))
    return rows.where("normalized_title <> ''").groupBy("normalized_title").agg(F.min("classification_status").alias("classification_status"))


def title_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(spark, sf_dir)
    return title_model.exclusive_predict(rows, rows, held=True)


def title_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(spark, sf_dir)
    return title_model.nb_evidence(rows, title_model.nb_predict(rows, rows).select("normalized_title", "predicted"))


def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_model.compare_variants(kept(_titled(spark, sf_dir), "titles"))


def title_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(spark, sf_dir)
    held = title_model.nb_predict(rows, rows, held=True)
    return held.select("normalized_title", "predicted", F.round("confidence", 5).alias("confidence"))


def title_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(spark, sf_dir)
    return title_model.nb_thresholds(rows, title_model.nb_predict(rows, rows, held=True))


QUERIES = {
    f.__name__: f
    for f in (
        current_postings, dashboard_jobs, dashboard_buckets, job_search, job_mix, hiring_summary, title_review_queue, local_day_postings, job_actions, snapshot_apply, snapshot_titles, snapshot_run_counts,
        manual_labels, manual_label_history, model_labels, soc_labels, wage_repair, wage_repair_backup, wage_repair_guards, wage_repair_rescore, staged_repairs, merged_targets, inserted_targets, synced_targets,
        auto_trusted, reviewed_sites, discovery_status, priority_overrides, site_hygiene, review_workbench, ranked_results, finalized_discovery, rekeyed_sites, classified_urls, url_templates,
        declared_jobs, linked_jobs, payload_jobs, resolved_links, title_folds, title_thresholds, title_exclusive, title_evidence, title_variants,
    )
}

_J = f"j AS (SELECT *, {SCOPE} AS market_scope FROM ({JOBS}))"
_YEAR = "CASE WHEN regexp_matches(posted_text, '^[0-9]{13}$') THEN year(make_timestamp(CAST(posted_text AS BIGINT) * 1000)) WHEN regexp_matches(posted_text, '^[0-9]{10}$') THEN year(make_timestamp(CAST(posted_text AS BIGINT) * 1000000)) ELSE TRY_CAST(nullif(regexp_extract(posted_text, '(^|[^0-9])(20[0-9]{2})([^0-9]|$)', 2), '') AS BIGINT) END"
_CURRENT = f"coalesce({_YEAR} = 2024, true)"
_FORCED = f"(({' OR '.join(f'contains(lower(title), {w!r})' for w in T.C_FAMILY)}) AND ({' OR '.join(f'contains(lower(title), {w!r})' for w in T.SOFTWARE_WORDS)}) OR regexp_matches(lower(title), '{T.PLAIN_C}'))"
_D = f"""{_J}, d AS (SELECT j.site_id, j.external_job_id, consolidation_key, t.canonical_name, priority_tier, title, normalized_title, location, employment_type, first_seen_at,
  CASE WHEN {_FORCED} THEN 'non_target' ELSE coalesce(classification_status, 'review') END AS role_status, CASE WHEN NOT {_FORCED} THEN canonical_role END AS canonical_role, coalesce(action_status, 'new') AS application_status
  FROM j JOIN ({TARGETS}) t USING (consolidation_key) LEFT JOIN ({LABEL_ROWS}) l USING (normalized_title) LEFT JOIN ({ACTION_ROWS}) a ON a.site_id = j.site_id AND a.external_job_id = j.external_job_id WHERE active AND market_scope = 'US' AND {_CURRENT})"""


_PATTERN = f"CASE {' '.join(f'WHEN regexp_matches(path, {p!r}) THEN {n!r}' for p, n in PATH_PATTERNS)} ELSE regexp_replace(path, '/[0-9]+', '/:id', 'g') END"


_CITY_STATE = rf"\b([A-Z][A-Za-z .''-]{{2,40}},\s*(?:{'|'.join(sorted(STATES.values()))}))\b"


def _unescape(x: str) -> str:
    """The entities that the given pages hold."""
    for entity, value in (("copy", "\u00a9"), ("middot", "\u00b7"), ("quot", '"'), ("amp", "&")):
        x = f"replace(replace({x}, '&{entity};', '{value}'), '&{entity}', '{value}')"
    return x


def _strip(x: str) -> str:
    spaced = lambda y: f"trim(regexp_replace({y}, '\\s+', ' ', 'g'))"
    return spaced(_unescape(f"regexp_replace({spaced(_unescape(x))}, '<[^>]+>', ' ', 'g')"))


def _any(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{column} LIKE '%{p}%'" for p in patterns) + ")" if patterns else "false"


def _family(mix: bool = False) -> str:
    more = roles.MIX_FAMILIES if mix else roles.SUPPORT_FAMILY
    parts = [f"WHEN r = '{roles.TRACK}software/data' AND {_any('n', roles.DATA_ENGINEERS)} THEN 'data_engineering'", *(f"WHEN r = '{roles.TRACK}{t}' THEN '{f}'" for t, f in roles.TRACK_FAMILIES.items())]
    parts += [f"WHEN {_any('n', p)} THEN '{f}'" for f, p in (*roles.FAMILIES, *more, *roles.LAST_FAMILIES)] + [f"WHEN {_any('lower(r)', p)} THEN '{f}'" for f, p in roles.ROLE_FAMILIES]
    return f"CASE {' '.join(parts)} ELSE concat('title:', coalesce(nullif(n, ''), nullif(r, ''), 'unclassified target title')) END"


def _stack() -> str:
    data = f"(r = '{roles.TRACK}software/data' AND {_any('n', roles.DATA_ENGINEERS + roles.DATABASES)})"
    tracks = lambda ts: "r IN (" + ", ".join(f"'{roles.TRACK}{t}'" for t in ts) + ")"
    return "CASE " + " ".join(f"WHEN {tracks(ts)} OR {_any('n', p)} OR {_any('lower(r)', q)}{' OR ' + data if k == 1 else ''} THEN '{s}'" for k, (s, ts, p, q) in enumerate(roles.STACKS)) + " ELSE 'stack_5_possible_target' END"


_STATE = lambda value: f"CASE role_status WHEN 'target' THEN {value} WHEN 'review' THEN 'needs_review' ELSE 'excluded_non_target' END"
_B = f"""{_D}, e AS (SELECT *, coalesce(canonical_role, '') AS r, normalized_title AS n, lower(coalesce(employment_type, '')) AS k, lower(coalesce(location, '')) AS p FROM d),
b AS (SELECT *, {_STATE(_stack())} AS role_stack, {_STATE(_family())} AS role_family, CASE {' '.join(f"WHEN {_any('n', parts)} THEN '{s}'" for s, parts in T.SENIORITY)} ELSE 'regular_full_time' END AS seniority_bucket,
  CASE WHEN {_any('n', T.SENIORITY[0][1])} THEN 'internship' WHEN k LIKE '%contract%' OR n LIKE '%contract%' THEN 'contract' WHEN k LIKE '%part%time%' OR n LIKE '%part time%' THEN 'part_time' WHEN k LIKE '%full%time%' THEN 'full_time' ELSE 'full_time_or_unknown' END AS employment_bucket,
  CASE WHEN p LIKE '%chicago%' OR p LIKE '%illinois%' OR regexp_matches(p, '(^|[,/ -])il($|[,/ -])') THEN 'chicago_or_illinois' WHEN p LIKE '%remote%' THEN 'remote' WHEN p = '' THEN 'location_not_listed' ELSE 'other_us' END AS location_bucket FROM e)"""
_ADMIT = f"s AS (SELECT * FROM (SELECT *, {SCOPE} AS market_scope FROM ({STAGE})) WHERE market_scope = 'US' AND NOT regexp_matches(lower(coalesce(description_snippet, '')), '{T.NO_SPONSOR}'))"
_GOOD = f"g AS (SELECT normalized_title, arg_max(classification_status, (decided_at, classification_status)) AS st, arg_max((classification_status, canonical_role), (decided_at, classification_status)) AS pair FROM ({DECISIONS}) WHERE classification_status IN ('review', 'target', 'non_target') GROUP BY 1)"
_NUMERIC = f"(regexp_matches(wage_unit_of_pay, '^[0-9]+([.][0-9]+)?$') AND decision_date BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}')"
_HOST = "regexp_replace(regexp_extract(url, '^https://([^/?#]*)', 1), '^www\\.', '')"
_WORDS = "regexp_extract_all(normalized_title, '[a-z0-9+#.]+')"
_CLASS = """u AS (SELECT *, h AS host, [x FOR x IN string_split(path, '/') IF x <> ''] AS seg, CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END AS plain FROM (
  SELECT *, {host} AS h, regexp_extract(url, '^https://([^/?#]*)', 1) AS netloc, regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1) AS path FROM ({rows}))),
c AS (SELECT *, CASE WHEN h = 'boards.greenhouse.io' AND len(seg) > 0 THEN 'greenhouse' WHEN h = 'jobs.lever.co' AND len(seg) > 0 THEN 'lever' WHEN h LIKE '%myworkdayjobs.com' THEN 'workday' WHEN h = 'careers.smartrecruiters.com' AND len(seg) > 0 THEN 'smartrecruiters'
    WHEN h = 'apply.workable.com' AND len(seg) > 0 THEN 'workable' WHEN h = 'jobs.uber.com' AND contains(path, '/jobs') THEN 'uber_jobs' WHEN h LIKE '%icims.com' THEN 'icims' WHEN h = 'recruiting.paylocity.com' AND len(seg) >= 3 THEN 'paylocity' WHEN h = 'jobs.jobvite.com' AND len(seg) > 0 THEN 'jobvite' ELSE 'generic_html' END AS source_type,
    regexp_matches(lower(path), 'career|job|join|opportunities|openings') AS career FROM u),
k AS (SELECT *, CASE WHEN source_type IN ('greenhouse', 'lever', 'smartrecruiters', 'workable') THEN seg[1] WHEN source_type = 'jobvite' THEN CASE WHEN seg[1] = 'careers' AND len(seg) >= 2 THEN seg[2] ELSE seg[1] END WHEN source_type = 'paylocity' THEN array_to_string(seg[1:3], '/')
    WHEN source_type = 'generic_html' THEN NULL ELSE h END AS source_key FROM c),
m AS (SELECT *, CASE WHEN source_type <> 'generic_html' THEN 'ats_feed' WHEN career THEN 'careers' ELSE 'corporate' END AS site_kind, concat('https://', netloc, CASE WHEN source_type IN ('greenhouse', 'lever', 'smartrecruiters', 'workable', 'paylocity') THEN '/' || source_key WHEN source_type = 'jobvite' THEN '/' || source_key || '/jobs' ELSE plain END) AS canonical_url FROM k)"""


def _classes(rows: str) -> str:
    return _CLASS.format(host=_HOST, rows=rows)


_OUT = "(h = 'linkedin.com' OR h LIKE '%.linkedin.com' OR h = 'indeed.com' OR h LIKE '%.indeed.com')"
def _titles_sql(variant: str = "baseline", prior: str = "observed") -> str:
    """Counts, sizes and held-out predictions of a variant, as CTEs."""
    stem = "CASE " + " ".join(f"WHEN ends_with(a, '{e}') AND length(a) >= {len(e) + 4} THEN left(a, length(a) - {len(e)})" for e in title_model.ENDINGS) + " ELSE a END"
    more = f", [concat('s:', {stem}) FOR a IN w IF length(a) > 2]" if variant in ("stem", "stem_char", "exclusive") else ""
    if variant in ("char", "stem_char"):
        more += "".join(f", flatten([[concat('c{n}:', substr(concat('^', a, '$'), i, {n})) FOR i IN range(1, length(a) + {4 - n})] FOR a IN w IF length(a) > 3])" for n in (3, 4))
    start = ("ln((dt + 1) / (dt + dn + 2))", "ln((dn + 1) / (dt + dn + 2))") if prior == "observed" else ("0", "0")
    return f"""
l AS (SELECT title AS normalized_title, min(y) AS y FROM (SELECT trim(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))) AS title, CASE WHEN contains(html, '<html lang="en"') THEN 'target' ELSE 'non_target' END AS y FROM pages) WHERE title <> '' GROUP BY 1),
f AS (SELECT normalized_title, y, CAST('0x' || left(sha256(normalized_title), 8) AS BIGINT) % 5 AS fold, {_WORDS} AS w FROM l),
x AS (SELECT normalized_title, y, fold, unnest(list_concat([concat('w:', a) FOR a IN w IF length(a) > 1], [concat('b:', w[i], '_', w[i + 1]) FOR i IN range(1, len(w))]{more})) AS feature FROM f),
cnt AS (SELECT feature, fold, count(*) FILTER (y = 'target') AS t, count(*) FILTER (y = 'non_target') AS n FROM x GROUP BY ALL),
tot AS (SELECT feature, sum(t) AS t, sum(n) AS n, count(DISTINCT fold) AS folds, any_value(fold) AS fold FROM cnt GROUP BY 1),
sz AS (SELECT k AS fold, (SELECT count(*) FROM f WHERE fold <> k AND y = 'target') AS dt, (SELECT count(*) FROM f WHERE fold <> k AND y = 'non_target') AS dn, (SELECT sum(t) FROM cnt WHERE fold <> k) AS st, (SELECT sum(n) FROM cnt WHERE fold <> k) AS sn,
  (SELECT count(DISTINCT feature) FROM cnt WHERE fold <> k) AS v FROM range(5) r(k)),
s AS (SELECT normalized_title, x.fold, sum(ln((tot.t - coalesce(own.t, 0) + 1) / (st + v))) AS lt, sum(ln((tot.n - coalesce(own.n, 0) + 1) / (sn + v))) AS ln_ FROM x JOIN tot USING (feature) LEFT JOIN cnt own ON own.feature = x.feature AND own.fold = x.fold JOIN sz ON sz.fold = x.fold GROUP BY 1, 2),
p AS (SELECT f.normalized_title, f.y, 1 / (1 + exp(-greatest(-60, least(60, {start[0]} + coalesce(lt, 0) - {start[1]} - coalesce(ln_, 0))))) AS p FROM f JOIN sz USING (fold) LEFT JOIN s USING (normalized_title)),
q AS (SELECT normalized_title, y, CASE WHEN p >= 0.5 THEN 'target' ELSE 'non_target' END AS predicted, greatest(p, 1 - p) AS confidence FROM p)"""


_NB = _titles_sql()
_ALONE = f"""{_titles_sql('exclusive')},
u AS (SELECT DISTINCT normalized_title, fold, feature FROM x), e AS (SELECT u.*, tot.t - coalesce(own.t, 0) AS t, tot.n - coalesce(own.n, 0) AS n FROM u JOIN tot USING (feature) LEFT JOIN cnt own ON own.feature = u.feature AND own.fold = u.fold),
sig AS (SELECT normalized_title, feature, greatest(t, n) AS c, CASE WHEN t >= 2 AND n = 0 THEN 'target' WHEN t = 0 AND len(list_filter(string_split(substr(feature, 3), '_'), lambda p: p IN {title_model.GENERIC!r})) = 0 AND (left(feature, 2) = 'b:' AND n >= 4 OR left(feature, 2) IN ('w:', 's:') AND n >= 8 AND length(feature) >= 7) THEN 'non_target' END AS signal FROM e),
one AS (SELECT normalized_title, max(signal) AS signal, max(c) AS c FROM sig WHERE signal IS NOT NULL GROUP BY 1 HAVING count(DISTINCT signal) = 1),
ev AS (SELECT normalized_title, string_agg(feature, ', ' ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY normalized_title ORDER BY c DESC, length(feature) DESC, feature) AS k FROM sig SEMI JOIN one USING (normalized_title) WHERE signal IS NOT NULL) WHERE k <= 5 GROUP BY 1),
alone AS (SELECT f.normalized_title, f.y, coalesce(signal, 'non_target') AS predicted, CASE WHEN signal IS NULL THEN 0.5 WHEN c >= 5 THEN 0.995 ELSE 0.99 END AS confidence, coalesce(evidence, '') AS evidence FROM f LEFT JOIN one USING (normalized_title) LEFT JOIN ev USING (normalized_title))"""


def _figures(ctes: str, source: str, variant: str, prior: str) -> str:
    limits = ", ".join(map(str, title_model.THRESHOLDS))
    return f"""SELECT * FROM (WITH {ctes}, grid AS (SELECT label, CAST(th AS double) AS th FROM (SELECT DISTINCT y AS label FROM {source}), (SELECT unnest([{limits}]) AS th))
SELECT '{variant}' AS variant, '{prior}' AS class_prior, label, th AS threshold, count(*) FILTER (predicted = label AND confidence >= th) AS selected,
  round(CAST(count(*) FILTER (predicted = label AND confidence >= th AND y = label) AS double) / nullif(count(*) FILTER (predicted = label AND confidence >= th), 0), 5) AS precision, round(CAST(count(*) FILTER (predicted = label AND confidence >= th AND y = label) AS double) / count(*) FILTER (y = label), 5) AS recall
FROM grid, {source} GROUP BY ALL)"""

ORACLES = {
    "current_postings": f"WITH {_J} SELECT posted_text, {_CURRENT} AS current, count(*) AS postings FROM j GROUP BY ALL",
    "dashboard_jobs": f"WITH {_D} SELECT * EXCLUDE (first_seen_at) FROM d",
    "dashboard_buckets": f"WITH {_B} SELECT role_stack, role_family, seniority_bucket, employment_bucket, location_bucket, count(*) AS jobs FROM b GROUP BY ALL",
    "job_search": f"WITH {_D} SELECT site_id, external_job_id, title, location FROM d WHERE {' AND '.join(f'contains(lower(concat_ws(chr(32), title, canonical_name, location)), {w!r})' for w in QUERY.split())}",
    "job_mix": f"""
WITH {_B}, c AS (SELECT {_stack()} AS stack, {_family(True)} AS family, CAST(timezone('{ZONE}', timezone('UTC', CAST(first_seen_at AS timestamp))) AS date) >= CAST(timezone('{ZONE}', timezone('UTC', TIMESTAMP '{NOW}')) AS date) AS fresh FROM e WHERE role_status = 'target'),
g AS (SELECT 'track' AS dimension, CASE WHEN stack = 'stack_5_possible_target' THEN concat('track_family:', family) ELSE stack END AS segment_key, fresh FROM c UNION ALL SELECT 'role_family', family, fresh FROM c),
h AS (SELECT dimension, segment_key, count(*) AS current_open_jobs, count(*) FILTER (fresh) AS new_today_jobs FROM g GROUP BY ALL)
SELECT *, CAST(round(100.0 * current_open_jobs / nullif(sum(current_open_jobs) OVER (PARTITION BY dimension), 0), 1) AS double) AS current_pct, CAST(round(100.0 * new_today_jobs / nullif(sum(new_today_jobs) OVER (PARTITION BY dimension), 0), 1) AS double) AS today_pct FROM h""",
    "hiring_summary": f"WITH {_B} SELECT role_family, location, count(*) AS jobs FROM b WHERE contains(lower(canonical_name), '000001') GROUP BY ALL",
    "local_day_postings": f"WITH {_J} SELECT site_id, count(*) AS postings FROM j WHERE CAST(timezone('{ZONE}', timezone('UTC', CAST(first_seen_at AS timestamp))) AS date) = DATE '2024-01-18' GROUP BY 1",
    "job_actions": f"""
WITH n AS (SELECT site_id, external_job_id, {pick(('applied', 'unknown', 'saved'), 'event_id')} AS st FROM ({STAGE})), g AS (SELECT * FROM n WHERE st <> 'unknown')
SELECT coalesce(st, action_status) AS action_status, count(*) AS jobs, count(st) AS updated FROM ({ACTION_ROWS}) a FULL JOIN g ON a.site_id = g.site_id AND a.external_job_id = g.external_job_id GROUP BY 1""",
    "snapshot_apply": f"""
WITH {_ADMIT}, o AS (SELECT *, {SCOPE} AS market_scope FROM ({KNOWN})), st AS (SELECT DISTINCT site_id FROM ({STAGE})),
z AS (SELECT coalesce(o.site_id, s.site_id) AS site_id, coalesce(o.external_job_id, s.external_job_id) AS external_job_id, s.site_id IS NOT NULL AS here, o.site_id IS NOT NULL AS known, o.active AS was, o.market_scope AS scope, o.first_seen_at, o.last_seen_at, o.closed_at,
  s.title AS t1, o.title AS t0, s.normalized_title AS n1, o.normalized_title AS n0, nullif(s.location, '') AS l1, o.location AS l0, nullif(s.category, '') AS c1, o.category AS c0, s.job_url AS u1, o.job_url AS u0, nullif(s.description_snippet, '') AS d1, o.description_snippet AS d0, nullif(s.posted_text, '') AS p1, o.posted_text AS p0,
  nullif(s.employment_type, '') AS e1, o.employment_type AS e0 FROM o FULL JOIN s ON o.site_id = s.site_id AND o.external_job_id = s.external_job_id),
y AS (SELECT *, NOT here AND was AND scope = 'US' AND site_id IN (SELECT site_id FROM st) AS gone FROM z)
SELECT site_id, external_job_id, if(here, t1, t0) AS title, if(here, n1, n0) AS normalized_title, if(here, l1, l0) AS location, if(here, c1, c0) AS category, if(here, u1, u0) AS job_url, if(here, d1, d0) AS description_snippet, if(here, p1, p0) AS posted_text, if(here, e1, e0) AS employment_type,
  if(here, 'US', scope) AS market_scope, CASE WHEN here THEN true WHEN gone THEN false ELSE was END AS active, coalesce(first_seen_at, TIMESTAMP '{AS_OF}') AS first_seen_at, if(here, TIMESTAMP '{AS_OF}', last_seen_at) AS last_seen_at,
  CASE WHEN here THEN NULL WHEN gone THEN TIMESTAMP '{AS_OF}' ELSE closed_at END AS closed_at, CASE WHEN here AND NOT known THEN 'new' WHEN here AND was THEN 'updated' WHEN here THEN 'reopened' WHEN gone THEN 'closed' ELSE 'kept' END AS change FROM y""",
    "snapshot_titles": f"WITH {_ADMIT} SELECT normalized_title, classification_status FROM ({LABEL_ROWS}) UNION ALL SELECT DISTINCT normalized_title, 'review' FROM s WHERE normalized_title NOT IN (SELECT normalized_title FROM ({LABEL_ROWS}))",
    "snapshot_run_counts": f"WITH {_ADMIT} SELECT site_id, count(*) AS admitted_jobs, count(*) FILTER (classification_status = 'target') AS target_job_count, count(*) FILTER (coalesce(classification_status, 'review') = 'review') AS review_job_count FROM s LEFT JOIN ({LABEL_ROWS}) l USING (normalized_title) GROUP BY 1",
    "manual_labels": f"""
WITH {_GOOD}, l AS ({LABEL_ROWS}) SELECT coalesce(g.normalized_title, l.normalized_title) AS normalized_title, coalesce(st, classification_status) AS classification_status,
  CASE WHEN st IS NULL THEN canonical_role WHEN st = 'target' THEN coalesce(nullif(trim(pair[2]), ''), canonical_role) END AS canonical_role, CASE WHEN st IS NULL THEN rule_version ELSE 'manual-v1' END AS rule_version FROM g FULL JOIN l USING (normalized_title)""",
    "manual_label_history": f"WITH {_GOOD} SELECT g.normalized_title, st AS classification_status, classification_status AS previous_status, 'manual' AS source FROM g LEFT JOIN ({LABEL_ROWS}) l USING (normalized_title) WHERE st IS DISTINCT FROM classification_status",
    "model_labels": f"""
WITH d AS (SELECT normalized_title, arg_max((classification_status, confidence), (created_at, classification_status)) AS x FROM ({DECISIONS}) GROUP BY 1), l AS ({LABEL_ROWS}),
r AS (SELECT normalized_title, x[1] AS st FROM d WHERE (x[1] = 'target' AND x[2] >= 0.88 OR x[1] = 'non_target' AND x[2] >= 0.84) AND normalized_title IN (SELECT normalized_title FROM l WHERE classification_status = 'review' AND NOT coalesce(rule_version LIKE 'manual%', false)) ORDER BY x[2] DESC, normalized_title LIMIT 5)
SELECT normalized_title, coalesce(st, classification_status) AS classification_status, CASE WHEN st IS NULL THEN rule_version ELSE 'model-v1' END AS rule_version FROM l LEFT JOIN r USING (normalized_title)""",
    "wage_repair": f"SELECT k.* REPLACE (CASE WHEN {_NUMERIC} THEN CAST(r.wage_rate_of_pay_from AS decimal(14,2)) ELSE k.wage_rate_of_pay_from END AS wage_rate_of_pay_from, CASE WHEN {_NUMERIC.replace('wage_unit', 'k.wage_unit')} THEN r.wage_unit_of_pay ELSE k.wage_unit_of_pay END AS wage_unit_of_pay) FROM ({KEYED}) k JOIN ({REPAIRS}) r USING (case_number)".replace("(regexp_matches(wage_unit", "(regexp_matches(k.wage_unit"),
    "wage_repair_backup": f"SELECT lca_case_id, case_number, k.wage_rate_of_pay_from AS old_wage_rate_of_pay_from, k.wage_unit_of_pay AS old_wage_unit_of_pay, CAST(r.wage_rate_of_pay_from AS decimal(14,2)) AS new_wage_rate_of_pay_from, r.wage_unit_of_pay AS new_wage_unit_of_pay FROM ({KEYED}) k JOIN ({REPAIRS}) r USING (case_number) WHERE {_NUMERIC.replace('(wage_unit', '(k.wage_unit')}",
    "wage_repair_guards": f"SELECT (SELECT count(*) FROM ({REPAIRS})) AS stage_rows, CAST(0 AS BIGINT) AS invalid_units, count(*) AS affected_rows, count(*) AS matched_rows FROM ({KEYED}) WHERE {_NUMERIC}",
    "staged_repairs": f"SELECT case_number, CASE WHEN length(case_number) % 2 = 0 THEN CAST(wage_rate_of_pay_from AS decimal(14,2)) END AS wage_rate_of_pay_from, CAST(NULL AS varchar) AS wage_unit_of_pay FROM ({REPAIRS})",
    "merged_targets": f"SELECT consolidation_key, coalesce(t.canonical_name, s.canonical_name) AS canonical_name, greatest(t.priority_score, s.priority_score) AS priority_score FROM ({TARGETS}) t FULL JOIN ({SCORED}) s USING (consolidation_key)",
    "inserted_targets": f"SELECT consolidation_key, coalesce(t.canonical_name, s.canonical_name) AS canonical_name FROM ({TARGETS}) t FULL JOIN ({SCORED}) s USING (consolidation_key)",
    "synced_targets": f"""
WITH n AS (SELECT s.*, f.reason, f.consolidation_key IS NOT NULL AS forced FROM ({SCORED}) s LEFT JOIN (SELECT * FROM ({FORCED}) WHERE active) f USING (consolidation_key) WHERE crawl_priority_tier IS NOT NULL),
j AS (SELECT consolidation_key, n.consolidation_key IS NOT NULL AS here, t.canonical_name AS t_name, n.canonical_name AS n_name, t.priority_tier, t.priority_score AS t_score, n.priority_score AS n_score, crawl_priority_tier, computed_crawl_priority_tier, forced, reason FROM ({TARGETS}) t FULL JOIN n USING (consolidation_key))
SELECT consolidation_key, if(here, n_name, t_name) AS canonical_name, if(here, crawl_priority_tier, priority_tier) AS priority_tier, if(here, computed_crawl_priority_tier, NULL) AS computed_priority_tier, if(here AND forced, 'manual_override', 'computed') AS priority_source, if(here, reason, NULL) AS override_reason, if(here, n_score, t_score) AS priority_score, here AS enabled FROM j""",
    "auto_trusted": f"""
WITH s AS (SELECT * REPLACE (CASE WHEN site_id % 9 < 7 THEN 'unverified' ELSE verification_status END AS verification_status) FROM ({FULL_SITES})), t AS (SELECT * FROM ({TARGETS}) WHERE enabled),
r AS (SELECT site_id, s.consolidation_key, priority_tier, row_number() OVER (PARTITION BY s.consolidation_key ORDER BY candidate_rank NULLS LAST, candidate_score DESC NULLS LAST, site_id) AS k FROM s JOIN t USING (consolidation_key)
  WHERE verification_status = 'unverified' AND source_type IN {discovery.TRUSTED!r} AND NOT (source_type = 'workday' AND regexp_matches(site_url, '(?i)myworkdayjobs\\.com/.*/job/')) AND s.consolidation_key NOT IN (SELECT consolidation_key FROM s WHERE verification_status = 'verified'))
SELECT site_id, consolidation_key, CAST(CASE priority_tier WHEN 'P0' THEN 24 WHEN 'P1' THEN 72 WHEN 'P2' THEN 168 ELSE 336 END AS integer) AS crawl_interval_hours FROM r WHERE k = 1""",
    "reviewed_sites": f"""
SELECT s.site_id, CASE WHEN c.consolidation_key IS NULL THEN verification_status WHEN c.site_id = s.site_id THEN 'verified' ELSE 'rejected' END AS verification_status, CASE WHEN c.consolidation_key IS NULL THEN crawl_enabled ELSE coalesce(c.site_id = s.site_id, false) END AS crawl_enabled
FROM ({SITE_ROWS}) s LEFT JOIN ({CHOICES}) c USING (consolidation_key)""",
    "discovery_status": f"""
WITH r AS (SELECT consolidation_key, bool_or(verification_status = 'verified') AS v, bool_or(verification_status = 'unverified') AS u FROM ({SITE_ROWS}) GROUP BY 1)
SELECT consolidation_key, CASE WHEN v THEN 'found' WHEN u THEN 'review_pending' ELSE 'not_found' END AS discovery_status FROM ({TARGETS}) LEFT JOIN r USING (consolidation_key)""",
    "priority_overrides": f"SELECT consolidation_key, CASE WHEN decision IN ('P0', 'P2') THEN decision ELSE override_tier END AS override_tier, CASE WHEN decision IN ('P0', 'P2') THEN true WHEN decision = 'AUTO' THEN false ELSE active END AS active FROM ({FORCED}) f FULL JOIN ({CHOICES}) c USING (consolidation_key)",
    "site_hygiene": f"""
WITH s AS (SELECT *, regexp_replace(normalized_domain, '^www\\.', '') AS h, lower(coalesce(last_error, '')) AS e FROM ({FULL_SITES})),
a AS (SELECT site_id, CASE WHEN {_OUT} THEN 'reject_domain' WHEN source_type = 'workday' AND regexp_matches(site_url, '(?i)myworkdayjobs\\.com/.*/job/') THEN 'reject_job_url' WHEN contains(e, '404') AND consecutive_failures >= 2 THEN 'reject_persistent_404' WHEN contains(e, '404') THEN 'demote_404'
  WHEN contains(e, '429') OR contains(e, 'timed out') OR contains(e, 'timeout') THEN 'requeue_transient' END AS action FROM s) SELECT * FROM a WHERE action IS NOT NULL""",
    "review_workbench": f"""
WITH c AS (SELECT consolidation_key, arg_min(site_id, (coalesce(candidate_rank, 99), site_id)) AS site_1 FROM ({SITE_ROWS}) WHERE verification_status = 'unverified' GROUP BY 1), v AS (SELECT consolidation_key, min(site_id) AS verified_site FROM ({SITE_ROWS}) WHERE verification_status = 'verified' GROUP BY 1),
b AS (SELECT t.*, site_1, verified_site, CASE WHEN verified_site IS NULL THEN 'REVIEW_CANDIDATES' ELSE 'VERIFIED' END AS action_status FROM ({TARGETS}) t LEFT JOIN c USING (consolidation_key) LEFT JOIN v USING (consolidation_key) WHERE site_1 IS NOT NULL OR verified_site IS NOT NULL)
SELECT consolidation_key, action_status, site_1, verified_site, row_number() OVER (ORDER BY CASE priority_tier WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 ELSE 2 END, CASE action_status WHEN 'REVIEW_CANDIDATES' THEN 0 ELSE 1 END, CASE WHEN priority_score % 3 = 0 THEN 2 WHEN priority_score % 3 = 1 THEN 4 ELSE 5 END, priority_score DESC, md5(consolidation_key)) AS review_rank FROM b""",
    "ranked_results": f"""
WITH {_classes(RESULTS)}, w AS (SELECT consolidation_key, canonical_url AS site_url, max(round(20 * greatest(0, least(score, 1)) + if(source_type <> 'generic_html', 50, 0) + if(career, 25, 0) + if(regexp_matches(lower(title), 'career|job|join|opportunities|openings'), 15, 0) + if(contains(h, 'acme') OR contains(lower(title), 'acme'), 15, 0)
  + if(contains(lower(title), 'official'), 5, 0) - if(site_kind = 'corporate', 15, 0), 3)) AS candidate_score FROM m WHERE NOT {_OUT} GROUP BY 1, 2)
SELECT consolidation_key, CAST(row_number() OVER (PARTITION BY consolidation_key ORDER BY candidate_score DESC, site_url) AS integer) AS candidate_rank, candidate_score, site_url FROM w WHERE candidate_score >= 25 QUALIFY candidate_rank <= 3""",
    "finalized_discovery": f"""
SELECT consolidation_key, CASE WHEN search_succeeded AND candidate_count > 0 THEN 'review_pending' WHEN search_succeeded THEN 'not_found' ELSE 'retry' END AS discovery_status,
  CASE WHEN search_succeeded AND candidate_count > 0 THEN NULL WHEN search_succeeded THEN TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY ELSE TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY END AS next_discovery_at, CASE WHEN search_succeeded THEN 0 ELSE consecutive_discovery_failures + 1 END AS consecutive_discovery_failures
FROM ({QUEUED}) q JOIN ({OUTCOMES}) o USING (consolidation_key)""",
    "rekeyed_sites": f"SELECT site_id, coalesce(new_key, consolidation_key) AS consolidation_key FROM ({SITE_ROWS}) s LEFT JOIN ({MERGES}) m ON s.consolidation_key = m.old_key",
    "classified_urls": f"WITH {_classes(LINKS)} SELECT page_id, canonical_url, host, site_kind, source_type, source_key FROM m",
    "url_templates": f"""
WITH r AS (SELECT {_HOST} AS host, lower(regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1)) AS path, left(sha1(concat(url, '|t|l')), 24) AS id FROM ({LINKS}))
SELECT host, {_PATTERN} AS pattern, count(*) AS urls, min(id) AS first_id FROM r GROUP BY ALL""",
    "declared_jobs": f"""
WITH c AS (SELECT page_id AS site_id, concat({pick(TITLES, 'page_id')}, ' & Co') AS title, {pick(('Chicago, IL', 'London', 'Austin, TX'), 'page_id')} AS location, concat('/jobs/', page_id) AS link, concat('2024-01-0', page_id % 9 + 1) AS posted_text FROM pages WHERE page_id % 6 <> 3 AND page_id % 5 <> 3)
SELECT site_id, left(sha1(concat(link, '|', title, '|', location)), 24) AS external_job_id, title, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_+#./-]+', ' ', 'g'), ' +', ' ', 'g')) AS normalized_title, location, '' AS category, concat('https://jobs.example.org', link) AS job_url, 'Good work' AS description_snippet,
  {SCOPE} AS market_scope, posted_text, '' AS employment_type FROM c""",
    "linked_jobs": rf"""
WITH g AS (SELECT site_id, url, html, string_split(html, '</a>') AS parts FROM ({LINKED})), h AS (SELECT site_id, url, html, len(parts) AS n, unnest(parts) AS s, generate_subscripts(parts, 1) AS k FROM g),
o AS (SELECT *, sum(length(s) + 4) OVER (PARTITION BY site_id ORDER BY k) AS stop, regexp_extract(s, '(?is)<a\b[^>]*\bhref\s*=\s*"([^"]+)"[^>]*>', 0) AS tag, regexp_extract(s, '(?is)<a\b[^>]*\bhref\s*=\s*"([^"]+)"[^>]*>', 1) AS href FROM h),
a AS (SELECT *, CAST(greatest(stop - 4 - length(s) + strpos(s, tag) - 1 - 400, 0) AS BIGINT) AS lo FROM o WHERE k < n AND tag <> ''),
l AS (SELECT site_id, url, k, href, {_strip("substr(s, strpos(s, tag) + length(tag))")} AS title, {_strip("substr(html, lo + 1, CAST(stop + 400 - lo AS BIGINT))")} AS near FROM a),
w AS (SELECT *, CASE WHEN regexp_matches(lower(near), '{OUTSIDE}') THEN '' WHEN regexp_matches(near, '{_CITY_STATE}') THEN regexp_extract(near, '{_CITY_STATE}', 1) WHEN regexp_matches(lower(near), '\b(remote|united states|u\.s\.|u\.s\.a\.|usa)\b') THEN 'United States'
  {' '.join(f"WHEN regexp_matches(lower(near), '{chr(92)}b{x}{chr(92)}b') THEN '{x.title()}'" for x in STATES)} ELSE '' END AS location
  FROM l WHERE length(title) BETWEEN 4 AND 140 AND NOT regexp_matches(title, '{pages.BARE_LINK}') AND regexp_matches(title, '{pages.JOB_WORDS}') AND NOT regexp_matches(title, '{pages.OUT_OF_SCOPE}') AND NOT regexp_matches(lower(title), '{OUTSIDE}')),
x AS (SELECT *, concat(regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0), {_unescape('href')}) AS job_url FROM w WHERE location <> ''),
y AS (SELECT *, left(sha1(concat(job_url, '|', title, '|', location)), 24) AS external_job_id, {SCOPE} AS market_scope FROM x QUALIFY row_number() OVER (PARTITION BY site_id, left(sha1(concat(job_url, '|', title, '|', location)), 24) ORDER BY k) = 1)
SELECT site_id, external_job_id, title, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_+#./-]+', ' ', 'g'), ' +', ' ', 'g')) AS normalized_title, location, '' AS category, job_url, left(near, 1000) AS description_snippet, market_scope, '' AS posted_text, '' AS employment_type FROM y WHERE market_scope = 'US'""",
    "payload_jobs": f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY page_id % 40, page_id % 7 ORDER BY page_id DESC) AS k FROM pages), c AS (SELECT page_id % 40 AS site_id, CAST(page_id % 7 AS varchar) AS external_job_id, {pick(TITLES, 'page_id')} AS title, {pick(('Chicago, IL', 'London', 'Remote'), 'page_id')} AS location, concat('https://x/', page_id) AS job_url FROM r WHERE k = 1)
SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_+#./-]+', ' ', 'g'), ' +', ' ', 'g')) AS normalized_title, 'Eng, Ops' AS category, 'Hi there' AS description_snippet, {SCOPE} AS market_scope, '2024-01-02' AS posted_text, '' AS employment_type FROM c""",
    "resolved_links": f"""
WITH {_classes(f"SELECT {FEIN.format('page_id % 60')} AS consolidation_key, url FROM ({LINKS})")},
w AS (SELECT consolidation_key, canonical_url AS site_url, source_type, max(65 + 15 + if(contains(lower(url), 'acme'), 10, 0) + if(source_type IN {discovery.TRUSTED!r}, 10, 0)) AS candidate_score FROM m WHERE source_type <> 'generic_html' AND NOT {_OUT} GROUP BY 1, 2, 3)
SELECT consolidation_key, CAST(row_number() OVER (PARTITION BY consolidation_key ORDER BY candidate_score DESC, site_url) AS integer) AS candidate_rank, CAST(candidate_score AS integer) AS candidate_score, site_url, source_type FROM w QUALIFY candidate_rank <= 3""",
    "title_folds": f"WITH {_NB} SELECT normalized_title, predicted, round(confidence, 5) AS confidence FROM q",
    "title_thresholds": f"""
WITH {_NB}, g AS (SELECT predicted, th, count(*) AS n, count(*) FILTER (y = predicted) AS hits FROM q, (SELECT unnest([{', '.join(map(str, title_model.THRESHOLDS))}]) AS th) WHERE confidence >= th GROUP BY 1, 2), b AS (SELECT predicted, min((CAST(th AS double), n, hits)) AS x FROM g WHERE n >= 10 AND hits / n >= 0.98 GROUP BY 1)
SELECT v.predicted, coalesce(x[1], 1.001) AS threshold, coalesce(round(x[3] / x[2], 5), 0.0) AS holdout_precision, coalesce(x[2], 0) AS holdout_count FROM (VALUES ('target'), ('non_target')) v(predicted) LEFT JOIN b USING (predicted)""",
    "title_exclusive": f"WITH {_ALONE} SELECT normalized_title, predicted, CAST(confidence AS double) AS confidence, evidence FROM alone",
    "title_evidence": f"""
WITH {_NB}, a AS (SELECT count(*) FILTER (y = 'target') AS dt, count(*) FILTER (y = 'non_target') AS dn FROM f), st AS (SELECT sum(t) AS t, sum(n) AS n, count(*) AS v FROM tot),
sc AS (SELECT normalized_title, sum(ln((tot.t + 1) / (st.t + st.v)) - ln((tot.n + 1) / (st.n + st.v))) AS d FROM x JOIN tot USING (feature), st GROUP BY 1),
pr AS (SELECT f.normalized_title, CASE WHEN ln((dt + 1) / (dn + 1)) + coalesce(d, 0) >= 0 THEN 'target' ELSE 'non_target' END AS predicted FROM f LEFT JOIN sc USING (normalized_title), a),
u AS (SELECT DISTINCT normalized_title, feature FROM x), k AS (SELECT u.*, row_number() OVER (PARTITION BY normalized_title ORDER BY CASE predicted WHEN 'target' THEN (t + 1) / (n + 1) ELSE (n + 1) / (t + 1) END DESC, feature) AS k FROM u JOIN tot USING (feature) JOIN pr USING (normalized_title))
SELECT normalized_title, any_value(predicted) AS predicted, string_agg(feature, ', ' ORDER BY k) FILTER (k <= 5) AS evidence FROM pr LEFT JOIN k USING (normalized_title) GROUP BY 1""",
    "title_variants": " UNION ALL ".join([*(_figures(_titles_sql(v, p), "q", v, p) for v in title_model.VARIANTS for p in ("observed", "balanced")), _figures(_ALONE, "alone", "exclusive", "observed")]),
    "title_review_queue": None,
    "soc_labels": None,
    "wage_repair_rescore": None,
}
_US_CATALOG = f"""{_J}, us AS (SELECT * FROM j WHERE market_scope = 'US'), {TITLE_SQL['soc_candidates'].split('resolved AS (', 1)[1].split('SELECT c.*', 1)[0].join(['resolved AS (', ''])}"""
_SUGGEST = "CASE WHEN target_soc_count IS NULL THEN {3} WHEN target_soc_count > 0 AND non_target_soc_count = 0 THEN {0} WHEN target_soc_count = 0 AND non_target_soc_count > 0 THEN {1} ELSE {2} END"
ORACLES["title_review_queue"] = f"""
WITH {_US_CATALOG}, c AS (SELECT u.normalized_title, count(*) FILTER (active) AS active_posting_count, count(DISTINCT consolidation_key) AS company_count FROM us u LEFT JOIN ({LABEL_ROWS}) l USING (normalized_title) WHERE coalesce(classification_status, 'review') = 'review' GROUP BY 1),
x AS (SELECT normalized_title, string_agg(consolidation_key, ', ' ORDER BY consolidation_key) FILTER (k <= 3) AS example_companies FROM (SELECT *, row_number() OVER (PARTITION BY normalized_title ORDER BY consolidation_key) AS k FROM (SELECT DISTINCT normalized_title, consolidation_key FROM us)) GROUP BY 1)
SELECT c.*, {_SUGGEST.format("'target'", "'non_target'", "'review'", "'review'")} AS suggested_status, {_SUGGEST.format("'exact_target_soc_only'", "'exact_non_target_soc_only'", "'mixed_soc_conflict'", "'no_exact_raw_title_match'")} AS suggestion_reason, example_companies,
  CASE WHEN active_posting_count >= 5 OR company_count >= 3 THEN 'HIGH' WHEN active_posting_count >= 2 THEN 'MEDIUM' ELSE 'LATER' END AS priority_band FROM c LEFT JOIN resolved r USING (normalized_title) LEFT JOIN x USING (normalized_title)"""
ORACLES["soc_labels"] = f"""
WITH {_US_CATALOG}, h AS (SELECT DISTINCT normalized_title FROM j), g AS (SELECT normalized_title, {_SUGGEST.format("'target'", "'non_target'", "NULL", "NULL")} AS st FROM h JOIN resolved USING (normalized_title))
SELECT normalized_title, CASE WHEN classification_status = 'review' AND rule_version IS NULL AND st IS NOT NULL THEN st ELSE classification_status END AS classification_status, CASE WHEN classification_status = 'review' AND rule_version IS NULL AND st IS NOT NULL THEN 'soc-exact-v1' ELSE rule_version END AS rule_version FROM ({LABEL_ROWS}) LEFT JOIN g USING (normalized_title)"""
ORACLES["wage_repair_rescore"] = f"""
WITH f AS ({ORACLES['wage_repair']}), b AS ({ORACLES['wage_repair_backup']}), u AS (SELECT consolidation_key, fein FROM ({UNIT_ROWS}))
SELECT consolidation_key, min(CAST(wage_rate_of_pay_from * CASE wage_unit_of_pay WHEN 'Year' THEN 1 WHEN 'Month' THEN 12 WHEN 'Bi-Weekly' THEN 26 WHEN 'Week' THEN 52 WHEN 'Hour' THEN 2080 END AS decimal(14,2))) AS least_annual_salary
FROM u JOIN f ON f.employer_fein = u.fein WHERE consolidation_key IN (SELECT consolidation_key FROM u JOIN f ON f.employer_fein = u.fein JOIN b USING (lca_case_id)) GROUP BY 1"""
