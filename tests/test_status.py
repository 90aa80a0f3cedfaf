import datetime

from pyspark.sql import functions as F

from hirelake.functions.urls import path_pattern, template_family
from hirelake.operators import status
from hirelake.operators.sites import schedule_queue
from hirelake.plans import status as plans
from tests.conftest import SMALL

AT = datetime.datetime(2024, 1, 25, 18)
TARGETS = "consolidation_key string, canonical_name string, priority_tier string, priority_score int, enabled boolean, discovery_status string"
SITES = "site_id long, consolidation_key string, source_type string, verification_status string, crawl_enabled boolean, crawl_status string, last_crawled_at timestamp, last_success_at timestamp, next_crawl_at timestamp, target_country_code string, scope_method string, consecutive_failures int"


def site(k, key, kind="greenhouse", state="verified", enabled=True, crawl="pending", crawled=None, success=None, due=None):
    return (k, key, kind, state, enabled, crawl, crawled, success, due, "US", "url", 0)


def test_each_state_of_the_ladder(spark):
    later = AT + datetime.timedelta(days=9)
    keys = ["ok", "failed", "due", "waiting", "structured", "plain", "new", "none", "off"]
    targets = spark.createDataFrame([(k, k, "P1", 1, k != "off", "pending" if k == "new" else "not_found") for k in keys], TARGETS)
    sites = spark.createDataFrame(
        [site(1, "ok", success=AT), site(2, "ok", crawl="failed"), site(3, "failed", crawl="failed", due=later), site(4, "due"), site(5, "waiting", due=later),
         site(6, "structured", state="unverified", enabled=False), site(7, "plain", "generic_html", "unverified", False), site(8, "none", state="rejected")], SITES)
    found = {r.crawl_state[:2]: (r.companies, r.pct_within_tier) for r in status.crawl_state(targets, sites, schedule_queue(sites, targets, str(AT))).collect()}
    assert found == {f"0{k}": (1, 12.5) for k in range(1, 9)}
    assert status.crawl_state(targets, sites.limit(0), schedule_queue(sites.limit(0), targets, str(AT))).where("crawl_state LIKE '08%'").first().companies == 7


def test_quality_of_runs(spark):
    rows = [("a", None, False, 0, "urlerror: x"), ("a", None, False, 0, None), ("b", "c", True, 1, None), ("b", "c", False, 0, "HTTPError: HTTP Error 404"), ("d", "c", True, 0, None), ("d", "c", True, 2, None), ("e", "c", True, 2, None)]
    df = spark.createDataFrame([(*r, AT) for r in rows], "run_id string, cohort string, search_succeeded boolean, candidate_count int, error_message string, attempted_at timestamp")
    found = {r.run_id: (r.run_quality, r.transient_failures) for r in status.attempt_summary(df).collect()}
    assert found == {"a": ("full_batch_failed", 1), "b": ("partial_failures", 0), "d": ("completed_with_no_candidate", 0), "e": ("completed_with_candidates", 0)}


def test_verified_by_whom(spark):
    targets = spark.createDataFrame([("x", "x", "P0", 1, True, ""), ("y", "y", "P0", 1, True, ""), ("z", "z", "P9", 1, True, "")], TARGETS)
    sites = spark.createDataFrame([site(1, "x"), site(2, "x"), site(3, "y", state="unverified")], SITES).withColumn("reviewed_by", F.when(F.col("site_id") == 1, "system:auto"))
    r = status.coverage_by_tier(targets, sites, schedule_queue(sites, targets, str(AT))).collect()
    assert [(x.priority_tier, x.companies, x.human_verified_companies, x.auto_trusted_companies, x.companies_with_candidates, x.never_crawled, x.verified_company_rate) for x in r] == [("P0", 2, 1, 1, 1, 2, 0.5)]


def test_paths_and_families(spark):
    paths = ["", "/", "/en-us/jobs/7", "/careers", "/careersx", "/jobs/1", "/join", "/company/x", "/p/12ab/34"]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, p string").orderBy("k").select(path_pattern(F.col("p")), template_family(F.lit("x.successfactors.eu"), F.col("p")), template_family(F.lit("a.b"), F.col("p"))).collect()
    assert [r[0] for r in rows] == ["/", "/", "/locale/careers", "/careers", "/careersx", "/jobs", "/join", "/about", "/p/:idab/:id"]
    assert {r[1] for r in rows} == {"successfactors_domain_missed"} and [r[2] == "corporate_careers_page" for r in rows] == [False, False, True, True, True, True, False, False, False]


def test_pilot_needs_both_ranks(spark):
    targets = spark.createDataFrame([(f"c{k}", "n", "P1", 9 - k, True, "") for k in range(4)], TARGETS)
    rows = [("c0", 5.0), ("c0", 9.0), ("c1", None), ("c2", 7.0), ("c3", 8.0)]
    sites = spark.createDataFrame([(k, c, s, "generic_html", "unverified", False, None, "https://x/Careers") for k, (c, s) in enumerate(rows)], "site_id long, consolidation_key string, candidate_score double, source_type string, verification_status string, crawl_enabled boolean, candidate_rank int, site_url string")
    assert sorted(r.site_id for r in status.pilot_sites(targets, sites, places=3).collect()) == [1, 2]


def test_evidence_of_one_occupation(spark):
    filings = spark.createDataFrame([("a", "11-1011", None), ("b", "11-1011", None), ("b", "15-1252", None), ("c", "99-9999", "Chief Executives"), ("d", None, None)], "employer_fein string, soc_code string, soc_title string")
    members = spark.createDataFrame([(k, k) for k in "abcd"], "consolidation_key string, fein string")
    soc = spark.createDataFrame([("15125200", True), ("11101100", True)], "normalized_soc_code string, active boolean")
    targets = spark.createDataFrame([(k, k, "P1", 1, True, "") for k in "abcd"], TARGETS)
    assert status.evidence_only(filings, members, soc, targets).first().companies == 2


def test_bands_and_patterns_of_scores(spark):
    rows = [(0.0, 0), (0.5, 1), (1.0, 1), (2.0, 1), (2.0, 1), (2.0, 0), (3.5, 1), (5.25, 1)]
    other = ", ".join(f"CAST(0 AS decimal(4,2)) AS {c}" for c in status.SCORES[1:])
    df = spark.createDataFrame(rows, "s double, t int").selectExpr("CAST(s AS decimal(4,2)) AS priority_score", "CAST(t AS decimal(4,2)) AS target_role_score").selectExpr("*", *other.split(", C")[:1], *("C" + x for x in other.split(", C")[1:]))
    assert [(r.bucket, r.companies) for r in status.score_histogram(df).collect()] == [("0", 1), ("0-1", 2), ("1-2", 3), ("3-4", 1), ("5+", 1)]
    assert [(int(r.target_role_score), r.companies) for r in status.component_patterns(df, "2.0").collect()] == [(1, 2), (0, 1)]


def test_pools_and_reasons(spark):
    kinds = "consolidation_key string, executive_only_excluded boolean, target_role_lca_count long, target_role_score int, priority_score double, recent_lca boolean, lca_count long, salary_score int"
    rows = [("in", False, 3, 1, 3.5, True, 9, 1), ("boss", True, 0, 0, 0.0, True, 1, 0), ("none", False, 0, 0, 0.0, False, 5, 0), ("low", False, 1, 1, 1.0, True, 2, 0), ("p3", False, 2, 1, 2.5, None, 6, 1), ("off", False, 2, 1, 3.5, True, 6, 1)]
    targets = spark.createDataFrame([("in", "n", "P1", 1, True, ""), ("p3", "n", "P3", 1, True, ""), ("off", "n", "P1", 1, False, "")], TARGETS)
    scores = spark.createDataFrame(rows, kinds)
    found = {r.outside_reason: (r.companies, r.lca_ge_5) for r in status.outside_reasons(scores, targets).collect()}
    assert found == {"executive_only_excluded": (1, 0), "no_target_soc_role_signal": (1, 1), "has_target_signal_but_score_below_p2": (1, 0), "other_not_in_enabled_pool": (2, 2)}
    assert {r.pool: (r.companies, r.recent_lca, r.has_salary_score) for r in status.pool_breakdown(scores, targets).collect()} == {"in_enabled_p_pool": (1, 1, 1), "outside_enabled_p_pool": (5, 3, 2)}


def test_mix_counts_closed_and_foreign_postings_too(spark):
    kinds = "normalized_title string, consolidation_key string, active boolean, market_scope string, posted_text string"
    rows = [("dev", "x", True, "US", "2024-01-05"), ("dev", "x", True, "US", None), ("dev", "y", False, "US", ""), ("eng", "z", True, "CA", ""), ("eng", "x", True, "US", "Posted 2023"), ("new", "y", True, "US", ""), ("old", "y", False, None, ""), (None, None, None, "US", "")]
    labels = spark.createDataFrame([("dev", "target"), ("eng", "target")], "normalized_title string, classification_status string")
    found = {r[0]: tuple(r[1:]) for r in status.posting_mix(spark.createDataFrame(rows, kinds), labels, "2024-01-20").collect()}
    assert found == {"target": (5, 4, 1, 2, 3, 2, 1, 1), "review": (3, 1, 1, 2, 1, 1, 1, 1)}


def test_mix_of_the_query_leaves_no_posting_out(spark):
    mix = plans.posting_mix(spark, SMALL).agg(F.sum("jobs"), F.sum("active_jobs"), F.sum("closed_jobs"), F.sum("titles")).first()
    assert tuple(mix) == tuple(plans.posting_totals(spark, SMALL).select("total_posting_rows", "active_rows", "closed_rows", "distinct_titles").first())
