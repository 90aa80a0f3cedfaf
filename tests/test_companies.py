import datetime
import decimal

from pyspark.sql import functions as F

from hirelake.operators.activity import posting_is_current_year, prune, retention_candidates
from hirelake.operators.matching import hyphen_prefixes, name_is_denied
from hirelake.operators.scoring import score_consolidated
from hirelake.operators.sites import due_sites


def test_current_year(spark):
    texts = ["", "2026-03-01", "Posted 2024", "1767225600", "1735689599000", "30+ days ago", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(posting_is_current_year(F.col("t"), F.lit(datetime.date(2026, 6, 1))))
    assert [r[0] for r in rows.collect()] == [True, True, False, True, False, True, True]


def test_prefixes_end_before_hyphens(spark):
    rows = spark.createDataFrame([("a-b--c",), ("amazonia",), ("",), (None,)], "k string").select(hyphen_prefixes(F.col("k"))).collect()
    assert [r[0] for r in rows[:3]] == [["a", "a-b", "a-b-", "a-b--c"], ["amazonia"], [""]]
    denied = spark.createDataFrame([("EY Advisory",), ("EY",), (None,)], "n string").select(name_is_denied(F.col("n"), ("ADVISORY",))).collect()
    assert [r[0] for r in denied] == [True, False, False]


def scores(spark, *units):
    """units: (fein, filings, executive, target, salary, city, product, manager)."""
    companies = spark.createDataFrame([(u[0], u[0], u[5], "IL", u[1], 0) for u in units], "fein string, name string, city string, state string, lca_count long, certified_count long")
    kinds = "fein string, lca_case_count long, executive_level_lca_count long, target_role_lca_count long, target_role_min_annual_salary decimal(14,2), has_product_role_job boolean, has_product_manager_job boolean, product_role_lca_count long, last_decision_date date, dataset_max_decision_date date"
    day = datetime.date(2024, 1, 1)
    stats = spark.createDataFrame([(u[0], u[1], u[2], u[3], decimal.Decimal(u[4]), u[6], u[7], 0, day, day) for u in units], kinds)
    groups = spark.createDataFrame([], "group_id string, canonical_name string, linkedin_employer_key string, policy string")
    members, matches = spark.createDataFrame([], "group_id string, fein string"), spark.createDataFrame([], "fein string")
    overrides = spark.createDataFrame([("boss", "P0", True), ("off", "P0", False)], "consolidation_key string, override_tier string, active boolean")
    found = score_consolidated(companies, stats, groups, members, matches, overrides).collect()
    return {r.consolidation_key: (float(r.priority_score), r.crawl_priority_tier) for r in found}


def test_tiers(spark):
    got = scores(
        spark,
        ("odd", 5, 0, 1, 1, "Chicago", True, True),
        ("two", 5, 0, 1, 1, "Chicago", False, False),
        ("one", 5, 0, 1, 95000, "Chicago", False, False),
        ("top", 5, 0, 1, 95000, "x", True, True),
        ("low", 1, 0, 1, 1, "x", False, False),
        ("boss", 2, 2, 1, 95000, "Chicago", True, True),
        ("off", 5, 0, 0, 1, "Chicago", True, True),
    )
    assert got == {"odd": (3.75, "P1"), "two": (2.5, "P2"), "one": (3.5, "P1"), "top": (4.25, "P1"), "low": (1.0, None), "boss": (0.0, None), "off": (0.0, None)}


def test_retention(spark):
    at = lambda days: datetime.datetime(2024, 12, 31) - datetime.timedelta(days=days)
    rows = [(1, "a", "n", "US", 31), (1, "b", "r", "US", 31), (1, "c", "r", "US", 181), (1, "d", "n", "US", 31), (1, "e", "t", "US", 999), (1, "f", "t", None, 31), (1, "g", None, "US", 181)]
    postings = spark.createDataFrame([(*r[:4], False, at(r[4])) for r in rows] + [(1, "h", "n", "US", True, None)], "site_id int, external_job_id string, normalized_title string, market_scope string, active boolean, closed_at timestamp")
    labels = spark.createDataFrame([("n", "non_target"), ("t", "target")], "normalized_title string, classification_status string")
    found = retention_candidates(postings, labels, spark.createDataFrame([(1, "d")], "site_id int, external_job_id string"), "2024-12-31")
    assert {r.external_job_id for r in found.collect()} == {"a", "c", "f", "g"}
    assert {r.external_job_id for r in prune(postings, found).collect()} == {"b", "d", "e", "h"}


def test_due_sites_order_nulls_last(spark):
    queue = spark.createDataFrame([(1, "P1", None, True), (2, "P1", 3, True), (3, "P0", 1, True), (4, "P0", 9, False)], "site_id int, priority_tier string, priority_score int, is_due boolean")
    assert [r.site_id for r in due_sites(queue, 5).collect()] == [3, 2, 1]
