import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hirelake.functions import roles, titles
from hirelake.functions.text import clean_text, normalize_title, strip_html
from hirelake.functions.urls import canonical_job_url, classify_url, host_suffixes, url_parts
from hirelake.operators import discovery, labels, pages, repair
from hirelake.sources.tables import read_csv


def one(spark, f, xs):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x string").select("k", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.k)]


def test_title_and_text_functions(spark):
    assert one(spark, titles.denies_sponsorship, ["We will not sponsor visas", "sponsorship available", None, "modern technology and a visa card"]) == [True, False, False, True]
    assert one(spark, lambda c: titles.denies_sponsorship(c, strict=True), ["modern technology and a visa card", "no visa help"]) == [False, True]
    assert one(spark, titles.is_overridden, ["C++ Software Engineer", "C Developer", "C# teacher", "Basic C Developer II", None]) == [True, True, False, True, False]
    assert one(spark, titles.seniority_bucket, ["data intern", "early career analyst", "staff engineer", "analyst", None]) == ["internship", "entry_level", "senior_or_leadership", "regular_full_time", "regular_full_time"]
    assert one(spark, titles.location_bucket, ["Aurora, IL", "Remote", "", "Austin", None]) == ["chicago_or_illinois", "remote", "location_not_listed", "other_us", "location_not_listed"]
    assert one(spark, lambda c: titles.matches_all_terms(c, F.lit("Data, chicago!")), ["Big data in Chicago", "data only"]) == [True, False]
    assert one(spark, lambda c: roles.role_family(c, F.lit(None).cast("string")), ["senior product manager", "data engineer", "florist"]) == ["product_manager", "data_engineering", "title:florist"]
    assert one(spark, lambda c: roles.role_stack(c, F.lit(None).cast("string")), ["business analyst", "cloud engineer", "florist"]) == ["stack_1_business_product_data", "stack_4_sde", "stack_5_possible_target"]
    assert one(spark, strip_html, ["<p>A &amp; B</p>  c", None]) == ["A & B c", ""] and one(spark, clean_text, [" a&nbsp; b "]) == ["a b"]
    assert one(spark, normalize_title, ["Sr. C++ / C# Engineer (Remote)!"]) == ["sr. c++ / c# engineer remote"]


def test_url_functions(spark):
    found = one(spark, lambda c: classify_url(url_parts(c)), ["https://boards.greenhouse.io/embed/job_board?for=acme", "https://www.acme.com/about", "https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/3", "https://api.smartrecruiters.com/v1/companies/Acme/postings", None])
    assert [(r.canonical_url, r.site_kind, r.source_type, r.source_key) for r in found[:4]] == [
        ("https://boards.greenhouse.io/acme", "ats_feed", "greenhouse", "acme"), ("https://www.acme.com/about", "corporate", "generic_html", None),
        ("https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/jobs", "ats_feed", "oracle_cloud", "CX_1"), ("https://careers.smartrecruiters.com/Acme", "ats_feed", "smartrecruiters", "Acme"),
    ]
    assert one(spark, host_suffixes, ["a.b.com"]) == [["a.b.com", "b.com", "com"]]
    assert one(spark, canonical_job_url, ["https://x/y?in_iframe=1&a=2", "https://x/y?a=2&in_iframe=1", "https://x/y?in_iframe=1", "https://x/y?in_iframe=1#z"]) == ["https://x/y?a=2", "https://x/y?a=2", "https://x/y", "https://x/y#z"]
    assert one(spark, lambda c: discovery.search_terms(c, F.lit("acme| Acme Labs |ACME labs|")), ["Acme"]) == [["Acme", "Acme Labs"]]
    assert one(spark, lambda c: discovery.search_query(discovery.search_terms(c, F.lit(None).cast("string"))), ["Acme"]) == ['("Acme") official careers jobs']
    assert one(spark, lambda c: pages.absolute(F.lit("https://e.org/a/b"), c), ["/x", "y", "//z.org/q", "https://w", ""]) == ["https://e.org/x", "https://e.org/a/y", "https://z.org/q", "https://w", "https://e.org/a/b"]


def test_declared_postings(spark):
    script = '<SCRIPT type="application/ld+json">{}</SCRIPT>'
    job = '{"@type":["JobPosting","Thing"],"title":"Data Engineer","jobLocation":[{"address":{"addressLocality":"Chicago","addressRegion":"IL"}},{"address":{}}],"hiringOrganization":{"name":"Acme"}}'
    bodies = [f"[{job}, {job}]", '{"@graph":[[' + job + ']]}', "{not json", '{"@type":"JobPosting","title":"Engineer, Canada"}', '{"@type":"JobPosting","title":""}', '{"@type":"Person"}', "3"]
    rows = [(k, "https://e.org/jobs", script.format(b)) for k, b in enumerate(bodies)] + [(90, "https://e.org", None), (91, "https://e.org", "")]
    found = pages.extract_jobposting_jsonld(spark.createDataFrame(rows, "site_id int, url string, html string")).collect()
    assert sorted((r.site_id, r.title, r.location, r.job_url, r.employment_type, r.market_scope) for r in found) == [(k, "Data Engineer", "Chicago, IL", "https://e.org/jobs", "Acme", "US") for k in (0, 1)]


def test_wage_repair_guards(spark):
    filings = spark.sql("SELECT 1 AS lca_case_id, 'a' AS case_number, 'f' AS employer_fein, CAST(5 AS decimal(14,2)) AS wage_rate_of_pay_from, '105997' AS wage_unit_of_pay, DATE '2024-11-01' AS decision_date UNION ALL SELECT 2, 'b', 'f', 7, 'Year', DATE '2024-11-01'")
    stage = spark.createDataFrame([("a", "90000", " "), ("c", "1", "Year")], "case_number string, wage_rate_of_pay_from string, wage_unit_of_pay string")
    span = ("2024-10-01", "2024-12-31")
    fixed, backup = repair.repair_wages(filings, stage, *span, expected={"stage_rows": 2, "affected_rows": 1})
    assert sorted((r.lca_case_id, float(r.wage_rate_of_pay_from), r.wage_unit_of_pay) for r in fixed.collect()) == [(1, 90000.0, None), (2, 7.0, "Year")]
    assert backup.first().old_wage_unit_of_pay == "105997"
    for wrong, expected in ((stage.where("case_number = 'c'"), None), (stage.withColumn("wage_unit_of_pay", F.lit("Decade")), None), (stage, {"stage_rows": 3})):
        with pytest.raises(ValueError):
            repair.repair_wages(filings, wrong, *span, expected=expected)


def test_labels_dimension_and_trust(spark):
    soc = spark.createDataFrame([("1", "old", True), ("2", "two", True)], "normalized_soc_code string, representative_title string, active boolean")
    review = spark.createDataFrame([("1", "A", "target", 3), ("1", "B", "target", 9), ("3", "C", "non_target", 1)], "normalized_soc_code string, soc_title string, review_status string, lca_count int")
    assert sorted(map(tuple, labels.apply_soc_review(soc, review).select("normalized_soc_code", "representative_title", "active").collect())) == [("1", "B", True), ("2", "two", False), ("3", "C", False)]
    sites = spark.createDataFrame([(1, "k", "lever", 2, 5.0, "u", "h", "unverified", False), (2, "k", "lever", 1, 1.0, "u", "h", "unverified", False), (3, "z", "lever", 1, 1.0, "u", "h", "unverified", False)], "site_id int, consolidation_key string, source_type string, candidate_rank int, candidate_score double, site_url string, normalized_domain string, verification_status string, crawl_enabled boolean")
    targets = spark.createDataFrame([("k", True, "P1"), ("z", False, "P1")], "consolidation_key string, enabled boolean, priority_tier string")
    assert {r.site_id: (r.verification_status, r.crawl_enabled) for r in discovery.auto_trust_sites(sites, targets).collect()} == {1: ("unverified", False), 2: ("verified", True), 3: ("unverified", False)}


def test_csv_is_read_by_its_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,s\n1,x\nbad,\n")
    rows = read_csv(spark, str(tmp_path), StructType.fromDDL("n int, s string")).collect()
    assert sorted(((r.n, r.s) for r in rows), key=str) == [(1, "x"), (None, None)]
