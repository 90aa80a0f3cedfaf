import json

from pyspark.sql import functions as F

from hirelake.functions.urls import classify_url, url_parts
from hirelake.operators import pages


def test_postings_nest_without_a_limit():
    payload = {"@type": "JobPosting", "title": "T"}
    for _ in range(200):
        payload = {"@graph": [[payload]]}
    assert [json.loads(x)["title"] for x in pages.job_objects(json.dumps([payload, {"@type": ["A", "JobPosting"], "title": "U"}, 3, None, {"@type": "B"}]))] == ["T", "U"]
    assert pages.job_objects("{") == [] and pages.job_objects("") == [] and pages.job_objects("[" * 100_000) == []
    assert len(pages.job_objects('&quot;x&quot;')) == 0 and pages.job_objects('{"@type":"JobPosting","n":NaN}') == ['{"@type": "JobPosting", "n": null}']


def test_anchors_are_scanned_once():
    page = "x" * 500 + "<a id=1>no</a><A class='k' HREF = '/p?q'>One <b>x</b></A>tail" + "<a href=/two title=t>Two</a>" + "y" * 500 + "<a href='/open'>never closed" * 3
    found = pages.near_links(page)
    assert [(f["href"], f["label"]) for f in found] == [("/p?q", "One <b>x</b>"), ("/two", "Two")]
    assert len(found[0]["near"]) > 800 and found[0]["near"].startswith("x")
    assert len(pages.near_links("<a href=x>" * 20_000)) == 0 and pages.near_links("") == []


def test_links_need_a_job_and_a_us_place(spark):
    text = [
        ("Austin, TX", "Data Engineer"), ("Remote", "Apply now"), ("Toronto, Canada", "Data Engineer"), ("nowhere", "Data Engineer"), ("We hire in New Jersey", "Sales Manager"), ("U.S. only", "QA"),
        ("Remote", "Gardener"), ("Remote", "Product Lead, EMEA"), ("Remote", "x" * 130 + " software engineer"),
    ]
    rows = [(k, "https://h.org/a/b?x", f"<p>{place}</p><a href='c?d&amp;e'>{title}</a><a href='c?d&amp;e'>{title}</a>", "t") for k, (place, title) in enumerate(text)]
    df = spark.createDataFrame([*rows, (90, None, None, None)], "site_id int, url string, html string, title string")
    found = {r.site_id: (r.title, r.location, r.job_url) for r in pages.link_jobs(df).collect()}
    assert found == {0: ("Data Engineer", "Austin, TX", "https://h.org/a/c?d&e"), 4: ("Sales Manager", "New Jersey", "https://h.org/a/c?d&e")}
    assert pages.link_jobs(df.limit(0)).count() == 0


def test_embedded_urls_count(spark):
    df = spark.createDataFrame([(1, "k", "Acme", "https://acme.org", 'var u="https://jobs.lever.co/acme/1?x=1&amp;y"; <a href="https://jobs.lever.co/acme">Careers</a>')], "site_id int, consolidation_key string, canonical_name string, url string, html string")
    none = spark.createDataFrame([], "domain string")
    found = pages.resolve_ats_links(pages.page_links(df), none, ("lever",)).collect()
    assert [(r.candidate_rank, r.candidate_score, r.site_url, r.source_key) for r in found] == [(1, 100, "https://jobs.lever.co/acme", "acme")]


def test_every_kind_of_host(spark):
    urls = {
        "https://boards.greenhouse.io/embed/job_board?for=acme": ("greenhouse", "acme", "https://boards.greenhouse.io/acme"), "https://jobs.jobvite.com/careers/acme/x": ("jobvite", "acme", "https://jobs.jobvite.com/acme/jobs"),
        "https://api.smartrecruiters.com/v1/companies/acme": ("smartrecruiters", "acme", "https://careers.smartrecruiters.com/acme"), "https://recruiting.paylocity.com/a/b/c/d": ("paylocity", "a/b/c", "https://recruiting.paylocity.com/a/b/c"),
        "https://recruiting.ultipro.com/a/b/c": ("ultipro", "a/b", "https://recruiting.ultipro.com/a/b"), "https://www.comeet.com/jobs/x": ("comeet", "jobs/x", "https://www.comeet.com/jobs/x"), "https://jobs.ashbyhq.com/acme/1": ("ashby", "acme", "https://jobs.ashbyhq.com/acme"),
        "https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/job/2": ("oracle_cloud", "CX_1", "https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/jobs"), "https://a.brassring.com/q/": ("brassring", "a.brassring.com", "https://a.brassring.com/q"),
        "https://amazon.jobs/en/jobs/1": ("amazon_jobs", "amazon.jobs", "https://amazon.jobs/en/jobs/1"), "https://a.eightfold.ai/careers": ("eightfold", "a.eightfold.ai", "https://a.eightfold.ai/careers"), "https://www.acme.com/about": ("generic_html", None, "https://www.acme.com/about"),
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", classify_url(url_parts(F.col("u"))).alias("c")).collect()
    assert {r.u: (r.c.source_type, r.c.source_key, r.c.canonical_url) for r in rows} == urls


def test_payloads_of_three_shapes(spark):
    rows = [(1, 1, "t", "https://h/jobs", '{"content":[{"id":"","refNumber":"R1","title":"QA","location":{"city":"","region":"TX"},"department":"Ops"},{"id":7,"name":"A &amp; B","location":{},"department":{"id":3},"ref":"u"}]}'), (1, 2, "t", "b", "no json"), (2, 1, "t", "b", None)]
    df = spark.createDataFrame(rows, "site_id int, fetched_at int, token string, base_url string, body string")
    found = {r.external_job_id: (r.title, r.location, r.category, r.job_url, r.market_scope) for r in pages.normalize_content_payloads(df).collect()}
    assert found == {"R1": ("QA", "TX", "Ops", "https://jobs.smartrecruiters.com/t/R1", "unknown"), "7": ("A & B", "", "3", "u", "unknown")}
    listing = spark.createDataFrame([(1, 1, "https://h/s", '{"jobPostings":[{"title":"A","externalPath":"/p","bulletFields":["X"]},{"title":"B","externalPath":"/q","locationsText":"Austin, TX"},{"title":" ","externalPath":"/r"}]}'), (1, 2, "https://h/s", '{"jobPostings":[{"title":"A2","externalPath":"/p2","bulletFields":["X"]}]}')], "site_id int, fetched_at int, base_url string, body string")
    found = {r.external_job_id: (r.title, r.job_url, r.market_scope) for r in pages.normalize_listing_payloads(listing).collect()}
    assert found == {"X": ("A2", "https://h/s/p2", "unknown"), "/q": ("B", "https://h/s/q", "US")}
