"""Job postings and links from captured pages and payloads."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from hirelake.functions.market import ELSEWHERE, OUTSIDE, STATES, market_scope
from hirelake.functions.text import clean_text, normalize_title, strip_html, unescape
from hirelake.functions.urls import classify_url, has_career_term, host_suffixes, once, posting_id, url_parts

#: Fixed value: words of titles that are out of scope.
OUT_OF_SCOPE = r"(?i)\b(about the role|europe|emea|apac|latam|canada|canadian|german|japanese|spanish|french|portuguese|italian|dutch|korean|hindi|mandarin)\b"
#: Words that companies' names have in common.
STOPWORDS = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "company", "companies", "co", "group", "holdings", "the", "plc")
SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""
ANCHOR = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']?([^"'>]+)["']?[^>]*>(.*?)</a>"""
EMBEDDED = r"""https?://[^\\"'<> )]+"""
#: Texts of links that name no job, and words that a job's title has.
BARE_LINK = r"(?i)^(apply|apply now|learn more|view job|view jobs|view openings|search jobs|all jobs|careers|career opportunities|join us|read more)$"
JOB_WORDS = r"(?i)\b(engineer|developer|analyst|manager|consultant|architect|specialist|designer|scientist|intern|associate|administrator|lead|director|product|data|software|systems?)\b"
SNIPPET, NEAR = 1000, 400
OPENING, CLOSING = re.compile(r"<a\b([^>]*)>", re.I), re.compile("</a>", re.I)
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]+)"|'([^']+)'|([^\s"'>]+))""", re.I)


def out_of_scope(title: Column) -> Column:
    return title.rlike(OUT_OF_SCOPE) | F.lower(title).rlike(rf"\b({'|'.join(ELSEWHERE)})\b")


def _listed(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def absolute(base: Column, link: Column) -> Column:
    """A link seen from its page: whole ones stay, those that begin with a slash keep the host, others the folder."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, "^([^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link == "", base)
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def extract_jobposting_jsonld(pages: DataFrame, default_market: str = "unknown") -> DataFrame:
    """The job postings that pages (site_id, url, html) declare, one row for each site and id.

    Scripts that aren't JSON, and postings without a title or with one out of scope, are left out. Places
    are joined; the id is a hash of url, title and place.
    """
    scripts = pages.select("site_id", F.col("url").alias("page_url"), F.explode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("script"))
    jobs = scripts.select("site_id", "page_url", F.explode(_job_objects("script")).alias("text")).select("site_id", "page_url", F.try_parse_json("text").alias("job")).where("job IS NOT NULL")
    places = F.coalesce(_listed(F.col("job"), "$.jobLocation"), F.array(F.try_variant_get("job", "$.jobLocation", "variant")))
    piece = lambda x, name: F.nullif(_text(x, f"$.address.{name}"), F.lit(""))
    address = F.filter(F.transform(places, lambda x: F.concat_ws(", ", piece(x, "addressLocality"), piece(x, "addressRegion"), piece(x, "addressCountry"))), lambda x: x != "")
    j = F.col("job")
    rows = jobs.select(
        "site_id", "page_url", clean_text(_text(j, "$.title")).alias("title"), clean_text(_text(j, "$.url")).alias("own_url"), F.coalesce(clean_text(F.array_join(address, "; ")), F.lit("")).alias("location"),
        clean_text(_text(j, "$.occupationalCategory")).alias("category"), F.substring(strip_html(_text(j, "$.description")), 1, SNIPPET).alias("description_snippet"),
        clean_text(_text(j, "$.datePosted")).alias("posted_text"), clean_text(F.coalesce(F.nullif(_text(j, "$.employmentType"), F.lit("")), _text(j, "$.hiringOrganization.name"))).alias("employment_type"),
    )
    rows = rows.where((F.col("title") != "") & ~out_of_scope(F.col("title")))
    link = F.when(F.col("own_url") == "", F.col("page_url")).otherwise(F.col("own_url"))
    rows = rows.withColumns({"external_job_id": posting_id(link, F.col("title"), F.col("location")), "job_url": absolute(F.col("page_url"), link), "normalized_title": normalize_title(F.col("title")), "market_scope": market_scope(F.col("location"), default_market)})
    columns = ["title", "normalized_title", "location", "category", "job_url", "description_snippet", "market_scope", "posted_text", "employment_type"]
    # Equal ids have equal urls, titles and places; of their other texts the least counts.
    return rows.groupBy("site_id", "external_job_id").agg(F.min(F.struct(*columns)).alias("j")).select("site_id", "external_job_id", "j.*")


def normalize_payloads(payloads: DataFrame, default_market: str = "unknown") -> DataFrame:
    """Postings of board payloads (site_id, fetched_at, body): a row for each site and job, of the last payload that has it.

    The body's ``jobs`` have id, title, location.name, absolute_url, content, updated_at and departments.
    """
    job = "struct<id:string,title:string,location:struct<name:string>,absolute_url:string,content:string,updated_at:string,departments:array<struct<name:string>>>"
    rows = payloads.select("site_id", "fetched_at", F.posexplode(F.from_json("body", f"struct<jobs:array<{job}>>")["jobs"]).alias("k", "job")).where("job.id IS NOT NULL")
    last = rows.groupBy("site_id", F.col("job.id").alias("external_job_id")).agg(F.max_by("job", F.struct("fetched_at", "k")).alias("job"))
    title, place = clean_text(F.col("job.title")), clean_text(F.col("job.location.name"))
    return last.select(
        "site_id", "external_job_id", title.alias("title"), normalize_title(title).alias("normalized_title"), place.alias("location"), F.array_join(F.col("job.departments.name"), ", ").alias("category"),
        clean_text(F.col("job.absolute_url")).alias("job_url"), F.substring(strip_html(F.col("job.content")), 1, SNIPPET).alias("description_snippet"), market_scope(place, default_market).alias("market_scope"),
        clean_text(F.col("job.updated_at")).alias("posted_text"), F.lit("").alias("employment_type"),
    )


def _posting(title: Column, place: Column, default_market: str, **texts: Column) -> list[Column]:
    """The columns of a posting; those without a text are empty."""
    text = lambda c: texts.get(c, F.lit("")).alias(c)
    return [title.alias("title"), normalize_title(title).alias("normalized_title"), place.alias("location"), text("category"), text("job_url"), text("description_snippet"), market_scope(place, default_market).alias("market_scope"), text("posted_text"), text("employment_type")]


def _some(*texts: Column) -> Column:
    """The first text that isn't empty, clean; else an empty one."""
    return clean_text(F.coalesce(*(F.nullif(t, F.lit("")) for t in texts), F.lit("")))


def normalize_content_payloads(payloads: DataFrame, default_market: str = "unknown") -> DataFrame:
    """Postings of payloads (site_id, fetched_at, token, body) whose ``content`` lists jobs; the last of a job counts.

    A job's department is an object (label, name or id) or a text; names, ids and places have second names.
    """
    rows = payloads.select("site_id", "fetched_at", "token", F.posexplode(F.try_variant_get(F.try_parse_json("body"), "$.content", "array<variant>")).alias("k", "j"))
    j = F.col("j")
    key = _some(_text(j, "$.id"), _text(j, "$.refNumber"))
    last = rows.withColumn("external_job_id", key).groupBy("site_id", "external_job_id").agg(F.max_by(F.struct("j", "token"), F.struct("fetched_at", "k")).alias("l")).select("site_id", "external_job_id", "l.*")
    inside = F.try_variant_get("j", "$.department", "map<string,variant>").isNotNull()
    category = F.when(inside, _some(*(_text(j, f"$.department.{c}") for c in ("label", "name", "id")))).otherwise(_some(_text(j, "$.department"), _text(j, "$.industry")))
    title, place = _some(_text(j, "$.name"), _text(j, "$.title")), _some(*(_text(j, f"$.location.{c}") for c in ("fullLocation", "city", "region")))
    url = _some(_text(j, "$.ref"), F.concat(F.lit("https://jobs.smartrecruiters.com/"), "token", F.lit("/"), "external_job_id"))
    texts = {"category": category, "job_url": url, "description_snippet": F.substring(_some(_text(j, "$.description")), 1, SNIPPET), "posted_text": _some(_text(j, "$.releasedDate"), _text(j, "$.updatedDate")), "employment_type": _some(_text(j, "$.typeOfEmployment"), _text(j, "$.experienceLevel"))}
    return last.select("site_id", "external_job_id", *_posting(title, place, default_market, **texts))


def normalize_listing_payloads(payloads: DataFrame, default_market: str = "unknown") -> DataFrame:
    """Postings of payloads (site_id, fetched_at, base_url, body) whose ``jobPostings`` are one page of a listing.

    The id is the first bullet, else the path; jobs without an id or a title go; the last of a job counts.
    """
    job = "struct<title:string,externalPath:string,locationsText:string,postedOn:string,timeType:string,bulletFields:array<string>>"
    rows = payloads.select("site_id", "fetched_at", "base_url", F.posexplode(F.from_json("body", f"struct<jobPostings:array<{job}>>")["jobPostings"]).alias("k", "j"))
    path = _some(F.col("j.externalPath"))
    rows = rows.withColumns({"external_job_id": F.when(F.size("j.bulletFields") > 0, _some(F.get("j.bulletFields", F.lit(0)))).otherwise(path), "title": _some(F.col("j.title"))}).where("external_job_id <> '' AND title <> ''")
    last = rows.groupBy("site_id", "external_job_id").agg(F.max_by(F.struct("j", "base_url", "title"), F.struct("fetched_at", "k")).alias("l")).select("site_id", "external_job_id", "l.*")
    texts = {"job_url": F.concat("base_url", path), "posted_text": _some(F.col("j.postedOn")), "employment_type": _some(F.col("j.timeType"))}
    return last.select("site_id", "external_job_id", *_posting(F.col("title"), _some(F.col("j.locationsText")), default_market, **texts))


def company_tokens(name: Column) -> Column:
    """The telling words of a company's name."""
    return F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def page_links(pages: DataFrame) -> DataFrame:
    """(site_id, consolidation_key, canonical_name, page_url, link, label) of each anchor of the pages, and of each url in their source."""
    named = ("site_id", "consolidation_key", "canonical_name", F.col("url").alias("page_url"))
    hrefs, labels = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2))
    rows = pages.select(*named, F.explode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("a"))
    anchors = rows.select("site_id", "consolidation_key", "canonical_name", "page_url", absolute(F.col("page_url"), unescape(F.col("a.href"))).alias("link"), strip_html(F.col("a.label")).alias("label"))
    raw = pages.select(*named, F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(EMBEDDED), F.lit(0)))).alias("raw"))
    return anchors.unionByName(raw.select("site_id", "consolidation_key", "canonical_name", "page_url", unescape(F.col("raw")).alias("link"), F.lit("embedded URL").alias("label")))


def resolve_ats_links(links: DataFrame, excluded: DataFrame, supported: tuple[str, ...], places: int = 3) -> DataFrame:
    """The best links of each company to known services, scored; each canonical url once.

    Excluded domains (domain) are found by equality with the host's parent domains.
    """
    rows = links.where(F.col("link").rlike("^https?://") & ~F.lower("link").rlike(r"\.(css|js|png|jpe?g|gif|svg|ico|woff2?|ttf|pdf)(\?|#|$)")).select("*", once(classify_url(url_parts(F.col("link")))).alias("c")).where("c.host <> '' AND c.source_type <> 'generic_html'")
    rows = rows.withColumn("suffix", host_suffixes(F.col("c.host")))
    hosts = rows.select(F.col("c.host").alias("host"), "suffix").distinct().withColumn("domain", F.explode("suffix"))
    out = hosts.join(excluded.select("domain").distinct(), "domain", "left_semi").select("host").distinct()
    rows = rows.join(out, rows["c.host"] == out["host"], "left_anti")
    text = F.lower(F.concat_ws(" ", "link", "label"))
    score = 65 + F.when(has_career_term(text), 15).otherwise(0) + F.when(F.exists(F.slice(company_tokens(F.col("canonical_name")), 1, 4), lambda w: F.contains(text, w)), 10).otherwise(0) + F.when(F.col("c.source_type").isin(*supported), 10).otherwise(0)
    best = rows.withColumn("score", score).groupBy("consolidation_key", F.col("c.canonical_url").alias("site_url")).agg(F.max_by(F.struct("c.source_type", "c.source_key"), "score").alias("c"), F.max("score").alias("candidate_score"))
    order = Window.partitionBy("consolidation_key").orderBy(F.desc("candidate_score"), "site_url")
    # Each task keeps its first places before companies meet.
    ranked = best.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= places)
    return ranked.select("consolidation_key", "candidate_rank", "candidate_score", "site_url", "c.source_type", "c.source_key")


def link_jobs(pages: DataFrame, default_market: str = "unknown") -> DataFrame:
    """US jobs among the plain links of pages (site_id, url, html) that declare none: a row for each site and id.

    A link counts if its text has 4 to 140 characters, a job's word and nothing that is out of scope, and
    if the text within 400 characters of its tag names a US place and no other country. Pages are scanned
    once, tag by tag; what isn't closed ends the scan.
    """
    links = pages.select("site_id", F.col("url").alias("page_url"), F.posexplode(_near_links(F.coalesce("html", F.lit("")))).alias("k", "a")).select("site_id", "page_url", "k", "a.*")
    rows = links.select("site_id", "page_url", "k", "href", "near", once(strip_html(F.col("label"))).alias("title"))
    rows = rows.where(F.length("title").between(4, 140) & ~F.col("title").rlike(BARE_LINK) & F.col("title").rlike(JOB_WORDS) & ~out_of_scope(F.col("title")))
    rows = rows.select("site_id", "page_url", "k", "href", "title", once(strip_html(F.col("near"))).alias("near"))
    rows = rows.select("*", once(us_location(F.col("near"))).alias("location")).where("location <> ''")
    rows = rows.where(market_scope(F.col("location"), default_market) == "US").withColumn("job_url", absolute(F.col("page_url"), clean_text(F.col("href"))))
    rows = rows.withColumn("external_job_id", posting_id(F.col("job_url"), F.col("title"), F.col("location")))
    none = F.lit("")
    job = F.struct("title", normalize_title(F.col("title")).alias("normalized_title"), "location", none.alias("category"), "job_url", F.substring("near", 1, SNIPPET).alias("description_snippet"), F.lit("US").alias("market_scope"), none.alias("posted_text"), none.alias("employment_type"))
    return rows.groupBy("site_id", "external_job_id").agg(F.min_by(job, "k").alias("j")).select("site_id", "external_job_id", "j.*")


def us_location(text: Column) -> Column:
    """The US place that a text names: a city and its state, a remote or country-wide one, or a state; empty with a sign of another country."""
    low = F.lower(text)
    city = F.regexp_extract(text, rf"\b([A-Z][A-Za-z .'-]{{2,40}},\s*(?:{'|'.join(sorted(STATES.values()))}))\b", 1)
    states = F.coalesce(*(F.when(low.rlike(rf"\b{s}\b"), s.title()) for s in STATES), F.lit(""))
    return F.when(low.rlike(OUTSIDE), "").when(city != "", clean_text(city)).when(low.rlike(r"\b(remote|united states|u\.s\.|u\.s\.a\.|usa)\b"), "United States").otherwise(states)


def near_links(page: str) -> list[dict[str, str]]:
    """Target, inner html and surroundings of each closed anchor of a page."""
    found, at = [], 0
    while tag := OPENING.search(page, at):
        target = HREF.search(tag[1])
        if not target:
            at = tag.end()
            continue
        end = CLOSING.search(page, tag.end())
        if not end:
            break
        at = end.end()
        found.append({"href": next(g for g in target.groups() if g is not None), "label": page[tag.end() : end.start()], "near": page[max(0, tag.start() - NEAR) : at + NEAR]})
    return found


def job_objects(script: str) -> list[str]:
    """The JSON of each job posting in a script's lists and graphs, however deep; none if the script isn't JSON."""
    try:
        payload = json.loads(html.unescape(script).strip(), parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        return []
    found, open_ = [], [payload]
    while open_:
        x = open_.pop()
        if isinstance(x, list):
            open_.extend(reversed(x))
        elif isinstance(x, dict) and isinstance(x.get("@graph"), list):
            open_.extend(reversed(x["@graph"]))
        elif isinstance(x, dict):
            kind = x.get("@type")
            if "JobPosting" in (kind if isinstance(kind, list) else [kind]):
                found.append(json.dumps(x))
    return found


@F.pandas_udf(ArrayType(StructType([StructField(n, StringType()) for n in ("href", "label", "near")])))
def _near_links(pages: pd.Series) -> pd.Series:
    return pages.map(near_links)


@F.pandas_udf(ArrayType(StringType()))
def _job_objects(scripts: pd.Series) -> pd.Series:
    return scripts.map(job_objects)
