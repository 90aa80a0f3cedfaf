"""URLs of career sites: their parts, the service behind them, and the templates of their paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of career paths.
CAREER_TERMS = ("career", "careers", "jobs", "job", "join", "opportunities", "openings")
#: Hosts whose first path segment names the company, with the service and what follows the name.
KEYED_HOSTS = {
    "boards.greenhouse.io": ("greenhouse", ""), "job-boards.greenhouse.io": ("greenhouse", ""), "jobs.lever.co": ("lever", ""), "jobs.eu.lever.co": ("lever", ""),
    "jobs.ashbyhq.com": ("ashby", ""), "careers.smartrecruiters.com": ("smartrecruiters", ""), "jobs.jobvite.com": ("jobvite", "/jobs"),
    "apply.workable.com": ("workable", ""), "jobs.workable.com": ("workable", ""), "ats.rippling.com": ("rippling", "/jobs"), "app.trinethire.com": ("trinethire", ""),
}
#: Hosts whose first segments name the company: host or its ending, service, segments.
SEGMENT_HOSTS = (("recruiting.paylocity.com", "paylocity", 3, True), ("recruiting.ultipro.com", "ultipro", 2, True), ("comeet.com", "comeet", 2, False))
#: Endings of hosts that are a company's own at a service.
SUFFIX_HOSTS = (
    ("myworkdayjobs.com", "workday"), ("icims.com", "icims"), ("successfactors.com", "successfactors"), ("phenompeople.com", "phenom"), ("phenom.com", "phenom"), ("talentbrew.com", "talentbrew"),
)
#: Hosts of one company each, with what the path must hold.
OWN_HOSTS = (("careers.cognizant.com", "/jobs", "cognizant_jobs"), ("jobs.uber.com", "/jobs", "uber_jobs"))
EIGHTFOLD_HOSTS = ("portal.careers.hsbc.com", "jobs.ericsson.com")


def url_parts(url: Column) -> Column:
    """scheme, netloc, host (lower case, without port and www.), path, query and the path's segments."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    part = lambda k: F.regexp_extract(text, pattern, k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(2)), ":.*$", ""), r"^www\.", "")
    return F.struct(
        part(1).alias("scheme"), part(2).alias("netloc"), host.alias("host"), part(3).alias("path"), part(4).alias("query"),
        F.filter(F.split(part(3), "/"), lambda s: s != "").alias("segments"),
    )


def has_career_term(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, (low.contains(t) for t in CAREER_TERMS))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """A value made in a step of its own: later steps read it and don't make it again for each of its fields."""
    return F.explode(F.array(value))


def _rules(u: Column) -> list[tuple[Column, str, Column, Column]]:
    """Condition, service, company's key and canonical path of each known kind of host, in order."""
    host, path, segments, first, count, plain = (u[c] for c in ("host", "path", "segments", "first", "count", "plain"))
    at = lambda k: F.get(segments, F.lit(k))
    slash = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in ("/", *parts)))
    rules: list[tuple[Column, str, Column, Column]] = []
    for name, (kind, tail) in KEYED_HOSTS.items():
        key = F.when(first == "embed", u["asked"]).otherwise(first) if kind == "greenhouse" else F.when((first == "careers") & (count >= 2), at(1)).otherwise(first) if kind == "jobvite" else first
        rules.append(((host == name) & key.isNotNull(), kind, key, slash(key, tail)))
    rules.append(((host == "api.smartrecruiters.com") & (count >= 3) & (first == "v1") & (at(1) == "companies"), "smartrecruiters", at(2), slash(at(2))))
    for name, kind, size, whole in SEGMENT_HOSTS:
        key = F.array_join(F.slice(segments, 1, size), "/")
        rules.append((((host == name) if whole else host.endswith(name)) & (count >= size), kind, key, slash(key)))
    rules += [(host.endswith(name), kind, host, plain) for name, kind in SUFFIX_HOSTS]
    rules.append(((host == "sjobs.brassring.com") | host.endswith(".brassring.com"), "brassring", host, plain))
    place = F.array_position(segments, "sites").cast("int")
    site = F.coalesce(F.when(place > 0, F.get(segments, place)), host)
    locale = F.when(place > 1, F.array_join(F.slice(segments, F.lit(1), place - 1), "/")).otherwise("hcmUI/CandidateExperience/en")
    rules.append((host.endswith("oraclecloud.com") & path.contains("CandidateExperience") & path.contains("/sites/"), "oracle_cloud", site, slash(locale, "/sites/", site, "/jobs")))
    rules.append(((host == "amazon.jobs") & has_career_term(path), "amazon_jobs", host, plain))
    rules += [((host == name) & path.contains(part), kind, host, plain) for name, part, kind in OWN_HOSTS]
    rules.append((host.endswith("eightfold.ai") | host.isin(*EIGHTFOLD_HOSTS), "eightfold", host, plain))
    return rules


def classify_url(u: Column) -> Column:
    """(canonical_url, host, site_kind, source_type, source_key) of a url's parts (``url_parts``).

    The first rule that fits is found once, by its number; the fields follow from the number.
    """
    known = lambda u: F.struct(
        *(u[c].alias(c) for c in ("scheme", "netloc", "host", "path", "segments")), F.get(u["segments"], F.lit(0)).alias("first"), F.size(u["segments"]).alias("count"),
        F.when(F.regexp_replace(u["path"], "/+$", "") == "", "/").otherwise(F.regexp_replace(u["path"], "/+$", "")).alias("plain"), F.nullif(F.regexp_extract(u["query"], r"(?:^|&)for=([^&]*)", 1), F.lit("")).alias("asked"),
    )
    number = lambda u: F.coalesce(*(F.when(rule[0], F.lit(k)) for k, rule in enumerate(_rules(u))), F.lit(-1))
    return bound(bound(u, known), lambda v: bound(F.struct(v.alias("u"), number(v).alias("rule")), _fields))


def _fields(w: Column) -> Column:
    u, rule = w["u"], w["rule"]
    rules = _rules(u)
    kinds = [kind for _, kind, _, _ in rules]

    def by_rule(values: list[Column], otherwise: Column) -> Column:
        return F.coalesce(*(F.when(rule == k, value) for k, value in enumerate(values)), F.when(rule < 0, otherwise))

    moved = rule == next(k for k, (_, kind, _, _) in enumerate(rules) if kind == "smartrecruiters" and k >= len(KEYED_HOSTS))
    shown = F.when(moved, "careers.smartrecruiters.com").otherwise(u["host"])
    scheme = F.coalesce(F.nullif(u["scheme"], F.lit("")), F.lit("https"))
    canonical = F.concat(scheme, F.lit("://"), F.when(moved, shown).otherwise(u["netloc"]), by_rule([path for _, _, _, path in rules], u["plain"]))
    site_kind = F.when(rule >= 0, "ats_feed").when(has_career_term(u["path"]), "careers").otherwise("corporate")
    source_type = F.when(rule < 0, "generic_html").otherwise(F.get(F.array(*map(F.lit, kinds)), rule))
    key = by_rule([key for _, _, key, _ in rules], F.lit(None).cast("string"))
    return F.struct(canonical.alias("canonical_url"), shown.alias("host"), site_kind.alias("site_kind"), source_type.alias("source_type"), key.alias("source_key"))


def url_host(url: Column) -> Column:
    """The host in lower case, without scheme, ``www.`` and path."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(F.lower(url), "^[a-z]+://", ""), "^([^/?#]*)", 1), r"^www\.", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.lower(url), "^[a-z]+://", ""), "^[^/?#]*([^?#]*)", 1)


#: Services by the end of a host, the words of a career page's path, and the patterns of paths.
MISSED = (
    ("%myworkdayjobs.com", "workday"), ("%greenhouse.io", "greenhouse"), ("%lever.co", "lever"), ("%ashbyhq.com", "ashby"), ("%smartrecruiters.com", "smartrecruiters"),
    ("%icims.com", "icims"), ("%successfactors.%", "successfactors"), ("%oraclecloud.com%", "oracle_cloud"),
)
CAREER_PATH = "(career|careers|job|jobs|openings|opportunities)"
PATH_PATTERNS = (
    ("^/?$", "/"), ("^/(en-us|en|us)/(career|careers|jobs)(/|$)", "/locale/careers"), ("^/(career|careers)(/|$)", "/careers"), ("^/(job|jobs)(/|$)", "/jobs"),
    ("^/(join-us|join|work-with-us)(/|$)", "/join"), ("^/(about|company)(/|$)", "/about"),
)


def template_family(host: Column, path: Column) -> Column:
    """The kind of page behind a plain site: a service that was missed, a career page, or another."""
    missed = (F.when(host.like(p), f"{name}_domain_missed") for p, name in MISSED)
    return F.coalesce(*missed, F.when(path.rlike(CAREER_PATH), "corporate_careers_page"), F.lit("generic_or_corporate_page"))


def path_pattern(path: Column) -> Column:
    """The first pattern that the path has, else the path with ``:id`` for digits after a slash."""
    known = (F.when(path.rlike(p), name) for p, name in PATH_PATTERNS)
    return F.coalesce(*known, F.regexp_replace(path, "/[0-9]+", "/:id"))


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains, so that domains are found by equality."""
    names = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, k, F.size(names)), "."))


def canonical_job_url(url: Column) -> Column:
    """The url without its ``in_iframe`` parameter."""
    return F.regexp_replace(F.regexp_replace(url, r"([?&])in_iframe=[^&#]*&?", "$1"), r"[?&](?=#|$)", "")


def posting_id(url: Column, title: Column, location: Column) -> Column:
    """The first 24 digits of the hash of url, title and place."""
    return F.substring(F.sha1(F.concat_ws("|", url, title, location)), 1, 24)
