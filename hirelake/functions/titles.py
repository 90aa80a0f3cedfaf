"""Column functions on job titles, occupation codes, employer names and error texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Product-role rules in order, as (category, contained pattern).
PRODUCT_ROLES = (
    ("product_manager", "product manager"),
    ("product_manager", "technical product manager"),
    ("project_manager", "project manager"),
    ("project_manager", "it project manager"),
    ("project_manager", "technical project manager"),
    ("project_manager", "information technology project manager"),
    ("technical_program_manager", "technical program manager"),
    ("architect", "solution architect"),
    ("architect", "solutions architect"),
    ("architect", "technical architect"),
    ("architect", "technology architect"),
    ("engineer", "systems engineer"),
    ("engineer", "system engineer"),
    ("engineer", "system engineers"),
    ("engineer", "sales engineer"),
    ("consultant", "technology consultant"),
    ("consultant", "solutions consultant"),
    ("agile", "scrum master"),
)
#: Fixed value: the pattern of executive titles.
EXECUTIVE = r"(^|[^a-z])(ceo|cfo|coo|cto|cio|cmo|cro|chro|chief[\s-]+([a-z]+[\s-]+){0,4}officer|president|vice president|executive director|managing director|general manager|owner|founder)([^a-z]|$)"
#: The stricter pattern of high seniority; what the first product rule takes and leaves out.
HIGH_SENIORITY = r"(^|[^a-z])(ceo|chief|president|vice president|vp|director|head|executive|managing director|senior manager|principal)([^a-z]|$)"
PRODUCT_V1 = (
    r"(product manager|product owner|technical product manager|product engineer|solution(s)? architect|solution(s)? engineer|sales engineer|systems? architects?|systems? engineers?"
    r"|product management|product lead|head of product|product director|principal product manager|associate product manager|senior product manager|group product manager"
    r"|vp[, ]+product|vice president[, ]+product|product program manager|technical program manager|\btpm\b)"
)
NOT_PRODUCT_V1 = r"(production supervisor|production manager|manufacturing production|food production|video production|media production)"
#: Languages that a title names, words of software work, and plain C titles, which are never targets.
C_FAMILY = ("c++", "c#", ".net/c#", "c#/.net")
SOFTWARE_WORDS = ("software", "developer", "engineer", "full stack", "full-stack", "backend", "frontend", "sdet")
PLAIN_C = r"(^|[^a-z0-9])c (software engineer|developer|programmer)([^a-z0-9]|$)"
#: Fixed value: texts that deny sponsorship; the first words match inside longer ones too.
NO_SPONSOR = r"(no|not).{0,50}(visa|h-?1b|sponsor|sponsorship)|without.{0,60}sponsorship|authorized.{0,80}without.{0,40}sponsorship|will not.{0,50}sponsor"
STRICT_NO_SPONSOR = NO_SPONSOR.replace("(no|not)", r"\b(no|not)\b")
#: Parts of titles by level, in order; a percent sign stands for any text between.
SENIORITY = (
    ("internship", ("intern", "internship", "co op", "co-op")),
    ("entry_level", ("new grad", "university grad", "entry level", "early career")),
    ("senior_or_leadership", ("senior", "sr ", "staff", "principal", "lead", "director", "vice president", "vp")),
)
#: What to do about an error that holds a text, in order, and about others.
NEXT_ACTIONS = (
    ("Rediscover career URL / ATS slug", ("404",)),
    ("Patch adapter request or endpoint handling", ("422", "workday")),
    ("Skip malformed jobs and retry", ("empty title", "missing title")),
)
OTHER_ACTION = "Inspect recent run log and group with similar failures"
#: Contained texts of each failure reason, in order.
FAILURES = (
    ("wrong_or_stale_ats_url", ("404",)),
    ("rate_limited", ("429", "rate")),
    ("timeout", ("timeout", "timed out")),
    ("blocked_or_forbidden", ("403", "forbidden")),
    ("empty_or_malformed_payload", ("empty", "missing title")),
    ("adapter_endpoint_or_payload", ("workday", "422")),
)


def normalize_soc_code(code: Column) -> Column:
    """``15-1252[.0]`` to eight digits, the last two padded from the left; null for other codes."""
    pattern = r"^\s*(\d{2})-(\d{4})(\.(\d{1,2}))?"
    tail = F.regexp_extract(code, pattern, 4)
    return F.when(code.rlike(pattern), F.concat(F.regexp_extract(code, pattern, 1), F.regexp_extract(code, pattern, 2), F.lpad(tail, 2, "0")))


def is_product_role(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    excluded = low.contains("program manager") & ~low.contains("technical program manager")
    return reduce(or_, (low.contains(p) for _, p in PRODUCT_ROLES)) & ~excluded


def product_role_category(title: Column) -> Column:
    """The category of the first rule whose pattern the title contains; null where it isn't a product role."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.when(is_product_role(title), F.coalesce(*(F.when(low.contains(p), F.lit(c)) for c, p in PRODUCT_ROLES)))


def is_product_manager(title: Column) -> Column:
    return product_role_category(title) == "product_manager"


def is_executive(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).rlike(EXECUTIVE)


def employer_match_key(name: Column) -> Column:
    """Lower-case words of letters and digits joined by hyphens; ``&`` reads as ``and``."""
    low = F.lower(F.regexp_replace(name, "&", " and "))
    return F.btrim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\s-]", " "), r"\s+", "-"), F.lit("-"))


def failure_reason(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    ladder = F.when(reduce(or_, (low.contains(t) for t in FAILURES[0][1])), FAILURES[0][0])
    for reason, found in FAILURES[1:]:
        ladder = ladder.when(reduce(or_, (low.contains(t) for t in found)), reason)
    return ladder.when(low == "", "unknown").otherwise("other")


def next_action(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    ladder = F.when(F.lit(False), "")
    for action, found in NEXT_ACTIONS:
        ladder = ladder.when(reduce(or_, (low.contains(t) for t in found)), action)
    return ladder.otherwise(OTHER_ACTION)


def is_high_seniority(title: Column) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).rlike(HIGH_SENIORITY)


def is_product_role_v1(title: Column) -> Column:
    """The first form of the product rule; its short form of the program manager counts as a word."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return low.rlike(PRODUCT_V1) & ~low.rlike(NOT_PRODUCT_V1)


def is_overridden(title: Column) -> Column:
    """Titles of the C family of languages, whatever their label says."""
    low = F.lower(F.coalesce(title, F.lit("")))
    has = lambda words: reduce(or_, (low.contains(w) for w in words))
    return (has(C_FAMILY) & has(SOFTWARE_WORDS)) | low.rlike(PLAIN_C)


def denies_sponsorship(text: Column, strict: bool = False) -> Column:
    """Whether a text denies visa sponsorship; ``strict`` takes the denying word as a word only."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(STRICT_NO_SPONSOR if strict else NO_SPONSOR)


def seniority_bucket(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    ladder = F.when(F.lit(False), "")
    for name, parts in SENIORITY:
        ladder = ladder.when(reduce(or_, (low.contains(p) for p in parts)), name)
    return ladder.otherwise("regular_full_time")


def employment_bucket(title: Column, kind: Column) -> Column:
    low, kind = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(reduce(or_, (low.contains(p) for p in SENIORITY[0][1])), "internship")
        .when(kind.contains("contract") | low.contains("contract"), "contract")
        .when(kind.like("%part%time%") | low.contains("part time"), "part_time")
        .when(kind.like("%full%time%"), "full_time")
        .otherwise("full_time_or_unknown")
    )


def location_bucket(location: Column) -> Column:
    low = F.lower(F.coalesce(location, F.lit("")))
    chicago = low.contains("chicago") | low.contains("illinois") | low.rlike("(^|[,/ -])il($|[,/ -])")
    return F.when(chicago, "chicago_or_illinois").when(low.contains("remote"), "remote").when(low == "", "location_not_listed").otherwise("other_us")


def matches_all_terms(text: Column, query: Column) -> Column:
    """Whether every word of the query, reduced to letters and digits, is part of the text."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(query), "[^a-z0-9]+", " ")), " "), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(F.lower(text), w))


def review_priority_band(active: Column, companies: Column) -> Column:
    return F.when((active >= 5) | (companies >= 3), "HIGH").when(active >= 2, "MEDIUM").otherwise("LATER")
