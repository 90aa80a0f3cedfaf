"""Families and stacks of job roles, by ordered patterns of titles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACK = "candidate_profile_track: "
#: The family of each track of canonical roles.
TRACK_FAMILIES = {
    "product": "product_manager", "analyst/bi": "data_analytics_bi", "solutions/systems": "systems_engineering", "applied_ai": "applied_ai",
    "customer_success": "customer_success", "marketing automation": "marketing", "software/data": "software_engineering",
}
#: Title patterns of each family, in order; a percent sign stands for any text.
DATA_ENGINEERS = ("data%engineer", "analytics%engineer", "data%architect")
DATABASES = ("database%administrator", "database%admin")
FAMILIES = (
    ("internship", ("intern", "internship", "co op", "co-op")),
    ("forward_deployed_engineer", ("forward deployed engineer", "forward-deployed engineer")),
    ("applied_ai", ("ai full stack", "ai engineer", "gtm engineer")),
    ("product_manager", ("product%manager",)),
    ("program_manager", ("program%manager",)),
    ("project_manager", ("project%manager",)),
    ("systems_engineering", ("system%engineer", "systems%engineer", "systems%analyst", "information%system")),
    ("software_engineering", ("software%engineer", "software%developer", "fullstack", "full stack")),
    ("data_science_ml", ("data%scientist", "machine%learning", "ml engineer")),
    ("data_engineering", DATA_ENGINEERS + DATABASES),
    ("data_analytics_bi", ("data%analyst", "business intelligence", "bi analyst")),
    ("business_analyst", ("business%analyst",)),
    ("strategy_operations", ("operations%analyst", "strategy%analyst")),
    ("customer_success", ("customer%success", "technical%account", "relationship%manager")),
)
#: Further families, of the report of the mix of jobs.
MIX_FAMILIES = (
    ("qa_testing", ("quality%assurance", " qa ", "test engineer", "tester")),
    ("cloud_devops", ("devops", "cloud", "site reliability", "sre")),
    ("security", ("security", "cyber")),
    ("implementation_consulting", ("implementation", "consultant", "consulting")),
    ("it_support_admin", ("support", "specialist", "administrator", "admin")),
    ("business_operations", ("operations", "coordinator")),
)
#: The last families by title, and those by canonical role.
LAST_FAMILIES = (("marketing", ("marketing",)), ("sales", ("sales",)))
SUPPORT_FAMILY = (("technical_support", ("technical%support", "technical%specialist", "technical%expert")),)
ROLE_FAMILIES = (
    ("marketing", ("market research",)), ("financial_analyst", ("financial%analyst", "financial and investment")), ("data_analytics_bi", ("statistic",)),
    ("project_manager", ("information technology project manager",)), ("systems_engineering", ("network", "systems administrator")), ("software_engineering", ("software developer",)),
)
#: Tracks, title patterns and role patterns of each stack, in order.
STACKS = (
    ("stack_1_business_product_data", ("product", "analyst/bi"), ("product%manager", "business%analyst", "data%analyst", "strategy%analyst", "operations%analyst", "program%manager", "project%manager", "implementation", "consultant", "consulting", "coordinator"), ("financial%analyst", "financial and investment", "market research")),
    ("stack_2_ai_solutions_systems_data", ("solutions/systems", "applied_ai"), ("systems%analyst", "information%system"), ()),
    ("stack_4_sde", ("software/data",), ("software", "quality%assurance", " qa ", "test engineer", "tester", "devops", "cloud", "site reliability", "sre", "security", "cyber"), ("network", "systems administrator")),
    ("stack_3_customer_success", ("customer_success",), ("customer%success", "technical%account", "relationship%manager", "support", "specialist", "administrator", "admin"), ()),
    ("stack_3_gtm", ("marketing automation",), ("sales", "marketing", "business%development"), ()),
)


def _like(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(or_, (text.like(f"%{p}%") for p in patterns), F.lit(False))


def role_family(title: Column, role: Column, mix: bool = False) -> Column:
    """The family of a target title; ``mix`` takes the finer families of the report of the mix."""
    title, role, low = F.coalesce(title, F.lit("")), F.coalesce(role, F.lit("")), F.lower(F.coalesce(role, F.lit("")))
    ladder = F.when((role == f"{TRACK}software/data") & _like(title, DATA_ENGINEERS), "data_engineering")
    for track, family in TRACK_FAMILIES.items():
        ladder = ladder.when(role == TRACK + track, family)
    for family, patterns in (*FAMILIES, *(MIX_FAMILIES if mix else SUPPORT_FAMILY), *LAST_FAMILIES):
        ladder = ladder.when(_like(title, patterns), family)
    for family, patterns in ROLE_FAMILIES:
        ladder = ladder.when(_like(low, patterns), family)
    return ladder.otherwise(F.concat(F.lit("title:"), F.coalesce(F.nullif(title, F.lit("")), F.nullif(role, F.lit("")), F.lit("unclassified target title"))))


def role_stack(title: Column, role: Column) -> Column:
    """The stack of a target title."""
    title, role, low = F.coalesce(title, F.lit("")), F.coalesce(role, F.lit("")), F.lower(F.coalesce(role, F.lit("")))
    # Within the track of software and data, the data engineers belong to the second stack.
    data = (role == f"{TRACK}software/data") & _like(title, DATA_ENGINEERS + DATABASES)
    ladder = F.when(F.lit(False), "")
    for k, (stack, tracks, titles, roles) in enumerate(STACKS):
        hit = role.isin(*(TRACK + t for t in tracks)) | _like(title, titles) | _like(low, roles)
        ladder = ladder.when(hit | data if k == 1 else hit, stack)
    return ladder.otherwise("stack_5_possible_target")
