"""Companies matched to ranked employers, and the groups that the matches make."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.titles import employer_match_key


def name_is_denied(name: Column, patterns: Sequence[str]) -> Column:
    """Whether the name contains one of the patterns, whatever their case; a null name contains none."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return reduce(or_, (low.contains(p.lower()) for p in patterns), F.lit(False))


def hyphen_prefixes(key: Column) -> Column:
    """The key and each of its beginnings that end before a hyphen."""
    parts = F.split(key, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))


def _allowed(name: Column, pattern: Column) -> Column:
    return F.coalesce(F.regexp_like(name, F.concat(F.lit("(?i)"), pattern)), F.lit(False))


def match_top_employers(terms: DataFrame, companies: DataFrame, aliases: DataFrame, search_keys: DataFrame, policies: DataFrame, excludes: DataFrame) -> DataFrame:
    """(fein, employer_key, company_name, match_source, match_key, linkedin_name), each once.

    A term fits a key that equals it or, for prefix terms, goes on after it with a hyphen. Keys are
    exploded into their prefixes, so that this is an equality join at any number of terms. Excluded
    employers and those of policy ``skip`` match nothing; under ``merge_strict`` the name must fit too.
    """
    usable = terms.join(excludes.select("employer_key"), "employer_key", "left_anti").join(policies.select("employer_key", "policy", "name_allow_regex"), "employer_key", "left")
    usable = usable.where("policy IS NULL OR policy <> 'skip'")
    keys = (
        search_keys.select("fein", F.col("search_key").alias("key"), F.lit("search_key").alias("match_source"))
        .unionByName(aliases.select("fein", employer_match_key(F.col("alias_name")).alias("key"), F.lit("company_alias").alias("match_source")))
        .unionByName(companies.select("fein", employer_match_key(F.col("name")).alias("key"), F.lit("company_name").alias("match_source")))
    )
    hits = keys.withColumn("match_key", F.explode(hyphen_prefixes(F.col("key")))).join(usable, "match_key").where("match_kind = 'prefix' OR match_key = key")
    named = hits.join(companies.select("fein", F.col("name").alias("company_name")), "fein")
    strict = F.coalesce(F.col("policy") == "merge_strict", F.lit(False))
    sure = named.where(~strict | _allowed(F.col("company_name"), F.col("name_allow_regex")))
    return sure.select("fein", "employer_key", "company_name", "match_source", "match_key", "linkedin_name").distinct()


def build_consolidation(matches: DataFrame, companies: DataFrame, policies: DataFrame, denies: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(groups, members): the matched companies of each employer, where they are as many as its policy asks."""
    wanted = policies.where("policy IN ('merge_all', 'merge_strict')").withColumnRenamed("linkedin_name", "canonical_name")
    found = matches.select("employer_key", "fein").distinct().join(companies.select("fein", F.col("name").alias("company_name"), "lca_count"), "fein").join(wanted, "employer_key")
    found = found.where(~name_is_denied(F.col("company_name"), denies) & ((F.col("policy") == "merge_all") | _allowed(F.col("company_name"), F.col("name_allow_regex"))))
    groups = (
        found.groupBy(F.col("employer_key").alias("group_id"), "canonical_name", "policy")
        .agg(F.count("*").alias("member_fein_count"), F.min("min_feins").alias("least"))
        .where("member_fein_count >= least")
        .select("group_id", "canonical_name", F.col("group_id").alias("linkedin_employer_key"), "policy", "member_fein_count")
    )
    members = found.select(F.col("employer_key").alias("group_id"), "fein", "company_name", "lca_count").join(groups.select("group_id"), "group_id", "left_semi")
    return groups, members
