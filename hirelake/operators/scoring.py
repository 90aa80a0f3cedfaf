"""Priority scores of companies and of consolidated units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.money import is_chicago_area


def _points(condition: Column, points: str) -> Column:
    return F.when(condition, F.lit(points).cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)"))


def _percent(part: Column, whole: Column) -> Column:
    """Rounded half up on decimals; null where the whole is zero."""
    share = F.try_divide(part.cast("decimal(12,0)") * F.lit(100).cast("decimal(3,0)"), whole.cast("decimal(12,0)"))
    return F.round(share, 2).cast("double")


def _window(stats: DataFrame) -> DataFrame:
    """One row: the date of the newest filing."""
    return stats.agg(F.coalesce(F.max("dataset_max_decision_date"), F.max("last_decision_date")).alias("newest"))


def _recent() -> Column:
    return F.coalesce(F.col("last_decision_date") >= F.date_sub("newest", 365), F.lit(False))


def _total(rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
    rows = rows.withColumns(scores)
    return rows.withColumn("priority_score", sum((F.col(s) for s in scores), F.lit(0)).cast("decimal(4,2)"))


def score_companies(companies: DataFrame, stats: DataFrame, matches: DataFrame) -> DataFrame:
    """Companies with their filing statistics and six scores; the employer score needs no target role."""
    matched = matches.select("fein").distinct().withColumn("matched", F.lit(True))
    rows = companies.join(stats, "fein", "left").join(matched, "fein", "left").crossJoin(F.broadcast(_window(stats)))
    for name in ("target_role_lca_count", "product_role_lca_count"):
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0)))
    target = F.col("target_role_lca_count") > 0
    rows = _total(rows, {
        "target_role_score": _points(target, "1"),
        "lca_count_score": _points(target & (F.col("lca_count") > 1), "1"),
        "chicago_score": _points(target & is_chicago_area(F.col("city"), F.col("state")), "0.5"),
        "product_role_score": _points(target & F.col("has_product_role_job"), "1"),
        "product_manager_score": _points(target & F.col("has_product_manager_job"), "0.25"),
        "linkedin_top_employer_score": _points(F.col("matched").isNotNull(), "1"),
    })
    return rows.select(
        "fein", F.col("name").alias("company_name"), F.col("city").alias("employer_city"), F.col("state").alias("employer_state"), "lca_count", "certified_count",
        (F.col("lca_count") == 1).alias("single_lca_company"), "target_role_lca_count", "last_decision_date", _recent().alias("recent_lca"), "target_role_score", "lca_count_score",
        "chicago_score", "product_role_score", "product_manager_score", "linkedin_top_employer_score", "product_role_lca_count",
        _percent(F.col("product_role_lca_count"), F.col("lca_count")).alias("product_role_lca_pct"), "priority_score",
    )


def consolidation_units(companies: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each member of each group, and one for each company in no group."""
    merged = members.select("group_id", "fein").join(groups, "group_id").select(F.col("group_id").alias("consolidation_key"), "canonical_name", F.lit(True).alias("is_merged_group"), "linkedin_employer_key", "fein")
    alone = companies.join(members.select("fein"), "fein", "left_anti")
    return merged.unionByName(alone.select(F.col("fein").alias("consolidation_key"), F.col("name").alias("canonical_name"), F.lit(False).alias("is_merged_group"), F.lit(None).cast("string").alias("linkedin_employer_key"), "fein"))


def score_consolidated(companies: DataFrame, stats: DataFrame, groups: DataFrame, members: DataFrame, matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """Units with seven scores and their tier. Companies and statistics join once, and one aggregate follows.

    Units of one or two filings that are all executive have no score and no tier, whatever the override.
    The first member is that of most filings, then by name and number.
    """
    matched = matches.select("fein").distinct().withColumn("matched", F.lit(True))
    facts = companies.join(stats, "fein", "left").join(matched, "fein", "left")
    rows = consolidation_units(companies, groups, members).join(facts, "fein")
    first = F.min_by(F.struct("fein", "city", "state"), F.struct(-F.col("lca_count"), F.col("name"), F.col("fein")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    units = rows.groupBy("consolidation_key").agg(
        F.min("canonical_name").alias("canonical_name"), F.bool_or("is_merged_group").alias("is_merged_group"), F.min("linkedin_employer_key").alias("linkedin_employer_key"),
        F.sort_array(F.collect_set("fein")).alias("member_feins"), first.alias("first"), F.sum("lca_count").alias("lca_count"), F.sum("certified_count").alias("certified_count"),
        total("lca_case_count").alias("filing_lca_case_count"), total("executive_level_lca_count").alias("executive_level_lca_count"), total("target_role_lca_count").alias("target_role_lca_count"),
        F.min("target_role_min_annual_salary").alias("target_role_min_annual_salary"), some("has_product_role_job").alias("has_product_role_job"), some("has_product_manager_job").alias("has_product_manager_job"),
        total("product_role_lca_count").alias("product_role_lca_count"), F.max("last_decision_date").alias("last_decision_date"),
        some(is_chicago_area(F.col("city"), F.col("state"))).alias("has_chicago_member"), F.coalesce(F.bool_or("matched"), F.lit(False)).alias("has_match"),
    ).crossJoin(F.broadcast(_window(stats)))
    cases = F.col("filing_lca_case_count")
    units = units.withColumn("executive_only_excluded", cases.between(1, 2) & (F.col("executive_level_lca_count") == cases))
    target = ~F.col("executive_only_excluded") & (F.col("target_role_lca_count") > 0)
    units = _total(units, {
        "target_role_score": _points(target, "1"),
        "lca_count_score": _points(target & (F.col("lca_count") > 1), "1"),
        "chicago_score": _points(target & F.col("has_chicago_member"), "0.5"),
        "product_role_score": _points(target & F.col("has_product_role_job"), "1"),
        "product_manager_score": _points(target & F.col("has_product_manager_job"), "0.25"),
        "salary_score": _points(target & (F.col("target_role_min_annual_salary") >= 90000), "1"),
        "linkedin_top_employer_score": _points(target & (F.col("has_match") | F.col("linkedin_employer_key").isNotNull()), "1"),
    })
    score = F.col("priority_score")
    computed = F.when(F.col("executive_only_excluded"), None).when(score > 3, "P1").when(score.isin(3, 2.5), "P2").when(score > 1, "P3")
    units = units.withColumn("computed_crawl_priority_tier", computed).join(overrides.where("active").select("consolidation_key", "override_tier"), "consolidation_key", "left")
    tier = F.when(~F.col("executive_only_excluded"), F.coalesce("override_tier", "computed_crawl_priority_tier"))
    return units.select(
        "consolidation_key", "canonical_name", "is_merged_group", "linkedin_employer_key", F.size("member_feins").cast("long").alias("member_fein_count"), F.array_join("member_feins", ",").alias("member_feins"),
        F.col("first.fein").alias("primary_fein"), F.col("first.city").alias("employer_city"), F.col("first.state").alias("employer_state"), "executive_only_excluded", "lca_count", "certified_count",
        "target_role_lca_count", "target_role_min_annual_salary", "product_role_lca_count", _percent(F.col("product_role_lca_count"), F.col("lca_count")).alias("product_role_lca_pct"), "last_decision_date",
        _recent().alias("recent_lca"), "target_role_score", "lca_count_score", "chicago_score", "product_role_score", "product_manager_score", "salary_score", "linkedin_top_employer_score",
        "priority_score", "computed_crawl_priority_tier", tier.alias("crawl_priority_tier"),
    )
