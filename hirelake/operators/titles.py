"""Catalog of observed titles, their occupation codes, and the ordered rules that label them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scripts and words that tell a posting of another market; senior titles; the family that senior titles may have.
LANGUAGE = "[ぁ-ゟァ-ヿ가-힣]|日本語|韓国|한국|서울"
SENIOR = r"(^|[^a-z])(senior|sr\.?)([^a-z]|$)"
MANAGERS = "(^|[^a-z])((technical[ -]+)?product manager|product owner|program manager|project manager)([^a-z]|$)"
SENIOR_RULE = "profile_avoid_all_senior_titles"
MAX_RULES = 5000


def title_catalog(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Per title: an example, postings, companies, active postings and status; titles without label are for review."""
    counted = postings.groupBy("normalized_title").agg(F.min("title").alias("example_title"), F.count("*").alias("posting_count"), F.countDistinct("consolidation_key").alias("company_count"), F.count_if("active").alias("active_posting_count"))
    known = labels.select("normalized_title", "classification_status")
    return counted.join(known, "normalized_title", "left").withColumn("classification_status", F.coalesce("classification_status", F.lit("review")))


def soc_resolution(mappings: DataFrame, target_soc: DataFrame) -> DataFrame:
    """Per mapped title, the counts of target and other occupation codes, and the codes in order."""
    targets = target_soc.where("active").select("normalized_soc_code").distinct().withColumn("is_target", F.lit(True))
    pairs = mappings.select(F.lower(F.trim("normalized_job_title")).alias("normalized_title"), "normalized_soc_code").distinct()
    code, target = F.col("normalized_soc_code"), F.col("is_target")
    return (
        pairs.join(targets, "normalized_soc_code", "left")
        .groupBy("normalized_title")
        .agg(F.count(code).alias("matched_soc_count"), F.count(F.when(target, code)).alias("target_soc_count"), F.count(F.when(target.isNull(), code)).alias("non_target_soc_count"), F.array_join(F.sort_array(F.collect_set(code)), ", ").alias("matched_soc_codes"))
    )


def _by_match(only_target: str, only_other: str, mixed: str, unknown: str) -> Column:
    target, other = F.col("target_soc_count"), F.col("non_target_soc_count")
    return F.when(target.isNull(), unknown).when((target > 0) & (other == 0), only_target).when((target == 0) & (other > 0), only_other).otherwise(mixed)


def soc_match_candidates(catalog: DataFrame, resolution: DataFrame) -> DataFrame:
    """The catalog with a status that the codes suggest, and why."""
    reason = _by_match("exact_target_soc_only", "exact_non_target_soc_only", "mixed_soc_conflict", "no_exact_raw_title_match")
    return catalog.join(resolution, "normalized_title", "left").withColumns({"suggested_status": _by_match("target", "non_target", "review", "review"), "suggestion_reason": reason})


def soc_match_coverage(postings: DataFrame, resolution: DataFrame) -> DataFrame:
    """How many titles and active US postings the codes decide."""
    observed = postings.where("active AND market_scope = 'US'").groupBy("normalized_title").agg(F.count("*").alias("n"))
    result = _by_match("auto_target", "auto_non_target", "soc_conflict_review", "no_exact_match").alias("match_result")
    rows = observed.join(resolution, "normalized_title", "left").groupBy(result).agg(F.count("*").alias("distinct_titles"), F.sum("n").alias("active_us_postings"))
    # Four rows at most meet in the window.
    share = F.round(100.0 * F.col("active_us_postings") / F.sum("active_us_postings").over(Window.partitionBy()), 2)
    return rows.withColumn("posting_pct", share.cast("double"))


def decide_titles(titles: DataFrame, rules: DataFrame) -> DataFrame:
    """(normalized_title, classification_status, canonical_role, decision_reason) of each distinct title.

    ``rules`` (rule_type, canonical_role, term, regex_pattern, decision_reason, priority, active) has
    MAX_RULES rows at most. The first rule by priority, longer term and term counts; a rule against a title
    beats one for it. Senior titles of the manager family escape the rule on senior titles, and are targets
    without another rule. A null title is an empty one. Each distinct title is matched once.
    """
    kept = rules.where("active").limit(MAX_RULES + 1).collect()
    if len(kept) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    kept.sort(key=lambda r: (r.priority, -len(r.term), r.term))
    value = F.lower("normalized_title")
    excepted = F.col("excepted")

    def first(kind: str) -> Column:
        found = F.lit(None).cast("struct<role:string,reason:string>")
        for r in reversed([r for r in kept if r.rule_type == kind]):
            hit = value.rlike(r.regex_pattern)
            hit = hit & ~excepted if kind == "non_target" and r.decision_reason == SENIOR_RULE else hit
            found = F.when(hit, F.struct(F.lit(r.canonical_role).cast("string").alias("role"), F.lit(r.decision_reason).alias("reason"))).otherwise(found)
        return found

    distinct = titles.select(F.coalesce("normalized_title", F.lit("")).alias("normalized_title")).distinct()
    judged = distinct.withColumn("excepted", value.rlike(SENIOR) & value.rlike(MANAGERS)).withColumns({"foreign": value.rlike(LANGUAGE), "against": first("non_target"), "for": first("target")})
    fallback = F.when(excepted, F.struct(F.lit("candidate_profile_track: product").alias("role"), F.lit("profile_target_pm_senior_exception").alias("reason")))
    judged = judged.withColumn("for", F.coalesce("for", fallback))
    out = F.col("foreign") | F.col("against").isNotNull()
    return judged.select(
        "normalized_title",
        F.when(out, "non_target").when(F.col("for").isNotNull(), "target").otherwise("review").alias("classification_status"),
        F.when(~out, F.col("for.role")).alias("canonical_role"),
        F.when(F.col("foreign"), "profile_non_us_language_signal").otherwise(F.coalesce("against.reason", "for.reason", F.lit("profile_no_rule_match"))).alias("decision_reason"),
    )


def apply_rules(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labels after the rules, with ``previous_status`` where one changed; labels set by hand stay, undecided ones too."""
    ruled = decisions.where("classification_status <> 'review'").select("normalized_title", F.col("classification_status").alias("ruled"))
    manual = F.coalesce(F.col("rule_version").startswith("manual"), F.lit(False))
    new = F.when(~manual, F.col("ruled"))
    changed = new.isNotNull() & ~new.eqNullSafe(F.col("classification_status"))
    rows = labels.join(ruled, "normalized_title", "left")
    return rows.withColumn("previous_status", F.when(changed, F.col("classification_status"))).withColumn("classification_status", F.coalesce(new, "classification_status")).drop("ruled")
