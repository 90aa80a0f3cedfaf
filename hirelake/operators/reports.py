"""Reports on filings, postings, sites and runs: filters, one grouping each, and ranks over what is grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hirelake.functions.money import annual_salary
from hirelake.functions.titles import is_executive, is_high_seniority, is_product_role, normalize_soc_code, product_role_category
from hirelake.operators.activity import local_date

TIERS = ("P0", "P1", "P2", "P3")


def _salary() -> Column:
    return annual_salary(F.col("wage_rate_of_pay_from"), F.col("wage_unit_of_pay"))


def quantiles(values: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """Exact interpolated quantiles of each group, from counts of its distinct values.

    Equal values are counted before the shuffle, so a group weighs as many rows as it has distinct values.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.expr(f"percentile({value}, array({', '.join(map(str, shares))}), n)").alias("q"))


def salary_report(filings: DataFrame, by: Column, limits: tuple[int, ...] = (90_000, 150_000)) -> DataFrame:
    """By group: quartiles of the yearly salary, how many reach each limit, and the median of executive titles."""
    rows = filings.select(by.alias("group_key"), _salary().alias("salary"), is_executive(F.col("job_title")).alias("executive")).where("salary IS NOT NULL").withColumn("salary", F.col("salary").cast("double"))
    q = quantiles(rows, ["group_key"], "salary", (0.25, 0.5, 0.75))
    top = quantiles(rows.where("executive"), ["group_key"], "salary", (0.5,)).select("group_key", F.round(F.col("q")[0], 2).alias("executive_median"))
    reached = rows.groupBy("group_key").agg(*(F.count_if(F.col("salary") >= x).alias(f"at_least_{x}") for x in limits))
    wide = q.select("group_key", "n", *(F.round(F.col("q")[k], 2).alias(f"p{p}") for k, p in enumerate((25, 50, 75))))
    return wide.join(reached, "group_key").join(top, "group_key", "left")


def soc_review_summary(filings: DataFrame) -> DataFrame:
    """By occupation code: filings, companies, titles, dates, salaries, and the title that most filings have."""
    rows = filings.select(normalize_soc_code(F.col("soc_code")).alias("normalized_soc_code"), "employer_fein", "job_title", "decision_date", "case_status", _salary().alias("salary"))
    titles = rows.groupBy("normalized_soc_code", "job_title").agg(F.count("*").alias("n"))
    first = titles.groupBy(F.col("normalized_soc_code").alias("first_code")).agg(F.min_by("job_title", F.struct(-F.col("n"), "job_title")).alias("representative_title"), F.count("job_title").alias("raw_title_count"))
    companies = rows.groupBy("normalized_soc_code", "employer_fein").agg(
        F.count("*").alias("n"), F.count_if(F.col("case_status") == "Certified").alias("certified"), F.min("decision_date").alias("first"), F.max("decision_date").alias("last"), F.min("salary").alias("low"), F.max("salary").alias("high")
    )
    sums = companies.groupBy("normalized_soc_code").agg(
        F.sum("n").alias("lca_count"), F.count("employer_fein").alias("company_count"), F.sum("certified").alias("certified_count"), F.min("first").alias("first_decision_date"), F.max("last").alias("last_decision_date"),
        F.min("low").alias("min_yearly_wage"), F.max("high").alias("max_yearly_wage"),
    )
    median = quantiles(rows.withColumn("salary", F.col("salary").cast("double")), ["normalized_soc_code"], "salary", (0.5,)).select(F.col("normalized_soc_code").alias("median_code"), F.round(F.col("q")[0], 2).alias("median_yearly_wage"))
    code = F.col("normalized_soc_code")
    return sums.join(first, code.eqNullSafe(F.col("first_code"))).join(median, code.eqNullSafe(F.col("median_code")), "left").drop("first_code", "median_code")


def role_profile(filings: DataFrame, units: DataFrame, target_soc: DataFrame) -> DataFrame:
    """By unit (consolidation_key, member_feins array), code and raw title: filings, certified ones, dates, salaries, target or not."""
    members = units.select("consolidation_key", F.explode("member_feins").alias("employer_fein"))
    codes = target_soc.where("active").select("normalized_soc_code").distinct().withColumn("is_target", F.lit(True))
    rows = filings.select("employer_fein", "job_title", normalize_soc_code(F.col("soc_code")).alias("normalized_soc_code"), "case_status", "decision_date", _salary().alias("salary"))
    # Counted by employer first: the members' join meets a row for each employer, code and title.
    counted = rows.groupBy("employer_fein", "normalized_soc_code", "job_title").agg(F.count("*").alias("n"), F.count_if(F.col("case_status") == "Certified").alias("c"), F.min("decision_date").alias("a"), F.max("decision_date").alias("b"), F.min("salary").alias("low"), F.max("salary").alias("high"))
    grouped = counted.join(members, "employer_fein").groupBy("consolidation_key", "normalized_soc_code", "job_title").agg(
        F.sum("n").alias("lca_count"), F.sum("c").alias("certified_count"), F.min("a").alias("first_decision_date"), F.max("b").alias("last_decision_date"), F.min("low").alias("min_yearly_wage"), F.max("high").alias("max_yearly_wage")
    )
    return grouped.join(F.broadcast(codes), "normalized_soc_code", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))


def product_titles(filings: DataFrame, places: int = 3) -> DataFrame:
    """The titles of each product category that most filings have, with their companies."""
    rows = filings.select(product_role_category(F.col("job_title")).alias("category"), "job_title", "employer_fein").where("category IS NOT NULL")
    titles = rows.groupBy("category", "job_title", "employer_fein").agg(F.count("*").alias("n")).groupBy("category", "job_title").agg(F.sum("n").alias("lca_count"), F.count("employer_fein").alias("company_count"))
    order = Window.partitionBy("category").orderBy(F.desc("lca_count"), "job_title")
    return titles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= places)



def filings_by_year_and_place(filings: DataFrame) -> DataFrame:
    return filings.groupBy(F.year("received_date").alias("received_year"), "worksite_city", "worksite_state").agg(F.count("*").alias("filings"), F.count_if(F.col("case_status") == "Certified").alias("certified"))


def label_log(changes: DataFrame) -> DataFrame:
    """Label changes by local day, source and status."""
    return changes.groupBy(local_date(F.col("changed_at")).alias("day"), F.coalesce("source", F.lit("unknown")).alias("source"), "classification_status").agg(F.count("*").alias("changes"), F.avg("confidence").alias("avg_confidence"))


def repeat_runs(sites: DataFrame, runs: DataFrame) -> DataFrame:
    """Per site, its runs and successes, the fewest and most jobs of a success, and the last run; sites without runs too."""
    good = F.col("status") == "succeeded"
    counted = runs.groupBy("site_id").agg(F.count("*").alias("runs"), F.count_if(good).alias("successes"), F.min(F.when(good, F.col("parsed_job_count"))).alias("fewest_jobs"), F.max(F.when(good, F.col("parsed_job_count"))).alias("most_jobs"), F.max("started_at").alias("last_run_at"))
    return sites.select("site_id", "source_type").join(counted, "site_id", "left").na.fill(0, ["runs", "successes"])





def rank_in_tier(targets: DataFrame, places: int) -> DataFrame:
    """The first companies of each tier, and how many their tier has."""
    order = Window.partitionBy("priority_tier").orderBy(F.col("priority_score").desc_nulls_last(), "canonical_name", "consolidation_key")
    counts = targets.where("enabled").groupBy("priority_tier").agg(F.count("*").alias("tier_companies"))
    first = targets.where("enabled").withColumn("tier_rank", F.row_number().over(order)).where(F.col("tier_rank") <= places)
    return first.join(F.broadcast(counts), "priority_tier").select("consolidation_key", "priority_tier", "priority_score", "tier_rank", "tier_companies")


def page_of_targets(targets: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the listing by tier, score, name and key."""
    order = ("priority_tier", F.col("priority_score").desc_nulls_last(), "canonical_name", "consolidation_key")
    return targets.where("enabled").orderBy(*order).offset(offset).limit(limit).select("consolidation_key", "canonical_name", "priority_tier", "priority_score")


def company_lookup(companies: DataFrame, text: str) -> DataFrame:
    """Companies whose name holds the text, in any case."""
    return companies.where(F.contains(F.lower("name"), F.lit(text.lower()))).select("fein", "name", "lca_count")


def never_searched(targets: DataFrame, sites: DataFrame, limit: int) -> DataFrame:
    """The first enabled targets without any site, by tier and score."""
    order = ("priority_tier", F.col("priority_score").desc_nulls_last(), "consolidation_key")
    return targets.where("enabled").join(sites.select("consolidation_key"), "consolidation_key", "left_anti").orderBy(*order).limit(limit).select("consolidation_key", "priority_tier", "priority_score")


def scope_readiness(sites: DataFrame) -> DataFrame:
    """Verified sites that may be crawled, by source type: how many are ready for the US, and how many are not."""
    ready = (F.col("target_country_code") == "US") & (F.col("scope_method") != "unknown")
    rows = sites.where((F.col("verification_status") == "verified") & F.col("crawl_enabled"))
    return rows.groupBy("source_type").agg(F.count("*").alias("sites"), F.count_if(ready).alias("us_ready"), F.count_if(~ready).alias("not_ready"))


def review_details(sites: DataFrame) -> DataFrame:
    """Candidates for review beside the number of candidates of their company (counted apart, so no company is sorted)."""
    counts = sites.groupBy("consolidation_key").agg(F.count("*").alias("company_candidates"))
    rows = sites.where(F.col("verification_status") == "unverified").select("site_id", "consolidation_key", "source_type", "candidate_rank")
    return rows.join(counts, "consolidation_key")


def capped_sample(rows: DataFrame, stratum: str, order: list[str], cap: int = 75) -> DataFrame:
    """The first ``cap`` rows of each stratum."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("place") <= cap).drop("place")


def title_examples(postings: DataFrame, places: int = 3) -> DataFrame:
    """The first companies by name of each title, and how many it has."""
    pairs = postings.select("normalized_title", "consolidation_key").distinct()
    order = Window.partitionBy("normalized_title").orderBy("consolidation_key")
    ranked = pairs.withColumn("place", F.row_number().over(order))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= places, F.struct("place", "consolidation_key"))))
    return ranked.groupBy("normalized_title").agg(F.array_join(F.transform(first, lambda x: x["consolidation_key"]), ", ").alias("example_companies"), F.count("*").alias("company_count"))


def action_mix(actions: DataFrame) -> DataFrame:
    """Users' actions by status, with the share of all."""
    counted = actions.groupBy("action_status").agg(F.count("*").alias("jobs"))
    # A handful of states meets in the window.
    return counted.withColumn("pct", F.round(100.0 * F.col("jobs") / F.sum("jobs").over(Window.partitionBy()), 2).cast("double"))


def ranked_appearances(appearances: DataFrame) -> DataFrame:
    """Employers of ranked lists: best rank, appearances, and the lists in order."""
    return appearances.groupBy("employer_name").agg(F.min("rank").alias("best_rank"), F.count("*").alias("appearances"), F.array_join(F.sort_array(F.collect_set("region")), "|").alias("regions"))


def employer_numbers(companies: DataFrame, aliases: DataFrame, text: str) -> DataFrame:
    """The numbers of companies whose name or alias holds the text."""
    low = text.lower()
    return companies.where(F.contains(F.lower("name"), F.lit(low))).select("fein").union(aliases.where(F.contains(F.lower("alias_name"), F.lit(low))).select("fein")).distinct()


def identity_search(units: DataFrame, companies: DataFrame, aliases: DataFrame, search_keys: DataFrame) -> DataFrame:
    """By unit (consolidation_key, canonical_name, member_feins): its search terms in order, each once in any case.

    A term counts by its best source: canonical name, legal names, aliases, then keys; of equal ones the shorter first.
    """
    members = units.select("consolidation_key", F.explode("member_feins").alias("fein"))
    by_member = (
        companies.select("fein", F.col("name").alias("term"), F.lit(2).alias("priority"))
        .unionByName(aliases.select("fein", F.col("alias_name").alias("term"), F.lit(3).alias("priority")))
        .unionByName(search_keys.select("fein", F.col("search_key").alias("term"), F.lit(4).alias("priority")))
    )
    terms = units.select("consolidation_key", F.col("canonical_name").alias("term"), F.lit(1).alias("priority")).unionByName(members.join(by_member, "fein").select("consolidation_key", "term", "priority"))
    best = terms.where("trim(term) <> ''").groupBy("consolidation_key", F.lower("term").alias("low")).agg(F.min(F.struct("priority", F.length("term").alias("size"), "term")).alias("t"))
    listed = F.array_sort(F.collect_list(F.struct("t.priority", "t.size", "t.term")))
    return best.groupBy("consolidation_key").agg(F.array_join(F.transform(listed, lambda x: x["term"]), " | ").alias("search_terms"), F.count("*").alias("terms"))
