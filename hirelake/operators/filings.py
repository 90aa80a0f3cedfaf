"""Statistics of filings by employer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.money import annual_salary
from hirelake.functions.titles import is_executive, is_product_manager, is_product_role, normalize_soc_code
from hirelake.sources.shared import kept


def employer_filing_stats(filings: DataFrame, target_soc: DataFrame) -> DataFrame:
    """One row for each employer number, from one scan: every aggregate combines before the shuffle.

    The grouped rows are written once to the shared folder; the data set's last date is theirs, so filings
    without a number count for it, too. target_soc (normalized_soc_code, active) is a dimension; Spark broadcasts it while it is small.
    """
    soc = target_soc.where("active").select(F.col("normalized_soc_code").alias("target_code")).distinct()
    title, when = F.col("job_title"), F.col("decision_date")
    rows = filings.select(
        F.col("employer_fein").alias("fein"), when, is_executive(title).alias("executive"), is_product_role(title).alias("product"), is_product_manager(title).alias("manager"),
        annual_salary(F.col("wage_rate_of_pay_from"), F.col("wage_unit_of_pay")).alias("salary"), normalize_soc_code(F.col("soc_code")).alias("code"),
    )
    rows = rows.join(soc, rows.code == soc.target_code, "left")
    target, paid = F.col("target_code").isNotNull(), F.col("salary").isNotNull()
    stats = rows.groupBy("fein").agg(
        F.count("*").alias("lca_case_count"), F.count_if("executive").alias("executive_level_lca_count"), F.count("target_code").alias("target_role_lca_count"),
        F.min(F.when(target, F.col("salary"))).alias("target_role_min_annual_salary"), F.count_if(target & paid).alias("target_role_valid_salary_lca_count"),
        F.count_if(target & ~paid).alias("target_role_invalid_salary_lca_count"), F.coalesce(F.bool_or("product"), F.lit(False)).alias("has_product_role_job"),
        F.coalesce(F.bool_or("manager"), F.lit(False)).alias("has_product_manager_job"), F.count_if("product").alias("product_role_lca_count"), F.max("decision_date").alias("last_decision_date"),
    )
    stats = kept(stats, "filing-stats")
    newest = stats.agg(F.max("last_decision_date").alias("dataset_max_decision_date"))
    return stats.where("fein IS NOT NULL").crossJoin(F.broadcast(newest))


def salary_percentiles(filings: DataFrame, by: Column) -> DataFrame:
    """Exact interpolated quartiles of the yearly salary in each group."""
    salary = annual_salary(F.col("wage_rate_of_pay_from"), F.col("wage_unit_of_pay")).cast("double")
    rows = filings.select(by.alias("group_key"), salary.alias("salary")).where("salary IS NOT NULL")
    # Equal salaries are counted before the shuffle: a group weighs as many rows as it has distinct salaries.
    counted = rows.groupBy("group_key", "salary").agg(F.count("*").alias("times"))
    q = counted.groupBy("group_key").agg(F.sum("times").alias("n"), F.expr("percentile(salary, array(0.25, 0.5, 0.75), times)").alias("q"))
    # Half a cent goes up, whatever the last bit of the double.
    return q.select("group_key", "n", *(F.round(F.col("q")[k] + 1e-7, 2).alias(f"p{p}") for k, p in enumerate((25, 50, 75))))
