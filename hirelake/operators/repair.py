"""Repair of filings from an official file, behind guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.money import PERIODS

#: Columns that the official file corrects, with their types.
WAGES = {"wage_rate_of_pay_from": "decimal(14,2)", "wage_unit_of_pay": "string"}


def is_numeric_unit(unit: Column) -> Column:
    """A pay unit that is a number: a row whose columns were shifted."""
    return unit.rlike("^[0-9]+([.][0-9]+)?$")


def affected(filings: DataFrame, first: str, last: str) -> DataFrame:
    return filings.where(F.col("decision_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & is_numeric_unit(F.col("wage_unit_of_pay")))


def guard_counts(filings: DataFrame, stage: DataFrame, first: str, last: str) -> DataFrame:
    """One row: rows of the file, affected filings, those that the file has, and unknown units in the file."""
    rows = affected(filings, first, last)
    keys = stage.select("case_number").distinct()
    unit = F.nullif(F.trim("wage_unit_of_pay"), F.lit(""))
    a = stage.agg(F.count("*").alias("stage_rows"), F.count_if(unit.isNotNull() & ~F.col("wage_unit_of_pay").isin(*PERIODS)).alias("invalid_units"))
    b = rows.join(keys.withColumn("matched", F.lit(True)), "case_number", "left").agg(F.count("*").alias("affected_rows"), F.count("matched").alias("matched_rows"))
    return a.crossJoin(b)


def repair_backup(filings: DataFrame, stage: DataFrame, first: str, last: str) -> DataFrame:
    """Old and new wages of each affected filing that the file has; blank texts of the file are null."""
    new = stage.select("case_number", *(F.nullif(F.trim(c), F.lit("")).try_cast(t).alias(f"new_{c}") for c, t in WAGES.items()))
    rows = affected(filings, first, last).select("lca_case_id", "case_number", *(F.col(c).alias(f"old_{c}") for c in WAGES))
    return rows.join(new, "case_number")


def repair_wages(filings: DataFrame, stage: DataFrame, first: str, last: str, expected: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(filings, backup) after the repair; raises when a guard fails or a numeric unit would stay.

    ``expected`` names counts of ``guard_counts`` that must hold; every affected filing must be in the file.
    """
    counts = guard_counts(filings, stage, first, last).first().asDict()
    wrong = {k: (counts[k], v) for k, v in (expected or {}).items() if counts[k] != v}
    if wrong or counts["matched_rows"] != counts["affected_rows"] or counts["invalid_units"]:
        raise ValueError(f"the wage repair doesn't fit: {counts}, expected {expected}")
    backup = repair_backup(filings, stage, first, last)
    rows = filings.join(backup.select("lca_case_id", *(f"new_{c}" for c in WAGES), F.lit(True).alias("hit")), "lca_case_id", "left")
    fixed = rows.select(*(F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in WAGES else F.col(c) for c in filings.columns))
    if not affected(fixed, first, last).isEmpty():
        raise ValueError("numeric pay units remain after the repair")
    return fixed, backup


def rescored_units(fixed: DataFrame, backup: DataFrame, members: DataFrame, salary: Column) -> DataFrame:
    """The least yearly salary of each unit that the repair touches (members: consolidation_key, fein)."""
    touched = fixed.join(backup.select("lca_case_id"), "lca_case_id", "left_semi").select(F.col("employer_fein").alias("fein")).distinct()
    units = members.join(touched, "fein", "left_semi").select("consolidation_key").distinct()
    rows = members.join(units, "consolidation_key", "left_semi").join(fixed.withColumnRenamed("employer_fein", "fein"), "fein")
    return rows.groupBy("consolidation_key").agg(F.min(salary).alias("least_annual_salary"))
