"""Column functions on wages, places and retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pay periods in a year.
PERIODS = {"Year": 1, "Month": 12, "Bi-Weekly": 26, "Week": 52, "Hour": 2080}
#: Cities of the Chicago area.
CHICAGO = (
    "arlington heights", "aurora", "bolingbrook", "chicago", "des plaines", "downers grove", "evanston", "glenview", "hoffman estates", "joliet",
    "mount prospect", "naperville", "oak brook", "orland park", "palatine", "schaumburg", "skokie", "tinley park", "wheaton",
)


def annual_salary(rate: Column, unit: Column) -> Column:
    """A decimal rate over a year; null for other units, compared with case."""
    times = F.create_map(*(F.lit(x) for pair in PERIODS.items() for x in pair))
    return (rate * F.when(unit.isin(*PERIODS), times[unit])).cast("decimal(14,2)")


def is_chicago_area(city: Column, state: Column) -> Column:
    return F.coalesce((F.upper(F.trim(state)) == "IL") & F.lower(F.trim(city)).isin(*CHICAGO), F.lit(False))


def retry_after_failure(at: Column, failures: Column) -> Column:
    """2 to the failures before this one, in hours, from 1 to 24."""
    hours = F.least(F.lit(24.0), F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.coalesce(failures, F.lit(0))))).cast("int")
    return at + F.make_dt_interval(F.lit(0), hours)


def next_crawl(at: Column, succeeded: Column, failures: Column, tier: Column, intervals: dict[str, int], default: int = 168) -> Column:
    """After a success the interval of the tier, after a failure the wait of its failures in a row."""
    hours = F.coalesce(*(F.when(tier == t, F.lit(h)) for t, h in intervals.items()), F.lit(default))
    return F.when(succeeded, at + F.make_dt_interval(F.lit(0), hours)).otherwise(retry_after_failure(at, failures))
