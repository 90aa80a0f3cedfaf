"""The driver's tables seen as the library's: the same projections as DataFrames and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TITLES = (
    "Software Engineer", "Senior Product Manager", "Product Manager", "Technical Program Manager", "Program Manager", "Project Manager", "Data Analyst", "Business Analyst",
    "Systems Engineer", "Solutions Architect", "Scrum Master", "Chief Executive Officer", "Vice President", "General Manager", "C++ Software Engineer", "Marketing Specialist",
    "Customer Success Manager", "Warehouse Associate", "Delivery Driver", "Registered Nurse", "Data Engineer Intern", "Senior Data Engineer", "Sales Engineer", "Technology Consultant",
)
SOCS = ("15-1252", "15-1252.00", "15-1299.08", "15-2051", "13-1111.00", "11-2021", "11-1011", "29-1141.00", "41-9031", "15-1211.1", "bad-code", None)
UNITS = ("Year", "Month", "Bi-Weekly", "Week", "Hour", "105997", None)
LOCATIONS = ("Chicago, IL", "Remote - United States", "Toronto, Canada", "London", "US-TX-Austin", "Berlin, Germany", "Austin / TX", "", "Remote", "New York, New York")
SOURCES = ("greenhouse", "workday", "lever", "ashby", "smartrecruiters", "oracle_cloud", "icims", "generic_html")
ERRORS = ("HTTP Error 404", "HTTP 429 rate", "timed out", "403 Forbidden", "empty title", "Workday 422", "", "boom")
TARGET_SOC = ("15125200", "15129908", "15205100", "13111100", "11202100")
AS_OF = "2024-02-01 00:00:00"
SPLIT = "2024-01-20 00:00:00"


def pick(values: tuple, index: str) -> str:
    """A CASE expression that both engines read: the value at the index modulo the number of values."""
    cases = " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {cases} END"


FILINGS = f"""
SELECT lpad(CAST(o.o_custkey AS varchar(20)), 9, '0') AS employer_fein, {pick(TITLES, 'l.l_partkey')} AS job_title, {pick(SOCS, 'l.l_partkey')} AS soc_code,
       CAST(l.l_extendedprice AS decimal(14,2)) AS wage_rate_of_pay_from, {pick(UNITS, 'l.l_linenumber - 1')} AS wage_unit_of_pay, CAST(l.l_shipdate AS date) AS decision_date
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""
SITES = f"SELECT page_id AS site_id, url, {pick(SOURCES, 'page_id')} AS source_type, {pick(ERRORS, 'page_id')} AS last_error FROM pages"
RUNS = """
SELECT event_id AS run_id, user_id % 20 AS site_id, CASE WHEN event_id % 97 = 0 THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
       ts AS started_at, event_id % 50 AS parsed_job_count FROM events"""
SEEN = f"""
SELECT user_id % 20 AS site_id, concat(event_type, '-', regexp_extract(props, '([0-9]+)', 1)) AS external_job_id, {pick(TITLES, 'event_id')} AS title, {pick(LOCATIONS, 'event_id')} AS location,
       value < 30 AS active, ts, event_id, row_number() OVER (PARTITION BY user_id % 20, concat(event_type, '-', regexp_extract(props, '([0-9]+)', 1)) ORDER BY ts DESC, event_id DESC) AS latest
FROM events WHERE ts {{}} TIMESTAMP '{SPLIT}'"""
#: The same over the whole table.
SEEN_EVER = SEEN.split(" WHERE ts ")[0]


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The projection over the Parquet tables that it names."""
    named = re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", r"\1 {\2}", sql)
    return spark.sql(named, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
