import datetime
import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hirelake.functions.market import market_scope
from hirelake.functions.money import annual_salary, is_chicago_area
from hirelake.functions.titles import employer_match_key, is_executive, normalize_soc_code, product_role_category
from hirelake.operators.postings import apply_snapshot
from hirelake.plans import cascades, catalog, companies, jobs, names, reports, status, streams, titles
from hirelake.sources.tables import merge_upsert

PLANS = (catalog, companies, titles, reports, jobs, streams, status, names, cascades)
#: Without rows on tables this small; tests of their own have literal cases.
EMPTY = ("component_patterns", "component_patterns_of_two", "pilot_sites")
QUERIES, ORACLES = ({k: v for plan in PLANS for k, v in getattr(plan, name).items()} for name in ("QUERIES", "ORACLES"))
BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    fix = lambda v: float(v) if isinstance(v, decimal.Decimal) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    got = QUERIES[name](spark, BASE)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want) and (want or name in EMPTY)


def values(spark, kinds, rows, expr):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {kinds}").orderBy("k").select(expr).collect()]


def test_functions(spark):
    one = lambda f, xs: values(spark, "x string", [(x,) for x in xs], f(F.col("x")))
    assert one(normalize_soc_code, ["15-1252", "15-1252.00", " 15-1299.8", "151252", None]) == ["15125200", "15125200", "15129908", None, None]
    assert one(product_role_category, ["Program Manager", "Technical Program Manager", "IT Project Manager", "Senior Product Manager", "Product Program Manager"]) == [None, "technical_program_manager", "project_manager", "product_manager", None]
    assert one(is_executive, ["Chief Financial Officer", "Chief of Staff", "Vice President, Sales", "Presidential Scholar", None]) == [True, False, True, False, False]
    assert one(employer_match_key, ["AT&T Inc.", "Amazon.com Services LLC"]) == ["at-and-t-inc", "amazon-com-services-llc"]
    places = ["Remote - United States", "Chicago, IL", "Austin / TX", "New York, New York", "Toronto, Canada", "London, United Kingdom", "Remote", "London", "", None]
    assert one(market_scope, places) == ["US"] * 4 + ["non-US"] * 2 + ["unknown"] * 4
    paid = values(spark, "r decimal(14,2), u string", [(decimal.Decimal(100), "Hour"), (decimal.Decimal(4000), "Bi-Weekly"), (decimal.Decimal(1), "year"), (None, "Year"), (decimal.Decimal(5), "105997"), (decimal.Decimal(5), None)], annual_salary(F.col("r"), F.col("u")))
    assert paid == [208000, 104000, None, None, None, None]
    assert values(spark, "c string, s string", [(" naperville ", "il"), ("Chicago", "IN"), (None, "IL")], is_chicago_area(F.col("c"), F.col("s"))) == [True, False, False]


def test_a_snapshot_applied_again_changes_nothing(spark):
    kinds = "site_id int, external_job_id string, title string, market_scope string"
    history = spark.sql("SELECT 1 AS site_id, 'a' AS external_job_id, 't' AS title, 'US' AS market_scope, true AS active, TIMESTAMP '2024-01-01' AS first_seen_at, TIMESTAMP '2024-01-01' AS last_seen_at, CAST(NULL AS timestamp) AS closed_at UNION ALL SELECT 1, 'x', 't', 'non-US', true, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01', NULL")
    stage = spark.createDataFrame([(1, "b", "u", "US"), (1, "c", "u", "unknown")], kinds)
    once = apply_snapshot(history, stage, "2024-02-01")
    assert {r.external_job_id: r.change for r in once.collect()} == {"a": "closed", "b": "new", "x": "kept"}
    again = apply_snapshot(once.drop("change"), stage, "2024-02-02")
    assert {r.external_job_id: r.change for r in again.collect()} == {"a": "kept", "b": "updated", "x": "kept"}
    empty = apply_snapshot(again.drop("change"), stage.limit(0), "2024-02-03", crawled=stage.select("site_id"))
    assert {r.external_job_id: r.change for r in empty.collect()} == {"a": "kept", "b": "closed", "x": "kept"}


def test_upserts_follow_their_policy(spark):
    base = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], "k int, n int, s string")
    rows = spark.createDataFrame([(2, 3, None), (3, 9, "c")], "k int, n int, s string")
    assert sorted(map(tuple, merge_upsert(base, rows, ["k"], {"n": "least", "s": "coalesce"}).collect())) == [(1, 5, "a"), (2, 3, "b"), (3, 9, "c")]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
