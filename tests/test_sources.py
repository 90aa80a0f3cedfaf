import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from hirelake.operators.cascades import fail_stale, refresh_run_counts, resolve_failed_sites
from hirelake.sources.shared import Scope
from hirelake.sources.tables import delete_keys, export_csv, fitting_rows, malformed_rows, overwrite_partitions, read_csv, read_table

SCHEMA = StructType([StructField("k", IntegerType()), StructField("name", StringType()), StructField("x", DoubleType())])


def test_csv_comes_back_in_order(spark, tmp_path):
    rows = [(k, f'a, "{k}"\nline' if k % 3 else "", k / 4) for k in range(500)] + [(None, None, None)]
    export_csv(spark.createDataFrame(rows, SCHEMA).repartition(7), str(tmp_path / "out"), [F.desc("x"), "k"])
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert all(p.read_text().startswith("k,name,x\n") for p in parts)
    plain = [(k, f"n{k}", k / 4) for k in range(500)]
    export_csv(spark.createDataFrame(plain, SCHEMA).repartition(7), str(tmp_path / "plain"), [F.desc("x"), "k"])
    lines = [x for p in sorted((tmp_path / "plain").glob("part-*")) for x in p.read_text().splitlines()[1:]]
    assert lines == [f"{k},n{k},{k / 4}" for k in range(499, -1, -1)]
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "plain"), SCHEMA).collect())) == plain


def test_malformed_rows_are_set_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,name,x\n1,a,0.5\nbad,b,1\n2,c\n3,,2.5\n")
    assert sorted(map(tuple, fitting_rows(spark, str(tmp_path / "a.csv"), SCHEMA).collect())) == [(1, "a", 0.5), (3, None, 2.5)]
    assert sorted(r.line for r in malformed_rows(spark, str(tmp_path / "a.csv"), SCHEMA).collect()) == ["2,c", "bad,b,1"]


def test_only_given_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "v int, p string"), path, ["p"])
    overwrite_partitions(spark.createDataFrame([(9, "b"), (7, "c")], "v int, p string"), path, ["p"])
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [(1, "a"), (3, None), (7, "c"), (9, "b")]
    assert sorted(r.v for r in delete_keys(spark.read.parquet(path), spark.createDataFrame([(9,), (9,), (100,)], "v int"), ["v"]).collect()) == [1, 3, 7]


def test_tables_by_name_and_path(spark, tmp_path):
    spark.range(3).write.mode("overwrite").saveAsTable("some_numbers")
    spark.range(4).write.parquet(str(tmp_path / "p"))
    assert read_table(spark, "some_numbers").count() == 3 and read_table(spark, str(tmp_path / "p")).count() == 4
    spark.sql("DROP TABLE some_numbers")


def test_a_scope_deletes_what_it_kept(spark):
    with Scope(spark) as scope:
        df = scope.keep(spark.range(5), "five")
        assert df.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist|FileNotFound"):
        spark.read.parquet(df.inputFiles()[0] if df.inputFiles() else "/none").count()


def test_a_stale_run_fails_its_batch_and_site_once(spark):
    sql = spark.sql
    runs = sql("SELECT * FROM VALUES (1, 1, 1, 'running', TIMESTAMP '2024-01-01 00:00:00'), (2, 1, 1, 'running', TIMESTAMP '2024-01-01 00:30:00'), (3, 2, 2, 'running', TIMESTAMP '2024-01-01 02:00:00'), (4, 3, 3, 'running', NULL) AS t(run_id, batch_id, site_id, status, started_at)").selectExpr("*", "CAST(NULL AS timestamp) AS finished_at", "CAST(NULL AS string) AS error_code")
    batches = sql("SELECT id AS batch_id, 'running' AS status, CAST(0 AS int) AS failed_target_count, CAST(NULL AS timestamp) AS finished_at FROM range(1, 4)")
    sites = sql("SELECT id AS site_id, 'ok' AS crawl_status, 0 AS consecutive_failures, '' AS last_error, CAST(NULL AS timestamp) AS next_crawl_at FROM range(1, 4)")
    targets = sql("SELECT id AS batch_id, id AS site_id, 'open' AS status FROM range(1, 4)")
    out = fail_stale(runs, targets, batches, sites, "2024-01-01 02:30:00")
    assert sorted((r.run_id, r.status, r.error_code) for r in out["runs"].collect()) == [(1, "failed", "stale_timeout"), (2, "failed", "stale_timeout"), (3, "running", None), (4, "running", None)]
    assert sorted((r.batch_id, r.status, r.failed_target_count) for r in out["batches"].collect()) == [(1, "failed", 1), (2, "running", 0), (3, "running", 0)]
    assert sorted((r.site_id, r.consecutive_failures, str(r.next_crawl_at)) for r in out["sites"].collect()) == [(1, 1, "2024-01-01 08:30:00"), (2, 0, "None"), (3, 0, "None")]
    assert sorted((r.site_id, r.status) for r in out["batch_targets"].collect()) == [(1, "failed"), (2, "open"), (3, "open")]


def test_failed_sites_are_resolved_with_their_company(spark):
    site = lambda k, key, error, fails=0, state="verified", crawl="failed": (k, key, state, True, crawl, fails, error, None, "ann")
    rows = [site(1, "a", "HTTP 404", 2), site(2, "b", "HTTP 404", 2), site(3, "b", "x", crawl="succeeded"), site(4, "c", "HTTP 404", 9), site(5, "a2", "HTTP 404", 1), site(6, "a2", "Timed OUT"), site(7, "off", "HTTP 404", 2), site(8, "a2", None), site(9, "a", "403", state="unverified")]
    sites = spark.createDataFrame(rows, "site_id int, consolidation_key string, verification_status string, crawl_enabled boolean, crawl_status string, consecutive_failures int, last_error string, next_crawl_at timestamp, reviewed_by string")
    targets = spark.createDataFrame([("a", "P1", True), ("b", "P1", True), ("c", "P2", True), ("a2", "P1", True), ("off", "P1", False)], "consolidation_key string, priority_tier string, enabled boolean").selectExpr("*", "'found' AS discovery_status", "TIMESTAMP '2024-01-01' AS next_discovery_at")
    out = resolve_failed_sites(sites, targets, "2024-02-01")
    found = {r.site_id: (r.verification_status, r.crawl_enabled, r.crawl_status, str(r.next_crawl_at)[:10]) for r in out["sites"].collect()}
    assert found[1] == found[2] == ("rejected", False, "paused", "None") and found[4] == found[5] == ("unverified", False, "pending", "None")
    assert found[6] == ("verified", True, "pending", "2024-02-01") and found[7][0] == "verified" and found[8][2] == "failed" and found[9][2] == "failed"
    assert {r.consolidation_key: (r.discovery_status, r.next_discovery_at is None) for r in out["targets"].collect()} == {"a": ("review_pending", True), "b": ("found", False), "c": ("found", False), "a2": ("found", False), "off": ("found", False)}


def test_recent_runs_are_counted_anew(spark):
    runs = spark.sql("SELECT * FROM VALUES (1, 1, 'succeeded', TIMESTAMP '2024-01-01 10:00:00'), (2, 1, 'succeeded', TIMESTAMP '2024-01-01 11:00:00'), (3, 2, 'failed', TIMESTAMP '2024-01-01 11:00:00'), (4, 3, 'succeeded', TIMESTAMP '2023-12-01') AS t(run_id, batch_id, status, finished_at)").selectExpr("*", "9L AS target_job_count", "8L AS review_job_count")
    batches = spark.sql("SELECT id AS batch_id, 0L AS target_job_count, 0L AS review_job_count FROM range(1, 4)")
    seen = spark.createDataFrame([(1, "a", True, "US"), (1, "b", True, "US"), (1, "b", False, "US"), (1, "b", True, "UK"), (3, "a", True, "US"), (4, "a", True, "US"), (1, "none", True, "US")], "last_run_id int, normalized_title string, active boolean, market_scope string")
    labels = spark.createDataFrame([("a", "target"), ("b", "review")], "normalized_title string, classification_status string")
    out = refresh_run_counts(runs, batches, seen, labels, "2024-01-01 12:00:00")
    assert {r.run_id: (r.target_job_count, r.review_job_count) for r in out["runs"].collect()} == {1: (1, 1), 2: (9, 8), 3: (9, 8), 4: (9, 8)}
    assert {r.batch_id: (r.target_job_count, r.review_job_count) for r in out["batches"].collect()} == {1: (9, 8), 2: (0, 0), 3: (0, 0)}
