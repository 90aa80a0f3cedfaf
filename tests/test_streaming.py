from hirelake.streaming.jobs import crawl_backoff, drain, snapshot_versions, stale_runs

RUNS = "run_id long, site_id long, status string, started_at timestamp"


def written(spark, tmp_path, batches, kinds):
    """A stream that reads each list of rows as a batch of its own."""
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, kinds.replace("timestamp", "string"))
        frame.selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in kinds.split(", "))).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/k={k}"))
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_backoff_goes_on_from_batch_to_batch(spark, tmp_path):
    rows = [[(1, 1, "failed", "2024-01-01 00:00:00"), (2, 1, "failed", "2024-01-01 01:00:00")], [(3, 1, "failed", "2024-01-01 03:00:00")], [(4, 1, "succeeded", "2024-01-01 07:00:00"), (5, 1, "running", "2024-01-02")]]
    found = [(r.consecutive_failures, str(r.next_crawl_at)) for r in drain(crawl_backoff(written(spark, tmp_path, rows, RUNS)), "update").orderBy("batch").collect()]
    assert found == [(2, "2024-01-01 03:00:00"), (3, "2024-01-01 07:00:00"), (0, "2024-01-08 07:00:00")]


def test_only_open_runs_grow_stale(spark, tmp_path):
    rows = [[(1, 1, "running", "2024-01-01 00:00:00"), (2, 1, "running", "2024-01-01 00:00:00")], [(2, 1, "succeeded", "2024-01-01 00:10:00")], [(3, 1, "running", "2024-01-05 00:00:00")]]
    assert [r.run_id for r in drain(stale_runs(written(spark, tmp_path, rows, RUNS))).collect()] == [1]


def test_snapshots_become_versions(spark, tmp_path):
    kinds = "site_id int, external_job_id string, title string, market_scope string, ts timestamp"
    empty = "SELECT 1 AS site_id, 'a' AS external_job_id, 't' AS title, 'US' AS market_scope, true AS active, TIMESTAMP '2024-01-01' AS first_seen_at, TIMESTAMP '2024-01-01' AS last_seen_at, CAST(NULL AS timestamp) AS closed_at"
    root = str(tmp_path / "history")
    spark.sql(empty).write.parquet(f"{root}/version=0")
    stream = written(spark, tmp_path, [[(1, "b", "u", "US", "2024-02-01")], [(1, "a", "t", "US", "2024-02-02")]], kinds)
    run = snapshot_versions(root)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    active = lambda v: {r.external_job_id: r.active for r in spark.read.parquet(f"{root}/version={v}").collect()}
    assert active(1) == {"a": False, "b": True} and active(2) == {"a": True, "b": False}


def test_a_repeated_arrival_changes_nothing(spark):
    from hirelake.streaming.jobs import apply_arrivals

    kinds = "site_id long, external_job_id string, market_scope string, ts timestamp"
    rows = lambda *r: spark.sql("SELECT * FROM VALUES " + ", ".join(f"({s}L, '{j}', '{m}', TIMESTAMP '{t}')" for s, j, m, t in r) + " AS t(site_id, external_job_id, market_scope, ts)")
    none = spark.createDataFrame([], "site_id long, external_job_id string, market_scope string, active boolean, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp")
    first, second, third = rows((1, "a", "US", "2024-01-01"), (1, "b", "US", "2024-01-01"), (2, "c", "US", "2024-01-01")), rows((1, "b", "US", "2024-01-02"), (1, "d", "non-US", "2024-01-02")), rows((1, "a", "US", "2024-01-03"))
    found = {r.external_job_id: (r.active, str(r.first_seen_at)[:10], str(r.last_seen_at)[:10], r.closed_at and str(r.closed_at)[:10]) for r in apply_arrivals([first, second, third], none).collect()}
    assert first.schema.simpleString() == spark.createDataFrame([], kinds).schema.simpleString()
    assert found == {"a": (True, "2024-01-01", "2024-01-03", None), "b": (False, "2024-01-01", "2024-01-02", "2024-01-03"), "c": (True, "2024-01-01", "2024-01-01", None)}
