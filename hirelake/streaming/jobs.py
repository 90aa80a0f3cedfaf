"""Structured Streaming forms of the crawl jobs; each takes and gives a streaming DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hirelake.operators.activity import ZONE
from hirelake.operators.postings import KEYS, apply_snapshot
from hirelake.sources.shared import shared_root

DELAY, STALE_MINUTES, MAX_BACKOFF_HOURS, INTERVAL_HOURS = "1 day", 60, 24, 168


def _counts() -> list:
    status = F.col("status")
    return [F.count("*").alias("runs"), F.count_if(status == "succeeded").alias("successes"), F.count_if(status == "failed").alias("failures")]


def daily_runs(runs: DataFrame, delay: str = DELAY) -> DataFrame:
    """Runs by local day; a day is given once the watermark has passed it."""
    local = runs.withColumn("local", F.from_utc_timestamp("started_at", ZONE)).withWatermark("local", delay)
    return local.groupBy(F.window("local", "1 day")).agg(*_counts()).select(F.to_date("window.start").alias("activity_date"), "runs", "successes", "failures")


def trailing_health(runs: DataFrame, sites: DataFrame, delay: str = DELAY) -> DataFrame:
    """Runs by source type over seven days, for each day; ``sites`` is static."""
    rows = runs.withWatermark("started_at", delay).join(sites.select("site_id", "source_type"), "site_id")
    return rows.groupBy(F.window("started_at", "7 days", "1 day"), "source_type").agg(*_counts()).select(F.to_date("window.end").alias("day"), "source_type", "runs", "successes", "failures")


def unique_postings(postings: DataFrame, at: str = "ts", delay: str = DELAY) -> DataFrame:
    """Each (site, job) once for as long as the watermark keeps its key."""
    return postings.withWatermark(at, delay).dropDuplicatesWithinWatermark(KEYS)


def stale_runs(runs: DataFrame, minutes: int = STALE_MINUTES, delay: str = DELAY) -> DataFrame:
    """Runs without an end when the watermark is ``minutes`` past their start.

    A run's rows are one session of ``minutes``; when it closes, a run without an end is stale. An end that
    comes later belongs to a session of its own, which says nothing. State is one row for each run of the
    last ``delay`` and ``minutes``. Rows without a start time are ignored.
    """
    rows = runs.where("started_at IS NOT NULL").select("run_id", "status", "started_at").withWatermark("started_at", delay)
    sessions = rows.groupBy(F.session_window("started_at", f"{minutes} minutes"), "run_id").agg(F.min("started_at").alias("started_at"), F.bool_or(~F.col("status").eqNullSafe("running")).alias("ended"))
    return sessions.where("NOT ended").select("run_id", "started_at", F.lit("stale_timeout").alias("error_code"))


def crawl_backoff(runs: DataFrame, interval_hours: int = INTERVAL_HOURS) -> DataFrame:
    """(site_id, consecutive_failures, last_run_at, next_crawl_at) of the sites that each batch touches (update mode).

    A success starts from zero and waits for the interval; a failure waits 2 to the number of failures before
    it, from 1 to 24 hours. Of runs at one time the failure counts last; running ones don't count. A task
    holds one site's times and outcomes of one batch.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["started_at", "failed"], kind="stable")
        wins = (~rows["failed"]).to_numpy().nonzero()[0]
        failures = len(rows) - 1 - int(wins[-1]) if len(wins) else failures + len(rows)
        state.update((failures,))
        hours = min(MAX_BACKOFF_HOURS, 2 ** min(failures - 1, 10)) if failures else interval_hours
        last = rows["started_at"].iloc[-1]
        yield pd.DataFrame({"site_id": [key[0]], "consecutive_failures": [failures], "last_run_at": [last], "next_crawl_at": [last + pd.Timedelta(hours=hours)]})

    ended = runs.where("status IN ('succeeded', 'failed') AND started_at IS NOT NULL AND site_id IS NOT NULL").select("site_id", "started_at", (F.col("status") == "failed").alias("failed"))
    kinds = "site_id long, consecutive_failures long, last_run_at timestamp, next_crawl_at timestamp"
    return ended.groupBy("site_id").applyInPandasWithState(follow, kinds, "failures long", "update", GroupStateTimeout.NoTimeout)


def snapshot_versions(root: str, at: str = "ts"):
    """A foreachBatch function: each batch turns version n of the history under ``root`` into n + 1.

    Version 0 is there before. Versions are only ever read after they are whole, so a repeated batch
    gives the same version again.
    """

    def run(stage: DataFrame, batch_id: int) -> None:
        spark = stage.sparkSession
        last = stage.agg(F.max(at)).first()[0]
        history = spark.read.parquet(f"{root}/version={batch_id}")
        out = history if last is None else apply_snapshot(history, stage, str(last)).drop("change")
        out.write.mode("overwrite").parquet(f"{root}/version={batch_id + 1}")

    return run


def apply_arrivals(arrivals: list[DataFrame], history: DataFrame, at: str = "ts") -> DataFrame:
    """The history after snapshots that arrive one after another, each a micro-batch of one stream.

    A batch that is delivered again gives the version that it gave before.
    """
    spark = history.sparkSession
    root = f"{shared_root(spark)}/snapshots-{uuid.uuid4().hex}"
    history.write.parquet(f"{root}/version=0")
    run = snapshot_versions(root, at)
    stream = spark.readStream.schema(arrivals[0].schema).parquet(f"{root}/in/*")
    for k, stage in enumerate(arrivals):
        stage.write.parquet(f"{root}/in/k{k}")
        stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    run(spark.read.parquet(f"{root}/in/k{len(arrivals) - 1}"), len(arrivals) - 1)
    return spark.read.parquet(f"{root}/version={len(arrivals)}")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all that is there now, with the number of its ``batch``; files in the shared folder."""
    spark: SparkSession = stream.sparkSession
    out = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/rows/batch=-1")
    write = lambda rows, k: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={k}")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")
