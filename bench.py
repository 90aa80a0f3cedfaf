"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from hirelake.plans import cascades, catalog, companies, jobs, names, reports, status, streams, titles

#: Timed after a first run; the metric is their sum. The rest is timed once.
HEADLINE = catalog.QUERIES | companies.QUERIES | titles.QUERIES
ONCE = reports.QUERIES | jobs.QUERIES | streams.QUERIES
try:
    from hirelake.llm import queries as llm

    ONCE |= llm.QUERIES
except ImportError:
    pass
ONCE |= names.QUERIES | status.QUERIES | cascades.QUERIES
#: After so many seconds no further query is begun.
SECONDS = float(os.environ.get("BENCH_SECONDS", "1200"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, start = {}, time.perf_counter()
    for name, query in HEADLINE.items():
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    total = round(sum(took.values()), 3)
    for name, query in ONCE.items():
        began = time.perf_counter()
        if began - start > SECONDS:
            break
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
