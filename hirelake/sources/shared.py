"""Tables kept for a while in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a session of one machine gets a temporary folder and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scope:
    """Tables that several later plans read are written once; leaving the scope deletes them.

    with Scope(spark) as scope:
        stats = scope.keep(df, "stats")
        ...  # write what depends on stats

    Without ``with`` the tables stay, as a result that is still lazy needs them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths.clear()

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    return Scope(df.sparkSession).keep(df, name)
