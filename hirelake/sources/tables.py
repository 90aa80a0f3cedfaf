"""Readers, typed stages and keyed writes on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


#: Where a row of a file that doesn't fit its schema is kept.
MALFORMED = "_malformed"


def read_table(spark: SparkSession, source: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A table by its name in the catalog, or Parquet files by their path, or a table of a database.

    ``jdbc`` has the reader's options: url, and for a read in parts partitionColumn, lowerBound, upperBound, numPartitions.
    """
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=source, **jdbc).load()
    return spark.read.parquet(source) if "/" in source else spark.read.table(source)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed rows of CSV files with a header; what doesn't fit is null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def fitting_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of CSV files that fit the schema; ``malformed_rows`` has the others."""
    return _csv(spark, path, schema).where(F.col(MALFORMED).isNull()).drop(MALFORMED)


def malformed_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The lines of CSV files that don't fit the schema."""
    return _csv(spark, path, schema).where(F.col(MALFORMED).isNotNull()).select(F.col(MALFORMED).alias("line"))


def _csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    wide = StructType([*schema.fields, StructField(MALFORMED, StringType())])
    rows = spark.read.schema(wide).option("header", True).option("escape", '"').option("columnNameOfCorruptRecord", MALFORMED).csv(path)
    # Spark refuses a scan of the malformed column alone; a condition that always holds names the others.
    return rows.where(F.hash(*schema.names) % 1 == 0)


def export_csv(df: DataFrame, path: str, order: list[str | Column]) -> None:
    """CSV parts with a header, sorted over all parts: part names are in the order of their rows. Null and empty texts differ."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions of which ``df`` has rows; others stay as they are. Without partitions all is replaced."""
    if by:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` without the rows of the given keys."""
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def cast_stage(df: DataFrame, schema: StructType) -> DataFrame:
    """Text columns to the schema's types; blank texts and what can't be cast become null."""
    return df.select(*(F.nullif(F.trim(F.col(f.name)), F.lit("")).try_cast(f.dataType).alias(f.name) for f in schema))


def merge_upsert(base: DataFrame, updates: DataFrame, keys: list[str], policy: dict[str, str] | None = None) -> DataFrame:
    """``base`` with ``updates`` by key; columns are replaced, or by policy: keep, coalesce, least, greatest.

    Keys are unique on either side and not null. ``coalesce`` takes the update's value unless it is null.
    """
    policy = policy or {}
    b, u = base.withColumn("_b", F.lit(True)).alias("b"), updates.withColumn("_u", F.lit(True)).alias("u")
    joined = b.join(u, [F.col(f"b.{k}") == F.col(f"u.{k}") for k in keys], "full_outer")

    def merged(name: str) -> Column:
        old, new = F.col(f"b.{name}"), F.col(f"u.{name}")
        if name in keys:
            return F.coalesce(new, old).alias(name)
        both = {"replace": new, "keep": old, "coalesce": F.coalesce(new, old), "least": F.least(old, new), "greatest": F.greatest(old, new)}[policy.get(name, "replace")]
        return F.when(F.col("u._u").isNull(), old).when(F.col("b._b").isNull(), new).otherwise(both).alias(name)

    return joined.select(*map(merged, base.columns))


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(rows.dropDuplicates(keys).join(base, keys, "left_anti").select(*base.columns))
