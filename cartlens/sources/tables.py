"""Readers for the shop's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_sql(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    """Run a SQL text with bound named parameters (``:name``)."""
    return spark.sql(query, args=params or {})


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files under a declared schema."""
    return spark.read.schema(schema).parquet(path)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    schema: T.StructType,
    split_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 64,
    options: dict | None = None,
) -> DataFrame:
    """Database table, read in parallel ranges of ``split_column`` and cast to ``schema``.

    ``table`` may also be a bracketed sub-query with an alias.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("preferTimestampNTZ", "true")
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    if split_column is not None:
        low, high = bounds
        reader = (
            reader.option("partitionColumn", split_column)
            .option("lowerBound", low)
            .option("upperBound", high)
            .option("numPartitions", partitions)
        )
    return conform(reader.load(), schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast the columns of ``schema``."""
    return df.select([F.col(field.name).cast(field.dataType) for field in schema])


def normalise_vocabulary(df: DataFrame, *columns: str) -> DataFrame:
    """Lower-case enumerations once at load, since the shop compares them without case."""
    return df.withColumns({name: F.lower(name) for name in columns})
