"""Behaviour logs laid out by day, so that a question about some days reads those days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens import schemas

_DAY = T.StructField("day", T.DateType())


def write_daily(behavior: DataFrame, path: str, mode: str = "append") -> None:
    """Write logs in one folder per day; a day with many rows becomes several files, written by several tasks."""
    dated = behavior.withColumn("day", F.col("created_at").cast("date"))
    dated.hint("rebalance", "day").write.mode(mode).partitionBy("day").parquet(path)


def read_daily(
    spark: SparkSession, path: str, since: dt.datetime | None = None, until: dt.datetime | None = None
) -> DataFrame:
    """Logs with ``since <= created_at < until``; folders of other days are not listed as input."""
    logs = spark.read.schema(T.StructType([*schemas.BEHAVIOR.fields, _DAY])).parquet(path)

    def at(moment: dt.datetime):
        # As text: a datetime literal would pass through the session's time zone.
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")

    if since is not None:
        logs = logs.where((F.col("day") >= F.lit(since.date())) & (F.col("created_at") >= at(since)))
    if until is not None:
        logs = logs.where((F.col("day") <= F.lit(until.date())) & (F.col("created_at") < at(until)))
    return logs
