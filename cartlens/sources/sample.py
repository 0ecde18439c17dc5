"""The shop schema laid over the generated star-schema tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.operators.segments import purchase_summary

AS_OF = dt.date(2001, 8, 2)
RECENT_SINCE = dt.datetime(2024, 1, 28)
CATALOGUE_SIZE = 25


@dataclass(frozen=True)
class Shop:
    """The input tables of every operator."""

    behavior: DataFrame
    orders: DataFrame
    order_items: DataFrame
    products: DataFrame
    users: DataFrame

    @property
    def summary(self) -> DataFrame:
        return purchase_summary(self.orders)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _relabelled(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """Add ``label`` for the values of ``column``, one branch of a union per value.

    A filter on the label then removes the other branches and reaches the scan
    as a filter on ``column``, which an expression over the column would not.
    """
    known = F.col(column).isin(*labels)
    branches = [df.where(~F.coalesce(known, F.lit(False))).withColumn("label", F.lit(None).cast("string"))]
    branches += [
        df.where(F.col(column) == value).withColumn("label", F.lit(label))
        for value, label in labels.items()
    ]
    return reduce(DataFrame.unionAll, branches)


def sample_shop(spark: SparkSession, folder: str) -> Shop:
    """Map the tables in ``folder``; user 0 plays the anonymous visitor."""
    event = F.lower("event_type")
    behavior = _table(spark, folder, "events").select(
        F.nullif("user_id", F.lit(0)).cast("long").alias("user_id"),
        (F.get_json_object("props", "$.k").cast("long") % CATALOGUE_SIZE).alias("product_id"),
        F.when(event == "click", "add_to_cart")
        .when(event == "error", "remove_from_cart")
        .otherwise(event)
        .alias("action"),
        F.col("value").alias("duration_sec"),
        F.col("ts").alias("created_at"),
    )
    orders = _relabelled(
        _table(spark, folder, "orders"),
        "o_orderstatus",
        {"F": "delivered", "O": "pending", "P": "cancelled"},
    ).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("label").alias("order_status"),
        F.col("o_totalprice").alias("order_total"),
        F.col("o_orderdate").alias("created_at"),
    )
    order_items = _table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_partkey") % CATALOGUE_SIZE).alias("product_id"),
        F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_partkey").alias("tie_1"),
        F.col("l_suppkey").alias("tie_2"),
    )
    # A product stands for all parts of one remainder; its lowest part describes it.
    lowest = F.min(F.struct("p_partkey", "p_name", "p_size")).alias("part")
    part_id = F.col("part.p_partkey")
    products = (
        _table(spark, folder, "part")
        .groupBy((F.col("p_partkey") % CATALOGUE_SIZE).alias("product_id"))
        .agg(lowest)
        .select(
            "product_id",
            F.col("part.p_name").alias("name"),
            (part_id % 2 == 0).alias("is_consumable"),
            F.when(part_id % 10 != 0, F.col("part.p_size") * 10.0).alias("weight_gram"),
        )
    )
    user_id = F.col("c_custkey")
    users = _table(spark, folder, "customer").select(
        user_id.alias("user_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "staff").otherwise("customer").alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.when(
            user_id % 50 != 0,
            F.date_add(F.lit(dt.date(1995, 1, 1)), (user_id % 1000).cast("int")),
        )
        .cast("timestamp_ntz")
        .alias("created_at"),
    )
    return Shop(behavior, orders, order_items, products, users)


def offer_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Units per customer and offer, as scores: a catalogue of thousands, each part in two offers by its supplier."""
    orders = _table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id")
    )
    lines = _table(spark, folder, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") * 2 + F.col("l_suppkey") % 2).alias("product_id"), "l_quantity"
    )
    return lines.join(orders, "l_orderkey").groupBy("user_id", "product_id").agg(
        F.sum(F.col("l_quantity").cast("double")).alias("score"), F.count("*").alias("n_events")
    )
