"""Baskets of delivered orders and one-to-one association rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens import constants as C
from cartlens.operators.cooccurrence import both_directions, pair_sums
from cartlens.operators.ranks import top_per_key
from cartlens.session import cut_lineage


def delivered(orders: DataFrame) -> DataFrame:
    """Delivered orders, whatever the case of the status."""
    return orders.where(F.lower("order_status") == "delivered")


def order_items_delivered(order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Order and product of every delivered line; repeated lines stay."""
    return order_items.select("order_id", "product_id").join(
        delivered(orders).select("order_id"), "order_id"
    )


def basket_items(lines: DataFrame) -> DataFrame:
    """Distinct products per order with the number of their lines."""
    return lines.groupBy("order_id", "product_id").agg(F.count("*").alias("n_lines"))


def baskets(items: DataFrame) -> DataFrame:
    """Distinct products of each order as one ascending list; no other operator reads the lists."""
    return items.groupBy("order_id").agg(
        F.sort_array(F.collect_set("product_id")).alias("items"),
        F.sum("n_lines").alias("n_lines"),
    )


def basket_profile(items: DataFrame) -> DataFrame:
    """Baskets, lines with repeats, distinct products and mean lines per basket."""
    totals = items.agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("n_lines").alias("total_items"),
        F.countDistinct("product_id").alias("unique_products"),
    )
    size = F.col("total_items") / F.col("total_orders")
    return totals.withColumn(
        "avg_items_per_order", F.round(F.when(F.col("total_orders") > 0, size), 2)
    )


def _basket_count(items: DataFrame):
    return items.agg(F.countDistinct("order_id")).scalar()


def frequent_items(items: DataFrame, min_support: float = C.MIN_SUPPORT) -> DataFrame:
    counted = items.groupBy("product_id").agg(F.count("*").alias("n_baskets"))
    support = F.col("n_baskets") / _basket_count(items)
    return counted.withColumn("support", support).where(F.col("support") >= min_support)


class MinedRules(NamedTuple):
    """Written tables of one mining run, and the rules over them."""

    frequent: DataFrame
    pairs: DataFrame
    rules: DataFrame


def _frequent_only(items: DataFrame, frequent: DataFrame) -> DataFrame:
    """Rows of frequent products, for ``frequent`` read from a written table.

    The supports of all products add up to the mean number of distinct products
    per basket, so at most ``mean / min_support`` products are frequent. Spark
    sees the size of the written table and ships it to the tasks where it is
    small enough, or shuffles otherwise.
    """
    return items.select("order_id", "product_id").join(frequent.select("product_id"), "product_id")


def frequent_pairs(
    items: DataFrame, min_support: float = C.MIN_SUPPORT, frequent: DataFrame | None = None
) -> DataFrame:
    """Product pairs ``item_a < item_b`` in at least ``min_support`` of the baskets.

    ``items`` is read several times, so it is best a written table.
    """
    if frequent is None:
        frequent = cut_lineage(frequent_items(items, min_support), "frequent")
    counted = pair_sums(_frequent_only(items, frequent), "order_id", "product_id")
    support = F.col("n_baskets") / _basket_count(items)
    return (
        counted.select("item_a", "item_b", F.col("total").cast("long").alias("n_baskets"))
        .withColumn("support", support)
        .where(F.col("support") >= min_support)
    )


def mine_rules(
    items: DataFrame,
    min_support: float = C.MIN_SUPPORT,
    min_confidence: float = C.MIN_CONFIDENCE,
    min_lift: float = C.MIN_LIFT,
) -> MinedRules:
    """Rules from one product to one product; all three thresholds are inclusive."""
    frequent = cut_lineage(frequent_items(items, min_support), "frequent")
    pairs = cut_lineage(frequent_pairs(items, min_support, frequent), "pairs")
    n_baskets = _basket_count(items)
    directed = both_directions(pairs, "n_baskets", "support")
    left = frequent.select(F.col("product_id").alias("item"), F.col("n_baskets").alias("n_item"))
    right = frequent.select(F.col("product_id").alias("other"), F.col("n_baskets").alias("n_other"))
    confidence = F.col("n_baskets") / F.col("n_item")
    # One division keeps an exactly independent pair at exactly 1; doubles, as
    # the products of counts outgrow a long.
    observed = F.col("n_baskets").cast("double") * n_baskets
    lift = observed / (F.col("n_item").cast("double") * F.col("n_other"))
    rules = (
        directed.join(left, "item")
        .join(right, "other")
        .select(
            F.col("item").alias("antecedent_id"),
            F.col("other").alias("consequent_id"),
            "support",
            confidence.alias("confidence"),
            lift.alias("lift"),
        )
        .where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    )
    return MinedRules(frequent, pairs, rules)


def association_rules(items: DataFrame, **thresholds: float) -> DataFrame:
    return mine_rules(items, **thresholds).rules


def rules_profile(mined: MinedRules) -> DataFrame:
    """Number of frequent sets of one and two products, and means over the rules."""
    singles = mined.frequent.agg(F.count("*")).scalar()
    pairs = mined.pairs.agg(F.count("*")).scalar()
    return mined.rules.agg(
        F.count("*").alias("n_rules"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("lift"), 4).alias("avg_lift"),
    ).withColumn("n_itemsets", singles + pairs)


def fpgrowth_model(items: DataFrame, min_support: float = C.MIN_SUPPORT):
    """FP-Growth over the frequent part of each basket, all sizes of item sets.

    Infrequent products are dropped first: no frequent set holds one, and the
    baskets become bounded. Supports then refer to the baskets that remain, so
    the threshold is restated as the same number of baskets.
    """
    frequent = cut_lineage(frequent_items(items, min_support), "frequent")
    kept = _frequent_only(items, frequent).groupBy("order_id").agg(
        F.collect_set("product_id").alias("items")
    ).persist()
    total = items.select("order_id").distinct().count()
    remaining = kept.count()
    least = next(n for n in range(int(min_support * total), total + 2) if n / total >= min_support)
    share = max(least - 0.5, 0.0) / max(remaining, 1)
    model = FPGrowth(itemsCol="items", minSupport=min(share, 1.0), minConfidence=0.0).fit(kept)
    kept.unpersist()
    return model, total


def frequent_itemsets(items: DataFrame, min_support: float = C.MIN_SUPPORT) -> DataFrame:
    """Frequent item sets of all sizes with their number of baskets and support."""
    model, total = fpgrowth_model(items, min_support)
    return model.freqItemsets.select(
        F.sort_array("items").alias("items"),
        F.col("freq").alias("n_baskets"),
        (F.col("freq") / total).alias("support"),
    )


def associated_products(
    rules: DataFrame, top_n: int = C.PRODUCT_TOP_N, product_id: int | None = None
) -> DataFrame:
    """Strongest consequents of every product, or of one, by lift, confidence, then id."""
    if product_id is not None:
        rules = rules.where(F.col("antecedent_id") == product_id)
    order = [F.desc("lift"), F.desc("confidence"), F.asc("consequent_id")]
    return top_per_key(rules, ["antecedent_id"], order, top_n).select(
        F.col("antecedent_id").alias("product_id"),
        "rank",
        F.col("consequent_id").alias("recommended_id"),
        F.round("confidence", 4).alias("confidence"),
        F.round("lift", 4).alias("lift"),
    )


def product_recommendations(
    rules: DataFrame, top_n: int = C.PRODUCT_TOP_N, product_id: int | None = None
) -> DataFrame:
    """Bought-together list with the confidence as its score."""
    low, high = C.PRODUCT_RANGE
    if not low <= top_n <= high:
        raise ValueError(f"top_n must lie in {low}..{high}")
    return (
        associated_products(rules, top_n, product_id)
        .withColumn("score", F.col("confidence"))
        .withColumn("rec_type", F.lit("association"))
    )
