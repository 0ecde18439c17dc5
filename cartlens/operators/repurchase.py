"""Repurchase cycles of consumables, due dates and reminders.

Two purchases of a product on one calendar day are less than 24 hours apart, so
their gap is 0 whole days. All operators therefore start from one row per user,
product and day, built with partial aggregation; the lag window then sees at
most one row per day of a pair, however many lines the pair has.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens import constants as C
from cartlens.functions.dates import due_within, elapsed_days, next_due, reminder_text, whole_cycle
from cartlens.functions.scores import clip, hash_bucket
from cartlens.operators.baskets import delivered
from cartlens.operators.ranks import dense_codes, exact_quantile

PAIR = ["user_id", "product_id"]
LINE_KEY = ["order_id", "line_no", "tie_1", "tie_2", "quantity"]
MODEL_FEATURES = ["quantity", "weight_gram", "product_code", "avg_days_between"]


def purchase_history(order_items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """Delivered lines of consumable products with user, time and weight."""
    consumable = products.where("is_consumable").select("product_id", "weight_gram")
    placed = delivered(orders).select(
        "order_id", "user_id", F.col("created_at").alias("order_date")
    )
    return (
        order_items.select("product_id", *LINE_KEY)
        .join(consumable, "product_id")
        .join(placed, "order_id")
        .select(*PAIR, "order_date", *LINE_KEY, "weight_gram")
    )


def purchase_days(history: DataFrame) -> DataFrame:
    """One row per user, product and day; the common input of training and serving.

    ``line`` is the day's first line in order of time and line key.
    """
    return history.groupBy(*PAIR, F.to_date("order_date").alias("day")).agg(
        F.min(F.struct("order_date", *LINE_KEY)).alias("line"),
        F.min("order_date").alias("first_at"),
        F.max("order_date").alias("last_at"),
        F.count("*").alias("n_lines"),
        F.sum("quantity").alias("total_quantity"),
        F.count("quantity").alias("n_quantities"),
        F.max("weight_gram").alias("weight_gram"),
    )


def _with_previous(days: DataFrame) -> DataFrame:
    """Add ``gap``: whole days since the pair's last purchase on an earlier day."""
    previous = F.lag("last_at").over(Window.partitionBy(*PAIR).orderBy("day"))
    return days.withColumn("gap", elapsed_days(previous, F.col("first_at")))


def repurchase_gaps(days: DataFrame) -> DataFrame:
    """Training rows: gaps of 1 to 365 days with quantity and weight of the later line.

    Of several lines at one time the first by line key carries the gap; the
    others follow at 0 days and fall outside the range.
    """
    return (
        _with_previous(days.select(*PAIR, "day", "line", "first_at", "last_at", "weight_gram"))
        .where(F.col("gap").between(C.MIN_GAP_DAYS, C.MAX_GAP_DAYS))
        .select(
            *PAIR,
            *[F.col(f"line.{name}") for name in LINE_KEY],
            "weight_gram",
            F.col("gap").alias("days_between"),
        )
    )


def pair_state(days: DataFrame) -> DataFrame:
    """Last purchase, mean quantity and mean cycle of every user and product.

    The cycle takes in all gaps, also 0 days and more than a year; a pair bought
    once has none.
    """
    lines = F.sum("n_lines")
    return (
        _with_previous(days.drop("line"))
        .groupBy(*PAIR)
        .agg(
            F.max("weight_gram").alias("weight_gram"),
            F.max("last_at").alias("last_purchase"),
            (F.sum("total_quantity") / F.nullif(F.sum("n_quantities"), F.lit(0))).alias(
                "avg_quantity"
            ),
            F.when(lines > 1, F.coalesce(F.sum("gap"), F.lit(0)) / (lines - 1)).alias(
                "avg_days_between"
            ),
        )
    )


def repurchase_cycles(days: DataFrame) -> DataFrame:
    """Mean gap of the pairs bought more than once."""
    return (
        pair_state(days)
        .where(F.col("avg_days_between").isNotNull())
        .select(*PAIR, "avg_days_between")
    )


def gap_profile(gaps: DataFrame) -> DataFrame:
    """Size and spread of the training gaps; the median runs over at most 365 values."""
    median = (
        gaps.groupBy("days_between")
        .agg(F.count("*").alias("n"))
        .agg(F.percentile("days_between", 0.5, F.col("n")))
        .scalar()
    )
    return gaps.agg(
        F.count("*").alias("total_samples"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("product_id").alias("unique_products"),
        F.round(F.avg("days_between"), 2).alias("mean_days"),
        F.min("days_between").alias("min_days"),
        F.max("days_between").alias("max_days"),
    ).withColumn("median_days", F.round(median, 2))


def product_encoder(gaps: DataFrame) -> DataFrame:
    """Code of every product with a usable gap, in id order."""
    return dense_codes(gaps, "product_id", "product_code")


def _fill_weight(df: DataFrame) -> DataFrame:
    """Missing weights become the median of the rows, or 0 where no row has one."""
    median = exact_quantile(df, "weight_gram", 0.5, "median").scalar()
    return df.withColumn("_median", median).withColumn(
        "weight_gram", F.coalesce("weight_gram", "_median", F.lit(0.0))
    ).drop("_median")


def training_features(
    gaps: DataFrame, encoder: DataFrame, leave_one_out: bool = False
) -> DataFrame:
    """Model inputs per gap.

    The mean cycle of the pair includes the row's own gap; ``leave_one_out``
    takes it out, which leaves pairs with a single gap without a cycle.
    """
    pair = Window.partitionBy(*PAIR)
    cycle = F.avg("days_between").over(pair)
    if leave_one_out:
        others = F.count("*").over(pair) - 1
        rest = F.sum("days_between").over(pair) - F.col("days_between")
        cycle = F.when(others > 0, rest / others)
    with_cycle = gaps.withColumn("avg_days_between", cycle)
    return (
        _fill_weight(with_cycle)
        .join(encoder, "product_id")
        .select(
            *PAIR,
            *LINE_KEY,
            "weight_gram",
            "product_code",
            "avg_days_between",
            "days_between",
        )
    )


def line_bucket() -> Column:
    """Stable fifth of a training row, from its line key."""
    keys = ["order_id", "line_no", "tie_1", "tie_2"]
    quantity = F.col("quantity").cast("long").cast("string")
    return hash_bucket(str(C.SEED), 5, *[F.col(k).cast("string") for k in keys], quantity)


def split_rows(features: DataFrame) -> DataFrame:
    """Mark one row in five as test row."""
    return features.withColumn("is_test", line_bucket() == 0)


def serving_features(state: DataFrame, encoder: DataFrame) -> DataFrame:
    """Model inputs of every pair whose product the model knows.

    Weights are filled from all pairs before unknown products drop out. Pairs
    bought once get the fallback cycle.
    """
    filled = _fill_weight(state)
    return filled.join(encoder, "product_id").select(
        *PAIR,
        "last_purchase",
        F.coalesce("avg_quantity", F.lit(C.FALLBACK_QUANTITY)).alias("quantity"),
        "weight_gram",
        "product_code",
        F.coalesce("avg_days_between", F.lit(C.FALLBACK_CYCLE_DAYS)).alias("avg_days_between"),
    )


def fit_forest(train: DataFrame, max_depth: int = 10, trees: int = C.FOREST_TREES):
    """Random forest over all features per split.

    Trees live on the driver, so their depth is bounded: at most 2,047 nodes per
    tree however many rows there are. On the sample tables deeper trees only
    fit noise; ``max_depth`` goes up to 30 where full-grown trees are wanted.
    """
    assembler = VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features")
    forest = RandomForestRegressor(
        labelCol="days_between",
        numTrees=trees,
        featureSubsetStrategy="all",
        maxDepth=max_depth,
        maxBins=512,
        seed=C.SEED,
        cacheNodeIds=False,
        maxMemoryInMB=512,
    )
    return Pipeline(stages=[assembler, forest]).fit(train)


def model_metrics(scored: DataFrame) -> DataFrame:
    """Mean absolute error and R² of ``prediction``, and the confidence R² stands for."""
    error = F.col("days_between") - F.col("prediction")
    explained = 1.0 - F.sum(error * error) / F.nullif(
        F.var_pop("days_between") * F.count("*"), F.lit(0.0)
    )
    return (
        scored.agg(
            F.avg(F.abs(error)).alias("mae"),
            explained.alias("r2"),
            F.count("*").alias("n_test"),
        )
        .select(
            F.round("mae", 2).alias("mae_days"),
            F.round("r2", 4).alias("r2_score"),
            "n_test",
            F.round(
                F.coalesce(
                    clip(F.col("r2"), C.CONFIDENCE_FLOOR, C.CONFIDENCE_CEILING),
                    F.lit(C.CONFIDENCE_FLOOR),
                ),
                4,
            ).alias("confidence"),
        )
    )


def due_dates(predicted: DataFrame, as_of: dt.date, days: str, confidence: float) -> DataFrame:
    """Next due date of every pair from its last purchase and predicted days."""
    cycle = whole_cycle(F.col(days))
    return predicted.select(
        *PAIR,
        next_due(F.col("last_purchase"), cycle, as_of).alias("predicted_date"),
        F.lit(round(confidence, 4)).alias("confidence"),
        F.lit(False).alias("notified"),
    )


def upcoming_repurchases(
    predictions: DataFrame,
    products: DataFrame,
    as_of: dt.date,
    days_ahead: int = C.DAYS_AHEAD,
    user_id: int | None = None,
) -> DataFrame:
    """Everything due within ``days_ahead`` days, with product names, no row limit.

    ``position`` numbers each user's list by date. ``user_id`` asks for one user.
    """
    low, high = C.DAYS_AHEAD_RANGE
    if not low <= days_ahead <= high:
        raise ValueError(f"days_ahead must lie in {low}..{high}")
    due = predictions.where(due_within("predicted_date", as_of, days_ahead))
    if user_id is not None:
        due = due.where(F.col("user_id") == user_id)
    named = products.select("product_id", F.col("name").alias("product_name"))
    by_date = Window.partitionBy("user_id").orderBy("predicted_date", "product_id")
    return (
        due.join(named, "product_id")
        .select(*PAIR, "product_name", "predicted_date", "confidence")
        .withColumn("position", F.row_number().over(by_date))
    )


def due_reminders(
    predictions: DataFrame,
    products: DataFrame,
    as_of: dt.date,
    days_ahead: int = C.REMINDER_DAYS_AHEAD,
) -> DataFrame:
    """Predictions due soon that nobody was reminded of yet, with product names."""
    named = products.select("product_id", F.col("name").alias("product_name"))
    return (
        predictions.where(~F.col("notified"))
        .where(due_within("predicted_date", as_of, days_ahead))
        .join(named, "product_id")
    )


def notifications(due: DataFrame) -> DataFrame:
    return due.select(
        "user_id",
        F.lit(C.REMINDER_TYPE).alias("type"),
        F.lit(C.REMINDER_TITLE).alias("title"),
        reminder_text("product_name", "predicted_date").alias("message"),
        F.col("product_id").alias("ref_id"),
    )


def unsent(found: DataFrame, sent: DataFrame) -> DataFrame:
    """Notifications that ``sent`` does not hold yet; the message names the due date."""
    held = sent.select(*[F.col(c).alias(f"_{c}") for c in found.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in found.columns]
    return found.join(held, same, "left_anti")


def mark_notified(predictions: DataFrame, sent: DataFrame) -> DataFrame:
    """Predictions with ``notified`` set for the pairs in ``sent``."""
    keys = sent.select(*PAIR).distinct().withColumn("_sent", F.lit(True))
    return (
        predictions.join(keys, PAIR, "left")
        .withColumn("notified", F.col("notified") | F.coalesce("_sent", F.lit(False)))
        .drop("_sent")
    )
