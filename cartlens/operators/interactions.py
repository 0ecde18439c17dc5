"""Behaviour logs and user-product interaction scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens import constants as C
from cartlens.functions.scores import clip, event_score, hash_bucket


def behavior_logs(behavior: DataFrame, min_date: dt.datetime | None = None) -> DataFrame:
    """Events of known users on known products, optionally from ``min_date`` on.

    The order of rows carries no meaning for any consumer, so none is imposed.
    """
    logs = behavior.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    if min_date is not None:
        # As text: a datetime literal would pass through the session's time zone.
        since = F.lit(min_date.isoformat(sep=" ")).cast("timestamp_ntz")
        logs = logs.where(F.col("created_at") >= since)
    return logs.select(
        "user_id",
        "product_id",
        F.lower("action").alias("action"),
        F.coalesce("duration_sec", F.lit(0.0)).alias("duration_sec"),
        "created_at",
    )


def interaction_scores(logs: DataFrame) -> DataFrame:
    """One row per user and product seen in the logs, clipped at 0 after the sum.

    Rows clipped to 0 stay: they keep the user and the product in the matrix.
    """
    return logs.groupBy("user_id", "product_id").agg(
        clip(F.sum(event_score()), low=0.0).alias("score"),
        F.count("*").alias("n_events"),
    )


def interaction_matrix(
    scores: DataFrame, product_ids: list[int], max_columns: int = 1000
) -> DataFrame:
    """Users by products with 0 for missing pairs, for a small listed catalogue."""
    if len(product_ids) > max_columns:
        raise ValueError("catalogue too wide for a pivot; use the long score table")
    wide = scores.groupBy("user_id").pivot("product_id", product_ids).agg(F.first("score"))
    names = {str(p): f"p{p}" for p in product_ids}
    return wide.na.fill(0.0, subset=list(names)).withColumnsRenamed(names)


def interaction_rows(scores: DataFrame) -> DataFrame:
    """The matrix as sparse rows: per user the products ascending and their scores, for a catalogue of any width.

    A row is as long as the products its user met; products it lacks are 0.
    """
    cells = F.sort_array(F.collect_list(F.struct("product_id", "score")))
    return scores.groupBy("user_id").agg(cells.alias("cells")).select(
        "user_id", F.col("cells.product_id").alias("products"), F.col("cells.score").alias("scores")
    )


def interaction_profile(scores: DataFrame) -> DataFrame:
    """Size and sparsity of the matrix, from the pair table alone."""
    totals = scores.agg(
        F.sum("n_events").alias("total_logs"),
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("product_id").alias("unique_products"),
        F.count_if(F.col("score") > 0).alias("positive_cells"),
    )
    cells = F.col("unique_users") * F.col("unique_products")
    return totals.select(
        "total_logs",
        "unique_users",
        "unique_products",
        F.round(
            F.when(cells > 0, 100.0 * (cells - F.col("positive_cells")) / cells), 2
        ).alias("sparsity_pct"),
    )


def action_distribution(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("action").isNotNull()).groupBy("action").agg(
        F.count("*").alias("n_events")
    )


def user_routing(scores: DataFrame) -> DataFrame:
    """Positive products per user and the recommender that serves the user."""
    n_products = scores.agg(F.countDistinct("product_id")).scalar()
    counted = scores.groupBy("user_id").agg(
        F.count_if(F.col("score") > 0).alias("n_interacted")
    )
    return counted.select("user_id", "n_interacted", _route(n_products).alias("route"))


def _route(n_products: Column) -> Column:
    positive = F.col("n_interacted")
    return (
        F.when(positive >= n_products, "best_sellers")
        .when(positive >= C.MIN_INTERACTIONS, "factors")
        .when(positive >= 1, "similarity")
        .otherwise("best_sellers")
    )


def users_routed(scores: DataFrame, *routes: str) -> DataFrame:
    return user_routing(scores).where(F.col("route").isin(*routes)).select("user_id")


def heldout_rms(scores: DataFrame, folds: int = C.CV_FOLDS) -> DataFrame:
    """Cross-validation error of a held-out user row.

    A held-out row is all zeros when it is reconstructed, and zeros reconstruct
    to zeros, so the error of a fold is the root mean square of its positive
    scores, whatever the model. Folds without positive scores are left out.
    """
    n_users = scores.agg(F.countDistinct("user_id")).scalar()
    n_folds = F.least(F.lit(folds).cast("long"), n_users)
    per_fold = (
        scores.withColumn("n_folds", n_folds)
        .where("score > 0")
        .groupBy(
            hash_bucket(
                str(C.SEED), F.col("n_folds"), F.col("user_id").cast("string")
            ).alias("fold")
        )
        .agg(F.sqrt(F.avg(F.col("score") * F.col("score"))).alias("rms"))
    )
    return per_fold.agg(
        F.round(F.avg("rms"), 4).alias("rmse"), F.count("*").alias("folds_used")
    )
