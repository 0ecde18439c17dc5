"""Training runs, their reports, and the jobs that serve from stored results."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens import constants as C
from cartlens.operators import baskets as B
from cartlens.operators import collaborative as CF
from cartlens.operators import forest as FO
from cartlens.operators import interactions as I
from cartlens.operators import repurchase as R
from cartlens.operators import segments as S
from cartlens.plans.commits import CommitLog, Conflict, State
from cartlens.plans.snapshots import served_lists
from cartlens.plans.tables import LoggedTable, Run
from cartlens.session import cut_lineage, in_few_parts
from cartlens.sources.sample import Shop

REPORT_SCHEMA = "model string, metric string, value double, detail string"


class Results:
    """The result tables and saved models below one folder, changed by commits to one log."""

    def __init__(self, spark: SparkSession, folder: str, state: State | None = None):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.log = CommitLog(spark, self.folder)
        self.state = state

    def pinned(self) -> Results:
        """The same results as of now: tables and models read from it belong to one commit."""
        return Results(self.spark, self.folder, self.log.current())

    def table(self, name: str) -> LoggedTable:
        return LoggedTable(self.log, name, self.state)

    def read_or_none(self, name: str) -> DataFrame | None:
        table = self.table(name)
        return table.read() if table.exists() else None

    def begin(self) -> Run:
        return Run(self.log)

    def model_path(self, name: str) -> str:
        found = (self.state or self.log.current()).models.get(name)
        if found is None:
            raise FileNotFoundError(f"no committed model {name} below {self.folder}")
        return found

    def forest(self) -> PipelineModel:
        return PipelineModel.load(self.model_path("forest"))

    def kmeans(self) -> KMeansModel:
        return KMeansModel.load(self.model_path("kmeans"))


def _checks(counts: DataFrame, model: str, required: dict[str, int]) -> DataFrame:
    tall = counts.unpivot([], list(required), "requirement", "observed")
    limit = F.lit(None).cast("long")
    for name, least in required.items():
        limit = F.when(F.col("requirement") == name, F.lit(least).cast("long")).otherwise(limit)
    return tall.select(
        F.lit(model).alias("model"),
        "requirement",
        "observed",
        limit.alias("required"),
        (F.col("observed") >= limit).alias("ok"),
    )


def training_gates(shop: Shop, as_of: dt.date) -> DataFrame:
    """What each training run needs at least, and what the data holds."""
    scores = I.interaction_scores(I.behavior_logs(shop.behavior))
    matrix = scores.agg(
        F.coalesce(F.sum("n_events"), F.lit(0)).alias("logs"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("product_id").alias("products"),
    )
    lines = B.order_items_delivered(shop.order_items, shop.orders)
    n_baskets = lines.agg(F.countDistinct("order_id").alias("baskets"))
    customers = S.user_features(shop.users, shop.summary, as_of).agg(F.count("*").alias("users"))
    history = R.purchase_history(shop.order_items, shop.orders, shop.products)
    gaps = R.repurchase_gaps(R.purchase_days(history)).agg(F.count("*").alias("gaps"))
    side = C.MIN_MATRIX_SIDE
    return reduce(
        DataFrame.unionAll,
        [
            _checks(matrix, "collaborative", {"logs": 1, "users": side, "products": side}),
            _checks(n_baskets, "association", {"baskets": C.MIN_BASKETS}),
            _checks(customers, "clustering", {"users": C.MIN_SEGMENT_USERS}),
            _checks(gaps, "repurchase", {"gaps": C.MIN_GAPS}),
        ],
    )


class TooLittleData(Exception):
    """A training run stopped before it touched any result."""


def _require(observed: int, least: int, what: str) -> None:
    if observed < least:
        raise TooLittleData(f"{observed} {what}, at least {least} needed")


def _tall(row: DataFrame, model: str) -> DataFrame:
    """One-row metrics as report rows."""
    doubles = row.select([F.col(name).cast("double").alias(name) for name in row.columns])
    return doubles.unpivot([], row.columns, "metric", "value").select(
        F.lit(model).alias("model"), "metric", "value", F.lit(None).cast("string").alias("detail")
    )


def _rows(spark: SparkSession, model: str, **values) -> DataFrame:
    rows = []
    for name, value in values.items():
        text = isinstance(value, str)
        number = None if text or value is None else float(value)
        rows.append((model, name, number, value if text else None))
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def train_collaborative(shop: Shop, results: Results) -> DataFrame:
    """Score matrix and factors; returns the report."""
    logs = I.behavior_logs(shop.behavior)
    scores = cut_lineage(I.interaction_scores(logs))
    n_users, n_products = CF.matrix_shape(scores)
    _require(n_users, 1, "logs")
    _require(min(n_users, n_products), C.MIN_MATRIX_SIDE, "users or products")
    fitted = CF.fit_reported(scores)
    run = results.begin()
    run.replace("factors", fitted.table)
    run.replace("interaction_scores", scores)
    run.commit()
    worst = fitted.report.agg(F.max("residual")).first()[0]
    actions = I.action_distribution(logs).select(
        F.lit("collaborative").alias("model"),
        F.lit("action_events").alias("metric"),
        F.col("n_events").cast("double").alias("value"),
        F.col("action").alias("detail"),
    )
    return (
        _tall(I.interaction_profile(scores), "collaborative")
        .unionAll(actions)
        .unionAll(_tall(I.heldout_rms(scores), "collaborative"))
        .unionAll(
            _rows(
                results.spark,
                "collaborative",
                n_components=CF.default_rank(n_users, n_products),
                worst_residual=worst,
                n_users=n_users,
                n_products=n_products,
            )
        )
    )


def train_association(shop: Shop, results: Results) -> DataFrame:
    """Rule table; returns the report."""
    lines = B.order_items_delivered(shop.order_items, shop.orders)
    items = cut_lineage(B.basket_items(lines))
    profile = B.basket_profile(items)
    _require(profile.first()["total_orders"], C.MIN_BASKETS, "baskets")
    mined = B.mine_rules(items)
    run = results.begin()
    rules = run.replace("association_rules", mined.rules)
    run.commit()
    return (
        _tall(profile, "association")
        .unionAll(_tall(B.rules_profile(mined._replace(rules=rules)), "association"))
        .unionAll(
            _rows(
                results.spark,
                "association",
                min_support=C.MIN_SUPPORT,
                min_confidence=C.MIN_CONFIDENCE,
                min_lift=C.MIN_LIFT,
            )
        )
    )


def train_clustering(
    shop: Shop,
    results: Results,
    as_of: dt.date,
    n_clusters: int | None = None,
    restarts: int = C.KMEANS_RESTARTS,
) -> DataFrame:
    """Clusters, named segments and membership; returns the report."""
    features = cut_lineage(S.user_features(shop.users, shop.summary, as_of))
    n_users = features.count()
    _require(n_users, C.MIN_SEGMENT_USERS, "users")
    fitted = S.fit_clusters(features, n_clusters, restarts)
    assignment = cut_lineage(fitted.assignment)
    labels = S.segment_labels(S.cluster_profile(features, assignment), fitted.k)
    run = results.begin()
    run.replace("scaler_stats", fitted.stats)
    if fitted.model is not None:
        run.save_model("kmeans", fitted.model)
    membership = run.replace("user_segments", S.user_segments(assignment))
    segments = run.replace("customer_segments", labels.drop("code"))
    run.commit()
    stats = S.user_feature_profile(features).unpivot(
        ["feature"], ["mean", "min", "max"], "stat", "value"
    )
    sizes = S.segment_rollup(segments, membership)
    return (
        _rows(
            results.spark,
            "clustering",
            total_users=n_users,
            n_clusters=fitted.k,
            silhouette_score=None if fitted.silhouette is None else round(fitted.silhouette, 4),
        )
        .unionAll(
            stats.select(
                F.lit("clustering"), F.concat_ws("_", "stat", "feature"), "value", F.lit(None)
            )
        )
        .unionAll(
            sizes.select(
                F.lit("clustering"),
                F.concat(F.lit("segment_"), F.col("segment_id").cast("string")),
                F.col("user_count").cast("double"),
                "name",
            )
        )
    )


def train_repurchase(shop: Shop, results: Results, as_of: dt.date, **forest) -> DataFrame:
    """Forest, its metrics and the due date of every known pair; returns the report."""
    history = R.purchase_history(shop.order_items, shop.orders, shop.products)
    days = cut_lineage(R.purchase_days(history))
    gaps = cut_lineage(R.repurchase_gaps(days))
    n_gaps = gaps.count()
    _require(n_gaps, C.MIN_GAPS, "gaps")
    encoder = cut_lineage(R.product_encoder(gaps))
    model, metrics = evaluate_forest(R.training_features(gaps, encoder), **forest)
    quality = metrics.first()
    run = results.begin()
    run.save_model("forest", model)
    run.replace("product_encoder", encoder)
    served = R.serving_features(R.pair_state(days), encoder)
    run.replace(
        "repurchase_predictions",
        R.due_dates(model.transform(served), as_of, "prediction", quality["confidence"]),
        R.PAIR,
    )
    run.commit()
    weights = gaps.agg(F.count("weight_gram").alias("rows_with_weight"))
    return (
        _tall(R.gap_profile(gaps), "repurchase")
        .unionAll(_tall(metrics, "repurchase"))
        .unionAll(_tall(weights, "repurchase"))
    )


def evaluate_forest(features: DataFrame, **forest) -> tuple[PipelineModel, DataFrame]:
    """Fit on four fifths of the rows, measure on the rest."""
    # Every step of the forest sends the sums of all its nodes once a part.
    rows = in_few_parts(R.split_rows(features).persist(), [*R.LINE_KEY, *R.PAIR])
    model = R.fit_forest(rows.where(~F.col("is_test")), **forest)
    spark = features.sparkSession
    scored = R.model_metrics(model.transform(rows.where("is_test")))
    metrics = spark.createDataFrame([scored.first()], scored.schema)
    rows.unpersist()
    return model, metrics


def fit_full(train: DataFrame, max_depth: int | None = None, trees: int = C.FOREST_TREES) -> FO.Forest:
    """Forest of trees as deep as the rows allow, drawn by line key; its trees are a table."""
    return FO.fit_full_forest(train, R.MODEL_FEATURES, "days_between", R.LINE_KEY, trees, C.SEED, max_depth)


def compare_depths(features: DataFrame, depths: tuple = (10, 30, None), trees: int = C.FOREST_TREES) -> DataFrame:
    """``depth, mae_days, r2_score, n_test, confidence`` on the test rows, for each bound on depth and none (null)."""
    rows = cut_lineage(R.split_rows(features), "split")
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    found = [
        R.model_metrics(FO.predict(fit_full(train, depth, trees), test)).select(F.lit(depth).cast("int").alias("depth"), "*")
        for depth in depths
    ]
    return reduce(DataFrame.unionAll, found)


def full_forest_days(features: DataFrame, serving: DataFrame, trees: int = C.FOREST_TREES) -> tuple[DataFrame, float]:
    """``serving`` with the days a full-grown forest predicts, and the confidence measured on the test rows."""
    rows = cut_lineage(R.split_rows(features), "split")
    forest = fit_full(rows.where(~F.col("is_test")), trees=trees)
    confidence = R.model_metrics(FO.predict(forest, rows.where("is_test"))).first()["confidence"]
    return FO.predict(forest, serving), confidence


def run_all(
    shop: Shop,
    results: Results,
    as_of: dt.date,
    models: tuple = ("collaborative", "association", "clustering", "repurchase"),
) -> DataFrame:
    """Train in order; a run that fails is reported and does not stop the next."""
    runs = {
        "collaborative": lambda: train_collaborative(shop, results),
        "association": lambda: train_association(shop, results),
        "clustering": lambda: train_clustering(shop, results, as_of),
        "repurchase": lambda: train_repurchase(shop, results, as_of),
    }
    reports = []
    for name in models:
        try:
            reports.append(runs[name]())
        except Exception as problem:
            reports.append(_rows(results.spark, name, error=f"{type(problem).__name__}: {problem}"))
    return reduce(DataFrame.unionAll, reports)


def send_reminders(
    shop: Shop, results: Results, as_of: dt.date, days_ahead: int = C.REMINDER_DAYS_AHEAD
) -> int:
    """Append the reminders due, then mark their predictions; returns how many were appended.

    Reminders carry the commit that made the predictions. A run stopped in between leaves reminders
    without marks; the next one finds them under the same number, sends none twice and marks them. Marks are
    written for the predictions due, not for the table; a training that replaces it meanwhile keeps its own.
    """
    predictions, log = results.pinned().table("repurchase_predictions"), results.table("notifications")
    version, current = predictions.generation(), predictions.read()
    due = cut_lineage(R.due_reminders(current, shop.products, as_of, days_ahead))
    if due.isEmpty():
        return 0
    reminders = R.notifications(due).withColumn("predictions_version", F.lit(version).cast("long"))
    if log.exists():
        reminders = cut_lineage(R.unsent(reminders, log.read()))
    sent = reminders.count()
    if sent:
        log.append(reminders)
    marked = R.mark_notified(due.select(current.columns), due)
    try:
        results.table("repurchase_predictions").upsert(marked, due.select(R.PAIR), version)
    except Conflict:
        pass  # the new predictions have not been looked at yet
    return sent


def serve_homepage(
    shop: Shop, results: Results, requested: DataFrame, top_n: int = C.HOMEPAGE_TOP_N
) -> DataFrame:
    """Lists for the requested users, also stored; best sellers while no model is saved.

    Scores and factors are those of one commit. The lists of the requested users are written, not the table.
    """
    found = results.pinned()
    scores, factors = found.read_or_none("interaction_scores"), found.read_or_none("factors")
    sold = delivered_lines(shop)
    lists = cut_lineage(
        CF.homepage_recommendations(
            requested, scores, CF.trending_products(sold, top_n), factors, top_n
        )
    )
    new, touched = served_lists(lists, requested)
    table = results.table("product_recommendations")
    if table.exists():
        table.upsert(new, touched)
    else:
        table.refresh(new, ["user_id", "rec_type"])
    return lists


def delivered_lines(shop: Shop) -> DataFrame:
    """Product and quantity of every delivered line."""
    return shop.order_items.select("order_id", "product_id", "quantity").join(
        B.delivered(shop.orders).select("order_id"), "order_id"
    )
