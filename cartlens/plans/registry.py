"""Every operator as a named query over the sample tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens import constants as C
from cartlens.operators import baskets as B
from cartlens.operators import collaborative as CF
from cartlens.operators import interactions as I
from cartlens.operators import repurchase as R
from cartlens.operators import segments as S
from cartlens.plans import training as TR
from cartlens.plans import snapshots as K
from cartlens.plans.commits import CommitLog
from cartlens.plans.tables import LoggedTable, Run
from cartlens.session import cut_lineage, scratch_path, tune
from cartlens import schemas
from cartlens.sources.daily import read_daily, write_daily
from cartlens.sources.sample import AS_OF, CATALOGUE_SIZE, RECENT_SINCE, offer_scores, sample_shop
from cartlens.sources.tables import conform
from cartlens.streaming.fresh_scores import absorb_new_logs, fresh_scores

STAND_IN_CLUSTERS = 4
# Directions of the offers' matrix, and the residual left, as a share of the largest squared strength.
OFFER_RANK, OFFER_TOLERANCE = 4, 1e-5
LOG_PARTS = 3
# Users with fewer products count as having little history; the library's own limit would leave none here.
THIN_BELOW = CATALOGUE_SIZE - 1
_REGISTERED: dict[str, Callable[["Case"], DataFrame]] = {}


class Case:
    """The shop and the frames several queries share, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder
        self.shop = sample_shop(spark, folder)

    def fresh_log(self) -> CommitLog:
        return CommitLog(self.spark, scratch_path(self.spark, "log"))

    @cached_property
    def offers(self) -> DataFrame:
        return cut_lineage(offer_scores(self.spark, self.folder), "offers")

    @cached_property
    def offer_factors(self) -> CF.Factors:
        return CF.fit_reported(self.offers, OFFER_RANK, OFFER_TOLERANCE)

    @cached_property
    def logs(self) -> DataFrame:
        return I.behavior_logs(self.shop.behavior)

    @cached_property
    def scores(self) -> DataFrame:
        return I.interaction_scores(self.logs)

    @cached_property
    def stored_scores(self) -> DataFrame:
        """The scores as a written table, for queries that read them many times."""
        return cut_lineage(self.scores, "scores")

    @cached_property
    def lines(self) -> DataFrame:
        return B.order_items_delivered(self.shop.order_items, self.shop.orders)

    @cached_property
    def items(self) -> DataFrame:
        return B.basket_items(self.lines)

    @cached_property
    def stored_items(self) -> DataFrame:
        """The basket rows as a written table, for queries that read them many times."""
        return cut_lineage(self.items, "items")

    @cached_property
    def mined(self) -> B.MinedRules:
        return B.mine_rules(self.stored_items)

    @property
    def rules(self) -> DataFrame:
        return self.mined.rules

    @cached_property
    def features(self) -> DataFrame:
        return S.user_features(self.shop.users, self.shop.summary, AS_OF)

    @cached_property
    def stand_in(self) -> DataFrame:
        """Clusters by user id, to check everything after the clustering exactly."""
        return self.features.select(
            "user_id", (F.col("user_id") % STAND_IN_CLUSTERS).cast("int").alias("cluster")
        )

    @cached_property
    def labels(self) -> DataFrame:
        profile = S.cluster_profile(self.features, self.stand_in)
        return S.segment_labels(profile, STAND_IN_CLUSTERS)

    @cached_property
    def days(self) -> DataFrame:
        shop = self.shop
        return R.purchase_days(R.purchase_history(shop.order_items, shop.orders, shop.products))

    @cached_property
    def stored_days(self) -> DataFrame:
        """The purchase days as a written table, for queries that read them many times."""
        return cut_lineage(self.days, "days")

    @cached_property
    def stored_gaps(self) -> DataFrame:
        return cut_lineage(R.repurchase_gaps(self.stored_days), "gaps")

    @cached_property
    def encoder(self) -> DataFrame:
        return R.product_encoder(self.stored_gaps)

    @cached_property
    def training(self) -> DataFrame:
        return R.training_features(self.stored_gaps, self.encoder)

    @cached_property
    def serving(self) -> DataFrame:
        state = cut_lineage(R.pair_state(self.stored_days), "state")
        return R.serving_features(state, self.encoder)

    @cached_property
    def predictions(self) -> DataFrame:
        """Due dates with the mean cycle in place of the model."""
        return R.due_dates(self.serving, AS_OF, "avg_days_between", C.DEFAULT_CONFIDENCE)

    @cached_property
    def trending(self) -> DataFrame:
        return CF.trending_products(TR.delivered_lines(self.shop))

    @cached_property
    def thin_users(self) -> DataFrame:
        """Users short of two products of the catalogue: every user of these logs knows more than a few."""
        routed = I.user_routing(self.stored_scores)
        return routed.where(F.col("n_interacted") < THIN_BELOW).select("user_id")

    @cached_property
    def thin_lists(self) -> DataFrame:
        return CF.similarity_recommendations(self.stored_scores, self.thin_users, enough=THIN_BELOW)


def _query(make: Callable[[Case], DataFrame]):
    _REGISTERED[make.__name__] = make
    return make


def _plain(df: DataFrame) -> DataFrame:
    """Types any engine writes alike: six decimals, times and lists as text."""
    columns = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(F.transform(column, lambda x: x.cast("string")), ",")
        columns.append(column.alias(field.name))
    return df.select(columns)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(make):
        return lambda spark, folder: _plain(make(Case(spark, folder)))

    return {name: bind(make) for name, make in sorted(_REGISTERED.items())}


# --- behaviour ---------------------------------------------------------------


@_query
def behavior_logs(case):
    return case.logs


@_query
def behavior_logs_since(case):
    return I.behavior_logs(case.shop.behavior, RECENT_SINCE)


@_query
def daily_logs_since(case):
    """The same days out of logs that are laid out by day."""
    folder = scratch_path(case.spark, "daily")
    write_daily(conform(case.shop.behavior, schemas.BEHAVIOR), folder)
    return I.behavior_logs(read_daily(case.spark, folder, RECENT_SINCE))


@_query
def interaction_scores(case):
    return case.scores


@_query
def interaction_matrix(case):
    return I.interaction_matrix(case.scores, list(range(CATALOGUE_SIZE)))


@_query
def interaction_rows(case):
    """Sparse rows; the sums by place show that scores stand at their products."""
    rows = I.interaction_rows(case.scores)
    by_place = F.aggregate(
        F.zip_with("products", "scores", lambda p, s: (p + 1) * s), F.lit(0.0), lambda a, b: a + b
    )
    return rows.select("user_id", "products", F.size("products").alias("n_products"), by_place.alias("by_product"))


@_query
def interaction_profile(case):
    return I.interaction_profile(case.scores)


@_query
def action_distribution(case):
    return I.action_distribution(case.logs)


@_query
def user_routing(case):
    return I.user_routing(case.stored_scores)


@_query
def heldout_rms(case):
    return I.heldout_rms(case.stored_scores)


# --- baskets -----------------------------------------------------------------


@_query
def order_items_delivered(case):
    return case.lines


@_query
def baskets(case):
    return B.baskets(case.items)


@_query
def basket_profile(case):
    return B.basket_profile(case.items)


@_query
def frequent_items(case):
    return B.frequent_items(case.stored_items)


@_query
def frequent_pairs(case):
    return B.frequent_pairs(case.stored_items)


@_query
def association_rules(case):
    return case.rules


@_query
def rules_profile(case):
    return B.rules_profile(case.mined)


@_query
def rules_refresh(case):
    """Refresh the stored rules twice; the second snapshot is what readers get."""
    table = K.SnapshotTable(case.spark, scratch_path(case.spark, "rules"))
    table.refresh(case.rules.limit(0))
    return table.refresh(case.rules)


@_query
def fpgrowth_itemsets(case):
    return B.frequent_itemsets(case.stored_items)


@_query
def associated_products(case):
    return B.associated_products(case.rules)


@_query
def product_recommendations(case):
    return B.product_recommendations(case.rules)


@_query
def trending_products(case):
    return case.trending


# --- collaborative filtering -------------------------------------------------


@_query
def item_similarity(case):
    return CF.item_similarity(case.stored_scores)


@_query
def item_based_recommendations(case):
    return case.thin_lists


@_query
def svd_factors(case):
    return CF.tall_factors(CF.fit_factors(case.stored_scores))


@_query
def svd_recommendations(case):
    return CF.factor_recommendations(case.stored_scores, CF.fit_factors(case.stored_scores))


@_query
def svd_cell_rmse(case):
    return CF.cell_split_rmse(case.stored_scores, rank=8)


@_query
def offer_strengths(case):
    """Leading strengths of customers by thousands of offers, each with its residual within the tolerance."""
    report = case.offer_factors.report
    return report.select("component", F.round("strength", 3).alias("strength"), (F.col("residual") <= OFFER_TOLERANCE).alias("found"))


@_query
def offer_recommendations(case):
    """Lists out of thousands of offers, most of which are never scored."""
    return CF.factor_recommendations(case.offers, case.offer_factors.table)


@_query
def homepage_recommendations(case):
    scores = case.stored_scores
    return CF.homepage_recommendations(
        case.shop.users, scores, case.trending, CF.fit_factors(scores)
    )


@_query
def homepage_thin_users(case):
    """Homepage lists of users with little history and of customers never seen in the logs."""
    known = case.stored_scores.select("user_id").distinct()
    strangers = case.shop.users.select("user_id").join(known, "user_id", "left_anti")
    users = case.thin_users.unionAll(strangers)
    lists = CF.similarity_recommendations(case.stored_scores, users, enough=THIN_BELOW)
    return CF.with_best_sellers(users, lists, case.trending)


def _stored_lists(case):
    return case.stored_scores.select(
        "user_id",
        "product_id",
        "score",
        F.when(F.col("score") > 5, "collaborative").otherwise("trending").alias("rec_type"),
    )


@_query
def recommendations_upsert(case):
    lists = CF.with_best_sellers(case.thin_users, case.thin_lists, case.trending)
    return K.recommendations_upsert(_stored_lists(case), lists, case.thin_users)


@_query
def recommendations_stored(case):
    """The same change of stored lists, written as a delta of its keys and merged on read."""
    lists = cut_lineage(CF.with_best_sellers(case.thin_users, case.thin_lists, case.trending), "served")
    table = LoggedTable(case.fresh_log(), "product_recommendations")
    table.refresh(_stored_lists(case), ["user_id", "rec_type"], buckets=16)
    table.upsert(*K.served_lists(lists, case.thin_users))
    return table.read()


# --- segments ----------------------------------------------------------------


@_query
def user_features(case):
    return case.features


@_query
def user_feature_profile(case):
    return S.user_feature_profile(case.features)


@_query
def scaled_features(case):
    return S.scaled_features(case.features)


@_query
def cluster_profile(case):
    return S.cluster_profile(case.features, case.stand_in)


@_query
def segment_labels(case):
    return case.labels


@_query
def segment_rollup(case):
    return S.segment_rollup(case.labels, S.user_segments(case.stand_in))


@_query
def segments_committed(case):
    """Segments and members of one run, committed together after an earlier run, read from one commit."""
    log = case.fresh_log()
    for members in (case.stand_in.limit(0), case.stand_in):
        run = Run(log)
        run.replace("customer_segments", case.labels.drop("code"))
        run.replace("user_segments", S.user_segments(members), ["user_id"], buckets=16)
        run.commit()
    state = log.current()
    tables = [LoggedTable(log, name, state).read() for name in ("customer_segments", "user_segments")]
    return S.segment_rollup(*tables)


@_query
def user_segment_lookup(case):
    return S.user_segment_lookup(case.shop.users, S.user_segments(case.stand_in), case.labels)


@_query
def user_segments(case):
    return S.user_segments(S.fit_clusters(case.features).assignment)


@_query
def silhouette_sweep(case):
    fitted = S.fit_clusters(case.features)
    return case.spark.createDataFrame(
        [(k, score, k == fitted.k) for k, score in fitted.sweep],
        "k int, silhouette double, chosen boolean",
    )


# --- repurchase --------------------------------------------------------------


@_query
def repurchase_gaps(case):
    return R.repurchase_gaps(case.days)


@_query
def repurchase_gap_profile(case):
    return R.gap_profile(case.stored_gaps)


@_query
def repurchase_pair_state(case):
    return R.pair_state(case.days).drop("avg_days_between")


@_query
def repurchase_cycles(case):
    return R.repurchase_cycles(case.days)


@_query
def product_encoder(case):
    return case.encoder


@_query
def repurchase_training_features(case):
    return case.training


@_query
def repurchase_split(case):
    return R.split_rows(case.training).select(*R.PAIR, *R.LINE_KEY, "is_test")


@_query
def repurchase_serving_features(case):
    return case.serving


@_query
def repurchase_model_metrics(case):
    return TR.evaluate_forest(case.training)[1]


@_query
def repurchase_predictions(case):
    model, metrics = TR.evaluate_forest(case.training)
    confidence = metrics.first()["confidence"]
    return R.due_dates(model.transform(case.serving), AS_OF, "prediction", confidence)


@_query
def repurchase_forest_depths(case):
    return TR.compare_depths(case.training)


@_query
def repurchase_full_predictions(case):
    predicted, confidence = TR.full_forest_days(case.training, case.serving)
    return R.due_dates(predicted, AS_OF, "prediction", confidence)


@_query
def repurchase_due_dates(case):
    return case.predictions


@_query
def upcoming_repurchases(case):
    return R.upcoming_repurchases(case.predictions, case.shop.products, AS_OF)


@_query
def repurchase_notifications(case):
    return R.notifications(R.due_reminders(case.predictions, case.shop.products, AS_OF))


@_query
def predictions_marked(case):
    due = R.due_reminders(case.predictions, case.shop.products, AS_OF)
    return R.mark_notified(case.predictions, due)


@_query
def predictions_marked_in_place(case):
    """Marks written for the predictions due alone, and merged on read."""
    table = LoggedTable(case.fresh_log(), "repurchase_predictions")
    current = table.refresh(case.predictions, R.PAIR, buckets=16)
    due = cut_lineage(R.due_reminders(current, case.shop.products, AS_OF), "due")
    table.upsert(R.mark_notified(due.select(current.columns), due), due.select(R.PAIR), table.generation())
    return table.read()


# --- streaming ---------------------------------------------------------------


@_query
def streamed_scores(case):
    """Interaction scores kept fresh by a stream over the whole log, arriving in parts."""
    logs, sums = scratch_path(case.spark, "logs"), LoggedTable(case.fresh_log(), "sums")
    conform(case.shop.behavior, schemas.BEHAVIOR).repartition(LOG_PARTS).write.parquet(logs)
    absorb_new_logs(case.spark, logs, sums, scratch_path(case.spark, "stream"), files_per_batch=1)
    return fresh_scores(sums)


# --- training ----------------------------------------------------------------


@_query
def training_gates(case):
    return TR.training_gates(case.shop, AS_OF)


@_query
def training_report(case):
    results = TR.Results(case.spark, scratch_path(case.spark, "results"))
    return TR.run_all(case.shop, results, AS_OF)
