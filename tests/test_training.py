from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cartlens import schemas
from cartlens.functions.scores import hash_bucket
from cartlens.operators import interactions as I
from cartlens.plans import training as TR
from cartlens.plans.commits import CommitLog
from cartlens.plans.snapshots import SnapshotTable, keyed_replace, recommendations_upsert
from cartlens.plans.tables import LoggedTable
from cartlens.session import scratch_path
from cartlens.sources.sample import AS_OF, sample_shop
from cartlens.sources.tables import conform, read_parquet, run_sql
from cartlens.streaming.fresh_scores import absorb_new_logs, fresh_scores

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def shop(spark):
    return sample_shop(spark, FOLDER)


@pytest.fixture(scope="module")
def trained(spark, shop):
    results = TR.Results(spark, scratch_path(spark, "results"))
    report = TR.run_all(shop, results, AS_OF).collect()
    return results, {(r.model, r.metric, r.detail): r.value for r in report}


def test_refresh_replaces_also_by_nothing(spark):
    table = SnapshotTable(spark, scratch_path(spark, "table"))
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()
    table.refresh(spark.range(5))
    assert table.read().count() == 5
    table.refresh(table.read().where("id < 2"))
    assert table.read().count() == 2
    table.refresh(spark.range(0))
    assert table.read().count() == 0 and table.read().columns == ["id"]
    assert table.versions() == [2, 3]


def test_unfinished_snapshot_is_ignored(spark):
    table = SnapshotTable(spark, scratch_path(spark, "table"))
    table.refresh(spark.range(5))
    path, files = table._files()
    files.mkdirs(path(f"{table.path}/v=2"))
    assert table.read().count() == 5


def test_keyed_replace(spark):
    rows = "user_id long, product_id long, score double, rec_type string"
    stored = spark.createDataFrame(
        [(1, 5, 1.0, "trending"), (1, 6, 1.0, "collaborative"), (2, 5, 1.0, "trending"), (3, 5, 1.0, "trending")],
        rows,
    )
    lists = spark.createDataFrame([(1, 9, 2.0, "trending")], rows)
    asked = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = recommendations_upsert(stored, lists, asked).collect()
    assert sorted((r.user_id, r.product_id, r.rec_type) for r in got) == [
        (1, 6, "collaborative"),
        (1, 9, "trending"),
        (3, 5, "trending"),
    ]
    kept = keyed_replace(stored, stored.limit(0), asked, ["user_id"])
    assert [r.user_id for r in kept.collect()] == [3]


def test_run_all_writes_every_result(trained):
    results, report = trained
    assert not [key for key in report if key[1] == "error"]
    assert results.table("association_rules").read().count() == report["association", "n_rules", None]
    users = results.table("user_segments").read()
    assert users.count() == users.select("user_id").distinct().count() == report["clustering", "total_users", None]
    predictions = results.table("repurchase_predictions").read()
    assert predictions.where("notified").count() == 0
    assert predictions.agg(F.min("predicted_date")).first()[0] >= AS_OF
    assert results.forest().stages[-1].getNumTrees == 100
    assert len(results.kmeans().clusterCenters()) == report["clustering", "n_clusters", None]
    assert report["repurchase", "r2_score", None] > 0.5
    assert report["collaborative", "n_components", None] == 24
    assert report["collaborative", "action_events", "purchase"] > 0


def test_forest_beats_the_mean(shop, trained):
    _, report = trained
    spread = report["repurchase", "mae_days", None]
    gaps = TR.R.repurchase_gaps(
        TR.R.purchase_days(TR.R.purchase_history(shop.order_items, shop.orders, shop.products))
    )
    mean = gaps.agg(F.avg("days_between")).first()[0]
    naive = gaps.agg(F.avg(F.abs(F.col("days_between") - mean))).first()[0]
    assert spread < naive


def test_reminders_are_sent_once_until_the_next_training(shop, trained):
    results, _ = trained
    before = results.table("repurchase_predictions").read()
    first = TR.send_reminders(shop, results, AS_OF)
    assert first > 0 and results.table("notifications").read().count() == first
    assert TR.send_reminders(shop, results, AS_OF) == 0
    results.table("repurchase_predictions").refresh(before.withColumn("notified", F.lit(False)))
    assert TR.send_reminders(shop, results, AS_OF) == first
    assert results.table("notifications").read().count() == 2 * first


def test_a_run_stopped_before_the_marks_sends_nothing_twice(shop, trained, monkeypatch):
    results, _ = trained
    predictions = results.table("repurchase_predictions")
    predictions.refresh(predictions.read().withColumn("notified", F.lit(False)))
    log = results.table("notifications")
    before = log.read().count() if log.exists() else 0

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as stopped:
        stopped.setattr(TR.R, "mark_notified", stop)
        with pytest.raises(RuntimeError):
            TR.send_reminders(shop, results, AS_OF)
    sent = log.read().count()
    assert sent > before
    assert TR.send_reminders(shop, results, AS_OF) == 0
    assert log.read().count() == sent
    due = TR.R.due_reminders(predictions.read(), shop.products, AS_OF)
    assert due.isEmpty()


def test_homepage_is_served_and_stored(spark, shop, trained):
    results, _ = trained
    asked = shop.users.select("user_id").limit(40)
    lists = TR.serve_homepage(shop, results, asked, 5)
    stored = results.table("product_recommendations").read()
    assert stored.count() == lists.count()
    assert set(lists.select("rec_type").distinct().toPandas()["rec_type"]) <= {"collaborative", "trending"}
    TR.serve_homepage(shop, results, asked, 3)
    again = results.table("product_recommendations").read()
    assert again.groupBy("user_id", "rec_type").count().agg(F.max("count")).first()[0] <= 3


def test_without_models_the_homepage_shows_best_sellers(spark, shop):
    results = TR.Results(spark, scratch_path(spark, "empty"))
    lists = TR.serve_homepage(shop, results, shop.users.limit(3), 4).collect()
    assert len(lists) == 12 and {r.rec_type for r in lists} == {"trending"}


def test_too_little_data_is_reported_and_touches_nothing(spark, shop):
    results = TR.Results(spark, scratch_path(spark, "small"))
    small = replace(
        shop,
        behavior=shop.behavior.limit(0),
        orders=shop.orders.limit(0),
        users=shop.users.limit(0),
    )
    report = TR.run_all(small, results, AS_OF).collect()
    assert {r.model for r in report if r.metric == "error"} == {
        "collaborative", "association", "clustering", "repurchase",
    }
    for name in ("factors", "association_rules", "customer_segments", "repurchase_predictions"):
        assert not results.table(name).exists()


def test_gates_of_small_data(spark, shop):
    small = replace(shop, orders=shop.orders.where("order_id < 30"))
    gates = {(r.model, r.requirement): r for r in TR.training_gates(small, AS_OF).collect()}
    assert gates["repurchase", "gaps"].ok is False
    assert gates["clustering", "users"].ok is True


def test_stream_ends_at_the_batch_result(spark, shop):
    folder, checkpoint = scratch_path(spark, "logs"), scratch_path(spark, "stream")
    sums = LoggedTable(CommitLog(spark, scratch_path(spark, "sums")), "sums")
    typed = conform(shop.behavior, schemas.BEHAVIOR)
    half = typed.withColumn("half", F.pmod(F.xxhash64("created_at"), F.lit(2)))
    for part in (0, 1):
        half.where(F.col("half") == part).drop("half").write.mode("append").parquet(folder)
        absorb_new_logs(spark, folder, sums, checkpoint)
        absorb_new_logs(spark, folder, sums, checkpoint)
    batch = I.interaction_scores(I.behavior_logs(read_parquet(spark, folder, schemas.BEHAVIOR)))
    rounded = [F.col("user_id"), F.col("product_id"), F.round("score", 6).alias("score"), F.col("n_events")]
    got, want = fresh_scores(sums).select(rounded), batch.select(rounded)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_sql_with_bound_parameters(spark):
    got = run_sql(spark, "select :a + 1 as x, :name as n", {"a": 2, "name": "o'k"}).first()
    assert (got.x, got.n) == (3, "o'k")


def test_hash_bucket_is_stable(spark):
    got = spark.range(3).select(hash_bucket("42", 5, F.col("id").cast("string")).alias("b")).collect()
    import hashlib

    assert [r.b for r in got] == [
        int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:8], 16) % 5 for i in range(3)
    ]
