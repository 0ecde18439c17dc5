import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartlens import schemas
from cartlens.operators import repurchase as R

AS_OF = dt.date(2024, 6, 30)
D = dt.datetime


def shop(spark, purchases, products=((1, "food", True, 100.0),)):
    """Purchases as (user, product, time[, quantity[, order id]]), one line each."""
    orders, items = {}, []
    for n, (user, product, when, *more) in enumerate(purchases):
        quantity = more[0] if more else 1.0
        order = more[1] if len(more) > 1 else n
        orders[order] = (order, user, "delivered", 1.0, when)
        items.append((order, n, product, float(quantity), n, 0))
    return (
        spark.createDataFrame(items, schemas.ORDER_ITEMS),
        spark.createDataFrame(list(orders.values()), schemas.ORDERS),
        spark.createDataFrame(list(products), schemas.PRODUCTS),
    )


def days_of(spark, purchases, **more):
    return R.purchase_days(R.purchase_history(*shop(spark, purchases, **more)))


def gaps_of(spark, purchases, **more):
    rows = R.repurchase_gaps(days_of(spark, purchases, **more)).collect()
    return sorted((r.user_id, r.product_id, r.days_between, r.quantity) for r in rows)


def cycles_of(spark, purchases):
    rows = R.repurchase_cycles(days_of(spark, purchases)).collect()
    return {(r.user_id, r.product_id): r.avg_days_between for r in rows}


def test_gap_counts_whole_days_not_midnights(spark):
    late, early = D(2024, 1, 1, 23), D(2024, 1, 2, 1)
    assert gaps_of(spark, [(1, 1, late), (1, 1, early)]) == []
    assert cycles_of(spark, [(1, 1, late), (1, 1, early)]) == {(1, 1): 0.0}
    assert gaps_of(spark, [(1, 1, late), (1, 1, D(2024, 1, 2, 23))]) == [(1, 1, 1, 1.0)]
    assert gaps_of(spark, [(1, 1, late), (1, 1, D(2024, 1, 3, 22))]) == [(1, 1, 1, 1.0)]


def test_clock_changes_of_the_session_zone_do_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        night = [(1, 1, D(2024, 3, 9, 2, 45)), (1, 1, D(2024, 3, 10, 2, 30)), (1, 1, D(2024, 3, 11, 2, 30))]
        assert [g[2] for g in gaps_of(spark, night)] == [1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_training_keeps_1_to_365_and_serving_uses_all(spark):
    start = D(2020, 1, 1)
    purchases = []
    for user, gap in enumerate((0, 1, 365, 366)):
        purchases += [(user, 1, start), (user, 1, start + dt.timedelta(days=gap))]
    assert [g[2] for g in gaps_of(spark, purchases)] == [1, 365]
    assert cycles_of(spark, purchases) == {(0, 1): 0, (1, 1): 1, (2, 1): 365, (3, 1): 366}


def test_same_time_lines_give_one_positive_gap_by_line_key(spark):
    purchases = [
        (1, 1, D(2024, 1, 1), 1, 50),
        (1, 1, D(2024, 1, 1), 9, 50),
        (1, 1, D(2024, 1, 11), 4, 60),
        (1, 1, D(2024, 1, 11), 7, 60),
    ]
    assert gaps_of(spark, purchases) == [(1, 1, 10, 4.0)]
    assert cycles_of(spark, purchases) == {(1, 1): pytest.approx(10 / 3)}


def test_gaps_match_a_plain_lag_over_all_lines(spark):
    """The day table gives the gaps of a line-by-line lag, on times within days too."""
    import numpy as np
    from pyspark.sql import Window

    rng = np.random.default_rng(2)
    start = D(2023, 1, 1)
    purchases = [
        (int(u), 1, start + dt.timedelta(hours=int(h)), int(q))
        for u, h, q in zip(rng.integers(0, 5, 400), rng.integers(0, 24 * 700, 400), rng.integers(1, 9, 400))
    ]
    history = R.purchase_history(*shop(spark, purchases))
    order = Window.partitionBy(*R.PAIR).orderBy("order_date", *R.LINE_KEY)
    plain = history.withColumn(
        "gap", F.timestamp_diff("DAY", F.lag("order_date").over(order), F.col("order_date"))
    ).where("gap between 1 and 365")
    expected = sorted((r.user_id, r.product_id, r.gap, r.quantity) for r in plain.collect())
    assert gaps_of(spark, purchases) == expected
    means = plain.sparkSession.createDataFrame(
        history.withColumn("gap", F.timestamp_diff("DAY", F.lag("order_date").over(order), F.col("order_date")))
        .groupBy(*R.PAIR).agg(F.avg("gap").alias("m")).collect()
    )
    assert cycles_of(spark, purchases) == pytest.approx(
        {(r.user_id, r.product_id): r.m for r in means.collect()}
    )


def test_only_consumables_and_delivered(spark):
    products = [(1, "food", True, 1.0), (2, "toy", False, 1.0)]
    purchases = [(1, 2, D(2024, 1, 1)), (1, 2, D(2024, 2, 1))]
    assert gaps_of(spark, purchases, products=products) == []


def test_weights_are_filled_by_two_different_medians(spark):
    products = [(1, "a", True, 10.0), (2, "b", True, 30.0), (3, "c", True, None)]
    start = D(2024, 1, 1)
    step = [start + dt.timedelta(days=10 * i) for i in range(6)]
    purchases = [(1, 1, t) for t in step] + [(1, 3, t) for t in step[:2]]
    purchases += [(u, 2, t) for u in (1, 2) for t in step[:2]]
    days = days_of(spark, purchases, products=products)
    gaps = R.repurchase_gaps(days)
    encoder = R.product_encoder(gaps)
    trained = {r.product_id: r.weight_gram for r in R.training_features(gaps, encoder).collect()}
    served = {r.product_id: r.weight_gram for r in R.serving_features(R.pair_state(days), encoder).collect()}
    assert trained[3] == 10.0  # rows: 10 five times, 30 twice
    assert served[3] == 30.0  # pairs: 10 once, 30 twice


def test_no_weight_at_all_becomes_zero(spark):
    purchases = [(1, 1, D(2024, 1, 1)), (1, 1, D(2024, 1, 9))]
    days = days_of(spark, purchases, products=[(1, "a", True, None)])
    gaps = R.repurchase_gaps(days)
    assert R.training_features(gaps, R.product_encoder(gaps)).first().weight_gram == 0.0


def test_bought_once_gets_the_fallback_and_unknown_products_drop(spark):
    products = [(1, "a", True, 1.0), (2, "b", True, 1.0)]
    purchases = [(1, 1, D(2024, 1, 1)), (1, 1, D(2024, 1, 9)), (2, 1, D(2024, 1, 1)), (2, 2, D(2024, 1, 1))]
    days = days_of(spark, purchases, products=products)
    encoder = R.product_encoder(R.repurchase_gaps(days))
    rows = R.serving_features(R.pair_state(days), encoder).collect()
    assert {(r.user_id, r.product_id): r.avg_days_between for r in rows} == {(1, 1): 8.0, (2, 1): 30.0}


def test_leave_one_out_cycle(spark):
    purchases = [(1, 1, D(2024, 1, 1)), (1, 1, D(2024, 1, 11)), (1, 1, D(2024, 1, 31))]
    gaps = R.repurchase_gaps(days_of(spark, purchases))
    encoder = R.product_encoder(gaps)
    own = {r.days_between: r.avg_days_between for r in R.training_features(gaps, encoder).collect()}
    other = {r.days_between: r.avg_days_between for r in R.training_features(gaps, encoder, True).collect()}
    assert own == {10: 15.0, 20: 15.0} and other == {10: 20.0, 20: 10.0}


def due(spark, rows):
    frame = spark.createDataFrame(
        [(n, 1, D.combine(AS_OF, dt.time(0)) - dt.timedelta(days=back), float(d)) for n, (back, d) in enumerate(rows)],
        "user_id long, product_id long, last_purchase timestamp_ntz, days double",
    )
    got = R.due_dates(frame, AS_OF, "days", 0.75).orderBy("user_id").collect()
    return [(r.predicted_date - AS_OF).days for r in got]


def test_overdue_dates_roll_forward_by_whole_cycles(spark):
    assert due(spark, [(10, 10), (10, 5), (10, 4), (10, 3)]) == [0, 5, 2, 2]


def test_predicted_days_are_cut_and_at_least_one(spark):
    assert due(spark, [(0, 0.4), (0, 13.99), (0, -5)]) == [1, 13, 1]


def test_rolled_dates_lie_within_one_cycle(spark):
    rows = [(back, cycle) for back in range(0, 60, 7) for cycle in (1, 2, 3, 9, 40)]
    for (back, cycle), ahead in zip(rows, due(spark, rows)):
        assert 0 <= ahead <= cycle


def predictions(spark, rows):
    return spark.createDataFrame(
        [(u, 1, AS_OF + dt.timedelta(days=a), 0.5, n) for u, a, n in rows], schemas.PREDICTIONS
    )


def test_windows_include_both_ends(spark):
    products = spark.createDataFrame([(1, "food", True, 1.0)], schemas.PRODUCTS)
    rows = predictions(spark, [(1, 0, False), (2, 3, False), (3, 4, False), (4, 1, True), (5, -1, False)])
    soon = R.upcoming_repurchases(rows, products, AS_OF, 3).collect()
    assert sorted(r.user_id for r in soon) == [1, 2, 4]
    assert [r.user_id for r in R.upcoming_repurchases(rows, products, AS_OF, 3, user_id=2).collect()] == [2]
    reminded = R.due_reminders(rows, products, AS_OF, 3)
    assert sorted(r.user_id for r in reminded.collect()) == [1, 2]
    marked = R.mark_notified(rows, reminded).collect()
    assert {r.user_id: r.notified for r in marked} == {1: True, 2: True, 3: False, 4: True, 5: False}
    with pytest.raises(ValueError):
        R.upcoming_repurchases(rows, products, AS_OF, 31)


def test_reminder_text(spark):
    products = spark.createDataFrame([(1, "cat's food", True, 1.0)], schemas.PRODUCTS)
    row = R.notifications(R.due_reminders(predictions(spark, [(8, 2, False)]), products, AS_OF)).first()
    assert (row.user_id, row.type, row.title, row.ref_id) == (8, "repurchase_reminder", "Nhắc mua lại sản phẩm", 1)
    assert row.message == (
        "Sản phẩm 'cat's food' của bạn sắp hết. Dự kiến bạn cần mua lại vào ngày 2024-07-02."
    )


@pytest.mark.parametrize(
    "errors, confidence", [([10, -10, 10, -10], 0.3), ([0, 0, 0, 0], 0.95), ([6, -6, 6, -6], 0.64)]
)
def test_confidence_is_a_clipped_r2(spark, errors, confidence):
    truth = [0, 0, 20, 20]
    frame = spark.createDataFrame(
        [(float(t), float(t + e)) for t, e in zip(truth, errors)], "days_between double, prediction double"
    )
    assert R.model_metrics(frame).first().confidence == pytest.approx(confidence)


def test_confidence_of_a_constant_target_is_the_floor(spark):
    frame = spark.createDataFrame([(5.0, 6.0)], "days_between double, prediction double")
    assert R.model_metrics(frame).first().confidence == 0.3
