import datetime as dt

import pytest

from cartlens import schemas
from cartlens.operators import interactions as I

AT = dt.datetime(2024, 1, 1)


def logs(spark, rows):
    full = [(u, p, a, d, AT if len(r) == 0 else r[0]) for u, p, a, d, *r in rows]
    return I.behavior_logs(spark.createDataFrame(full, schemas.BEHAVIOR))


def scores(spark, rows):
    found = I.interaction_scores(logs(spark, rows)).collect()
    return {(r.user_id, r.product_id): r.score for r in found}


def test_every_action(spark):
    actions = ["view", "search", "wishlist", "add_to_cart", "remove_from_cart", "purchase", "odd", None]
    got = scores(spark, [(1, i, a, 0.0) for i, a in enumerate(actions)])
    assert [got[1, i] for i in range(8)] == [1, 1, 2, 3, 0, 5, 0, 0]


def test_action_case_does_not_matter(spark):
    assert scores(spark, [(1, 1, "Purchase", 0.0)]) == {(1, 1): 5.0}


def test_dwell_bonus_on_an_unknown_action(spark):
    times = [None, 0.0, 15.0, 30.0, 300.0, 9999.0]
    got = scores(spark, [(1, i, "odd", t) for i, t in enumerate(times)])
    assert [got[1, i] for i in range(6)] == pytest.approx([0, 0, 0.05, 0.1, 1.0, 1.0])


def test_clip_comes_after_the_sum(spark):
    rows = [(1, 1, "purchase", 0.0), (1, 1, "remove_from_cart", 0.0), (1, 1, "remove_from_cart", 0.0)]
    assert scores(spark, rows) == {(1, 1): 3.0}


def test_missing_ids_are_dropped(spark):
    assert scores(spark, [(None, 1, "view", 0.0), (1, None, "view", 0.0)]) == {}


def test_lower_bound_is_inclusive(spark):
    rows = [(1, i, "view", 0.0, AT + dt.timedelta(seconds=i)) for i in range(3)]
    frame = spark.createDataFrame(rows, schemas.BEHAVIOR)
    kept = I.behavior_logs(frame, AT + dt.timedelta(seconds=1)).collect()
    assert sorted(r.product_id for r in kept) == [1, 2]


def test_routing_limits(spark):
    rows = [(u, p, "view", 0.0) for u, n in ((1, 4), (2, 5), (3, 8)) for p in range(n)]
    rows += [(4, 0, "remove_from_cart", 0.0)]
    frame = I.interaction_scores(logs(spark, rows))
    routes = {r.user_id: (r.n_interacted, r.route) for r in I.user_routing(frame).collect()}
    assert routes == {
        1: (4, "similarity"),
        2: (5, "factors"),
        3: (8, "best_sellers"),
        4: (0, "best_sellers"),
    }


def test_profile_counts_clipped_cells_as_empty(spark):
    frame = I.interaction_scores(
        logs(spark, [(1, 1, "view", 0.0), (2, 2, "view", 0.0), (2, 1, "remove_from_cart", 0.0)])
    )
    row = I.interaction_profile(frame).first()
    assert (row.total_logs, row.unique_users, row.unique_products) == (3, 2, 2)
    assert row.sparsity_pct == 50.0


def test_matrix_fills_zero_and_refuses_wide_catalogues(spark):
    frame = I.interaction_scores(logs(spark, [(1, 1, "view", 0.0), (2, 2, "purchase", 0.0)]))
    got = {r.user_id: (r.p1, r.p2) for r in I.interaction_matrix(frame, [1, 2]).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, 5.0)}
    with pytest.raises(ValueError):
        I.interaction_matrix(frame, list(range(2000)))


def test_heldout_rms_of_one_fold_per_user(spark):
    frame = I.interaction_scores(logs(spark, [(1, 1, "purchase", 0.0), (2, 1, "view", 0.0)]))
    row = I.heldout_rms(frame).first()
    assert row.folds_used in (1, 2)
    expected = 3.0 if row.folds_used == 2 else round(13**0.5, 4)
    assert row.rmse == pytest.approx(expected)
