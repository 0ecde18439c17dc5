import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartlens import constants as C
from cartlens.operators import collaborative as CF
from cartlens.operators import interactions as I
from cartlens.sources.sample import RECENT_SINCE, sample_shop

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def scores(spark):
    shop = sample_shop(spark, FOLDER)
    return I.interaction_scores(I.behavior_logs(shop.behavior)).persist()


@pytest.fixture(scope="module")
def recent(spark):
    shop = sample_shop(spark, "/root/testdata/sf0.01")
    return I.interaction_scores(I.behavior_logs(shop.behavior, RECENT_SINCE)).persist()


def matrix(frame):
    rows = frame.select("user_id", "product_id", "score").toPandas()
    return rows.pivot(index="user_id", columns="product_id", values="score").fillna(0.0)


def projector(factors):
    rows = factors.orderBy("code").toPandas()
    v = rows[[c for c in rows if c.startswith("f_")]].to_numpy()
    return v, v @ v.T


def frame_of(spark, rows):
    return spark.createDataFrame(
        [(u, p, float(s), 1) for u, p, s in rows],
        "user_id long, product_id long, score double, n_events long",
    )


def rank_projector(x, rank):
    v = np.linalg.svd(x, full_matrices=False)[2][:rank].T
    return v @ v.T


def test_factors_are_the_leading_singular_vectors(scores):
    x = matrix(scores).to_numpy()
    v, got = projector(CF.fit_factors(scores, rank=6))
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-8)
    assert np.allclose(got, rank_projector(x, 6), atol=1e-6)


def test_error_falls_with_the_rank(scores):
    x = matrix(scores).to_numpy()
    errors = [np.linalg.norm(x - x @ projector(CF.fit_factors(scores, rank=r))[1]) for r in (1, 4, 8)]
    assert errors[0] > errors[1] > errors[2]


def test_default_rank():
    assert CF.default_rank(1000, 25) == 24
    assert CF.default_rank(10, 400) == 9
    assert CF.default_rank(10**6, 10**6) == 50


def test_wide_catalogue_passes_find_the_same_space(spark):
    rng = np.random.default_rng(5)
    base = rng.random((60, 4)) @ (rng.random((4, 40)) * [[9], [5], [3], [2]])
    noise = 0.01 * rng.random((60, 40))
    cells = [(u, 3 * p, base[u, p] + noise[u, p]) for u in range(60) for p in range(40)]
    frame = frame_of(spark, cells)
    x = matrix(frame).to_numpy()
    v, got = projector(CF.fit_factors(frame, rank=4))
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    assert np.allclose(got, rank_projector(x, 4), atol=1e-5)


def expected_lists(frame, factors, top_n):
    x = matrix(frame)
    _, proj = projector(factors)
    out = {}
    for user, row in x.iterrows():
        if (row > 0).sum() < C.MIN_INTERACTIONS:
            continue
        score = np.round(row.to_numpy() @ proj, 4)
        unseen = [(-s, p) for s, p, seen in zip(score, x.columns, row > 0) if not seen]
        out[user] = [(p, pytest.approx(-s, abs=2e-4)) for s, p in sorted(unseen)[:top_n]]
    return {u: rows for u, rows in out.items() if rows}


@pytest.mark.parametrize("block", [4, 65_536])
def test_block_scores_match_numpy(recent, block):
    factors = CF.fit_factors(recent, rank=8)
    got = {}
    for r in CF.factor_recommendations(recent, factors, 5, block=block).orderBy("rank").collect():
        got.setdefault(r.user_id, []).append((r.product_id, r.score))
    assert got == expected_lists(recent, factors, 5)


def test_factor_lists_hold_no_seen_product(recent):
    lists = CF.factor_recommendations(recent, CF.fit_factors(recent))
    seen = recent.where("score > 0").select("user_id", "product_id")
    assert lists.join(seen, ["user_id", "product_id"]).count() == 0
    assert lists.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 10


def test_cosine_matches_numpy(recent):
    x = matrix(recent)
    norm = np.linalg.norm(x.to_numpy(), axis=0)
    sim = pd.DataFrame(
        x.to_numpy().T @ x.to_numpy() / np.outer(norm, norm), index=x.columns, columns=x.columns
    )
    rows = CF.item_similarity(recent).collect()
    assert len(rows) == (np.triu(sim.to_numpy(), 1) > 0).sum()
    for r in rows:
        assert r.similarity == pytest.approx(sim.loc[r.item_a, r.item_b])


def test_thin_lists_fill_up_with_the_lowest_unseen_ids(spark):
    rows = [(1, 10, 5), (1, 20, 2), (2, 10, 4), (2, 30, 1), (3, 40, 0), (4, 50, 3)]
    rows += [(9, p, 1) for p in (60, 70, 80, 90, 95)]
    frame = frame_of(spark, rows)
    users = spark.createDataFrame([(1,), (3,), (77,)], "user_id long")
    lists = {}
    for r in CF.similarity_recommendations(frame, users, 4).orderBy("rank").collect():
        lists.setdefault(r.user_id, []).append((r.product_id, r.score, r.rank))
    assert [p for p, _, _ in lists[1]] == [30, 40, 50, 60]
    assert lists[1][0][1] > 0 and [s for _, s, _ in lists[1][1:]] == [0.0, 0.0, 0.0]
    assert [(p, s) for p, s, _ in lists[3]] == [(10, 0.0), (20, 0.0), (30, 0.0), (40, 0.0)]
    assert [r for _, _, r in lists[77]] == [1, 2, 3, 4]


def test_user_who_saw_everything_gets_nothing_personal(spark):
    frame = frame_of(spark, [(1, p, 1) for p in range(3)] + [(2, 0, 1)])
    users = spark.createDataFrame([(1,)], "user_id long")
    assert CF.similarity_recommendations(frame, users).count() == 0


def test_homepage_falls_back_to_best_sellers(spark):
    rows = [(1, p, p + 1) for p in range(6)] + [(1, 50, 0), (2, 1, 3), (3, 2, 0), (4, 4, 2)]
    rows += [(5, p, 1) for p in list(range(6)) + [50]]
    rows += [(6, p, 2) for p in (0, 1, 2, 3, 50)]
    frame = frame_of(spark, rows)
    trending = spark.createDataFrame(
        [(900, 7.0), (901, 9.0), (902, 7.0)], "product_id long, score double"
    )
    requested = spark.createDataFrame([(u,) for u in (1, 2, 3, 5, 99)], "user_id long")
    factors = CF.fit_factors(frame, rank=2)
    lists = CF.homepage_recommendations(requested, frame, trending, factors, 3)
    kinds, picks = {}, {}
    for r in lists.orderBy("user_id", "rank").collect():
        kinds[r.user_id] = r.rec_type
        picks.setdefault(r.user_id, []).append(r.product_id)
    assert kinds == {1: "collaborative", 2: "collaborative", 3: "trending", 5: "trending", 99: "trending"}
    assert picks[1] == [50]
    assert picks[99] == [901, 900, 902]
    without = CF.homepage_recommendations(requested, frame, trending, None, 3).collect()
    assert {r.rec_type for r in without} == {"trending"} and len(without) == 15


def test_homepage_range(spark, recent):
    with pytest.raises(ValueError):
        CF.homepage_recommendations(recent, recent, recent, None, 51)


def test_trending_ties_go_to_the_lower_id(spark):
    sold = spark.createDataFrame([(3, 2.0), (1, 1.0), (1, 1.0), (2, 5.0)], "product_id long, quantity double")
    got = CF.trending_products(sold, 3).orderBy(F.desc("score"), "product_id").collect()
    assert [(r.product_id, r.score) for r in got] == [(2, 5.0), (1, 2.0), (3, 2.0)]


def test_hidden_cells_are_predicted_better_than_by_zero(scores):
    row = CF.cell_split_rmse(scores, rank=3).first()
    zero = scores.where("score > 0").agg(F.sqrt(F.avg(F.col("score") ** 2))).first()[0]
    assert row.hidden_cells > 0 and row.rmse < zero


def test_wide_passes_keep_zero_products_and_weak_directions(spark):
    rng = np.random.default_rng(8)
    strong = np.outer(rng.random(40) + 1, rng.random(12) + 1) * 1e4
    values = strong + rng.random((40, 12))
    rows = [(u, p, float(values[u, p]), 1) for u in range(40) for p in range(12)]
    rows += [(0, 12, 0.0, 1), (1, 13, 0.0, 1)]
    scores = spark.createDataFrame(rows, "user_id long, product_id long, score double, n_events long")
    factors = CF.fit_factors(scores, rank=6)
    v, wide = projector(factors)
    assert v.shape == (14, 6) and np.allclose(v[12:], 0)
    _, _, exact = np.linalg.svd(np.pad(values, ((0, 0), (0, 2))))
    assert np.allclose(abs(v[:, 0] @ exact[0]), 1, atol=1e-6)
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-6)
