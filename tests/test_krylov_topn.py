"""Factors of any catalogue, and lists that score only what may enter them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.operators import collaborative as CF
from cartlens.operators import krylov
from cartlens.operators.topn import best_products, length_blocks
from cartlens.sources.sample import offer_scores


def frame_of(spark, x, keep=None):
    rows = [(u, 5 * p + 1, float(x[u, p]), 1) for u in range(x.shape[0]) for p in range(x.shape[1]) if keep is None or keep[u, p]]
    return spark.createDataFrame(rows, "user_id long, product_id long, score double, n_events long")


def vectors_of(factors):
    rows = factors.orderBy("code").toPandas()
    return rows[[c for c in rows if c.startswith("f_")]].to_numpy()


def test_thousands_of_offers_match_numpy(spark):
    """A flat spectrum of more than 3,000 offers: every direction found, with its residual."""
    scores = offer_scores(spark, "/root/testdata/sf0.01")
    fitted = CF.fit_reported(scores, rank=4, tolerance=1e-7)
    x = scores.toPandas().pivot(index="user_id", columns="product_id", values="score").fillna(0.0).to_numpy()
    assert x.shape[1] >= 3000
    _, strengths, right = np.linalg.svd(x, full_matrices=False)
    report = fitted.report.orderBy("component").toPandas()
    assert np.allclose(report["strength"], strengths[:4], rtol=1e-9)
    assert (report["residual"] <= 1e-7).all()
    v = vectors_of(fitted.table)
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-9)
    assert np.abs(v @ v.T - right[:4].T @ right[:4]).max() < 1e-4


def test_restarts_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((90, 70)) * np.linspace(3, 1, 70)
    monkeypatch.setattr(krylov, "MOST_COLUMNS", 1)
    monkeypatch.setattr(krylov, "MOST_BLOCKS", 2)
    monkeypatch.setattr(krylov, "SPARE_COLUMNS", 6)
    monkeypatch.setattr(krylov, "LEAST_COLUMNS", 9)
    fitted = CF.fit_reported(frame_of(spark, x), rank=3)
    v = vectors_of(fitted.table)
    right = np.linalg.svd(x)[2][:3]
    assert fitted.passes > 3
    assert np.abs(v @ v.T - right.T @ right).max() < 1e-7


def test_a_small_catalogue_is_exact_after_one_pass(spark):
    x = np.random.default_rng(1).random((30, 12))
    fitted = CF.fit_reported(frame_of(spark, x))
    assert fitted.passes == 1
    assert np.allclose(fitted.report.orderBy("component").toPandas()["strength"], np.linalg.svd(x)[1][:11])


def test_a_rank_asked_for_counts_no_users(spark, monkeypatch):
    monkeypatch.setattr(CF, "matrix_shape", lambda scores: pytest.fail("counted"))
    x = np.random.default_rng(4).random((9, 5))
    assert np.allclose(CF.fit_reported(frame_of(spark, x), rank=2).report.orderBy("component").toPandas()["strength"], np.linalg.svd(x)[1][:2])


def test_what_does_not_converge_is_said(spark, monkeypatch):
    x = np.random.default_rng(2).random((60, 50))
    codes = spark.createDataFrame([(p,) for p in range(50)], "code long")
    cells = frame_of(spark, x).select("user_id", ((F.col("product_id") - 1) / 5).cast("long").alias("code"), "score")
    with pytest.raises(krylov.NotConverged):
        krylov.singular_vectors(cells, codes, 3, passes=1)


def test_low_rank_equal_strengths_and_empty_columns(spark):
    """Three directions of equal strength, rank five asked of a matrix of rank three, two products without a score."""
    x = np.kron(np.eye(3), np.ones((4, 4)))
    scores = frame_of(spark, x, x > 0).unionAll(
        spark.createDataFrame([(0, 900, 0.0, 1), (1, 901, 0.0, 1)], "user_id long, product_id long, score double, n_events long")
    )
    fitted = CF.fit_reported(scores, rank=5)
    report = fitted.report.orderBy("component").toPandas()
    assert np.allclose(report["strength"], [4, 4, 4, 0, 0], atol=1e-6)
    v = vectors_of(fitted.table)
    assert v.shape == (14, 5) and np.allclose(v.T @ v, np.eye(5), atol=1e-8)
    assert np.allclose(v[12:], 0)
    # More directions than products with scores: the others complete them.
    few = frame_of(spark, np.array([[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 0.0]]))
    fitted = CF.fit_reported(few, rank=2)
    v = vectors_of(fitted.table)
    assert np.allclose(v.T @ v, np.eye(2)) and np.allclose(abs(v[:, 0]), [1, 0, 0])


def whole_lists(users, seen, products, vectors, top_n):
    out = {}
    for user, u in users.items():
        score = np.round(vectors @ u, 4) + 0.0
        rows = sorted((-s, p) for s, p in zip(score, products) if p not in seen.get(user, ()))
        out[user] = [(p, -s) for s, p in rows[:top_n]]
    return out


@pytest.mark.parametrize("block, tile", [(1000, 16), (40, 8), (7, 3), (1000, 512)])
def test_lists_equal_those_of_scoring_everything(spark, block, tile):
    rng = np.random.default_rng(block)
    products = [int(p) for p in rng.permutation(300)[:200]]
    # Lengths that fall fast, ties, copies of one vector, and products of length 0.
    vectors = np.round(rng.standard_normal((200, 5)) / (1 + np.arange(200))[:, None], 2)
    vectors[150:170] = vectors[3]
    users = {u: np.round(rng.standard_normal(5), 1) for u in range(40)}
    users[40] = np.zeros(5)
    seen = {u: set(rng.choice(products, rng.integers(0, 60), replace=False).tolist()) for u in range(0, 40, 2)}
    seen[1] = set(products)
    seen[3] = set(products[4:])
    names = [f"f_{i}" for i in range(5)]
    factors = spark.createDataFrame(
        [(p, c, *map(float, v)) for c, (p, v) in enumerate(zip(products, vectors))],
        "product_id long, code long, " + ", ".join(f"{n} double" for n in names),
    )
    code = {p: c for c, p in enumerate(products)}
    asked = spark.createDataFrame([(u, *map(float, v)) for u, v in users.items()], "user_id long, " + ", ".join(f"{n} double" for n in names))
    known = spark.createDataFrame([(u, code[p]) for u, ps in seen.items() for p in ps], "user_id long, code long")
    got = {
        r["user_id"]: list(zip(r["products"], r["scores"]))
        for r in best_products(asked, known, factors, names, 6, block, tile).collect()
    }
    assert got == whole_lists(users, seen, products, vectors, 6)


def test_most_pairs_of_a_skewed_catalogue_are_never_scored(spark):
    rng = np.random.default_rng(9)
    n_users, n_products = 120, 4000
    taste = rng.random((n_users, 3)) + 0.2
    appeal = (rng.random((n_products, 3)) + 0.2) / (1 + np.arange(n_products))[:, None]
    x = taste @ appeal.T
    keep = (rng.random(x.shape) < 0.01) | (np.arange(n_products) < 5)
    scores = frame_of(spark, 100 * x, keep)
    factors = CF.fit_factors(scores, rank=3)
    share = CF.scoring_share(scores, factors).first()
    assert share.products == len(set(np.nonzero(keep)[1])) and share.users == n_users
    assert share.share < 0.2
    lists = {}
    for r in CF.factor_recommendations(scores, factors).orderBy("rank").collect():
        lists.setdefault(r.user_id, []).append((r.product_id, r.score))
    ordered = factors.orderBy("code").toPandas()
    v, ids = ordered[["f_0", "f_1", "f_2"]].to_numpy(), ordered["product_id"].tolist()
    own = CF.user_factors(scores, factors).toPandas().set_index("user_id")[["f_0", "f_1", "f_2"]]
    seen = {u: {5 * p + 1 for p in np.flatnonzero(keep[u])} for u in range(n_users)}
    want = whole_lists({u: own.loc[u].to_numpy() for u in own.index}, seen, ids, v, 10)
    for user, rows in want.items():
        assert [s for _, s in lists[user]] == pytest.approx([s for _, s in rows], abs=2e-4)


def test_most_pairs_of_a_flat_catalogue_are_never_scored(spark):
    """Products of like length around a mean that all users share: their deviations decide, not their lengths."""
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((6000, 4)) * [0.3, 1, 1, 1] + [1, 0, 0, 0]
    users = {u: np.array([9.0, *rng.standard_normal(3)]) for u in range(50)}
    names = [f"f_{i}" for i in range(4)]
    columns = ", ".join(f"{n} double" for n in names)
    factors = spark.createDataFrame([(3 * c, c, *map(float, v)) for c, v in enumerate(vectors)], f"product_id long, code long, {columns}")
    asked = spark.createDataFrame([(u, *map(float, v)) for u, v in users.items()], f"user_id long, {columns}")
    known = spark.createDataFrame([(u, u) for u in users], "user_id long, code long")
    rows = best_products(asked, known, factors, names, 5, block=1000, tile=64).collect()
    got = {r["user_id"]: list(zip(r["products"], r["scores"])) for r in rows}
    assert got == whole_lists(users, {u: {3 * u} for u in users}, [3 * c for c in range(6000)], vectors, 5)
    assert sum(r["n_scored"] for r in rows) < 0.1 * 50 * 6000


def test_parts_of_users_share_stretches_of_codes(spark, monkeypatch):
    """Several parts and stretches, a user without an id, cells that come twice: the packed step equals numpy's product."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(krylov, "PART_CELLS", 2000)
    n = krylov.STRETCH + 500
    rows = [(int(u), int(c), float(x)) for u, c, x in zip(rng.integers(0, 300, 9000), rng.integers(0, n, 9000), rng.random(9000))]
    x = np.zeros((300, n))
    for u, c, score in rows:
        x[u, c] += score
    cells = spark.createDataFrame([*rows, (None, 7, 5.0)], "user_id long, code long, score double")
    parts = krylov._parts(cells)
    assert parts.count() > 2
    start = rng.standard_normal((n, 3))
    columns = ", ".join(f"f_{i} double" for i in range(3))
    block = krylov._packed(spark.createDataFrame([(c, *map(float, v)) for c, v in enumerate(start)], f"code long, {columns}"), 3)
    basis = block.select("stretch", F.lit(b"").alias("q"), F.lit(b"").alias("m"))
    wanted = parts.select("part", "codes").mapInArrow(krylov._by_stretch, krylov._WANTED)
    wide = krylov._with_image(parts, wanted, basis, block, 0, 3).orderBy("stretch").collect()
    assert len(wide) == 2
    own, image = (np.concatenate([np.frombuffer(bytes(r[k])).reshape(-1, 3) for r in wide]) for k in "qm")
    met = (x > 0).any(axis=0)[:, None]
    assert np.array_equal(own, start * met) and np.allclose(image, x.T @ (x @ (start * met)))


def test_parts_of_codes_exchange_sums_of_users(spark, monkeypatch):
    """More codes than users, a best seller's stretch over several parts, a user without an id, cells that come twice."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(krylov, "PART_CELLS", 1000)
    monkeypatch.setattr(krylov, "CODE_PART_CELLS", 2000)
    n, m = 3 * krylov.STRETCH + 500, 2500
    codes = np.where(rng.random(15_000) < 0.4, 3, rng.integers(0, n, 15_000))
    rows = [(int(u) * 7 - 40, int(c), float(x)) for u, c, x in zip(rng.integers(0, m, 15_000), codes, rng.random(15_000))]
    x = np.zeros((m, n))
    for u, c, score in rows:
        x[(u + 40) // 7, c] += score
    cells = spark.createDataFrame([*rows, (None, 7, 5.0)], "user_id long, code long, score double").repartition(5)
    shares = krylov._by_code(cells, n)
    start = rng.standard_normal((n, 3))
    columns = ", ".join(f"f_{i} double" for i in range(3))
    block = krylov._packed(spark.createDataFrame([(c, *map(float, v)) for c, v in enumerate(start)], f"code long, {columns}"), 3)
    found = shares(block, 3)
    # The first stretch has more cells than a part may hold.
    assert found.where("stretch = 0").select("part").distinct().count() >= 3
    basis = block.select("stretch", F.lit(b"").alias("q"), F.lit(b"").alias("m"))
    wide = krylov._with_shares(basis, block, found, 0, 3).orderBy("stretch").collect()
    own, image = (np.concatenate([np.frombuffer(bytes(r[k])).reshape(-1, 3) for r in wide]) for k in "qm")
    met = (x > 0).any(axis=0)[:, None]
    assert np.array_equal(own, start * met) and np.allclose(image, x.T @ (x @ (start * met)))
    assert krylov._by_code(cells, m // 2) is None


def test_blocks_by_length(spark):
    factors = spark.range(500).select(
        F.col("id").alias("product_id"), F.col("id").alias("code"),
        F.when(F.col("id") < 300, F.lit(0.0)).otherwise(1 / (F.col("id") - 299)).alias("f_0"),
    )
    found = length_blocks(factors, ["f_0"], 50).toPandas()
    longest, shortest = found.groupby("block")["norm"].max(), found.groupby("block")["norm"].min()
    assert len(found) == 500 and found["block"].nunique() >= 10
    assert found.groupby("block").size().max() <= 100
    assert all(shortest[b] >= longest[b + 1] * 0.95 for b in sorted(longest.index)[:-1])


def thin_lists(x, products, users, top_n):
    """Weighted means of the user's scores by cosine, whole, then the lowest ids at 0."""
    norm = np.sqrt((x * x).sum(axis=0))
    cosine = x.T @ x / np.outer(np.where(norm > 0, norm, 1), np.where(norm > 0, norm, 1))
    out = {}
    for u in users:
        known = np.flatnonzero(x[u] > 0)
        rows = []
        for c, p in enumerate(products):
            if x[u, c] > 0:
                continue
            weight = cosine[known, c] * (cosine[known, c] > 0)
            score = round(float((weight * x[u, known]).sum() / (weight.sum() + 1e-9)), 4) if len(known) else 0.0
            rows.append((-max(score, 0.0), p))
        out[u] = [(p, -s) for s, p in sorted(rows)[:top_n]]
    return out


@pytest.mark.parametrize("first", [3, 10, 4096])
def test_thin_lists_by_ranges_of_ids(spark, first):
    rng = np.random.default_rng(6)
    x = np.round(5 * rng.random((60, 80)), 0) * (rng.random((60, 80)) < 0.12)
    thin = list(range(25))
    for u in thin:
        seen = np.flatnonzero(x[u])
        x[u, seen[4:]] = 0
    x[0] = 0
    x[30, :] = np.maximum(x[30, :], 1)  # every product is known to someone
    scores = frame_of(spark, x, (x > 0) | (np.arange(80) == 0))
    asked = spark.createDataFrame([(u,) for u in [*thin, 999]], "user_id long")
    got = {}
    for r in CF.similarity_recommendations(scores, asked, 5, first).orderBy("rank").collect():
        got.setdefault(r.user_id, []).append((r.product_id, r.score))
    want = thin_lists(x, [5 * p + 1 for p in range(80)], thin, 5)
    assert got.pop(999) == [(5 * p + 1, 0.0) for p in range(5)]
    assert {u: [p for p, _ in rows] for u, rows in got.items()} == {u: [p for p, _ in rows] for u, rows in want.items()}
    for u, rows in got.items():
        assert [s for _, s in rows] == pytest.approx([s for _, s in want[u]], abs=2e-4)
