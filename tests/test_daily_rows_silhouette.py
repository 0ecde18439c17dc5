"""Logs by day, sparse rows of any width, and the Euclidean silhouette."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cartlens import schemas
from cartlens.operators import interactions as I
from cartlens.operators import segments as S
from cartlens.operators.cooccurrence import dealt, pair_sums
from cartlens.operators.silhouette import silhouettes
from cartlens.session import scratch_path
from cartlens.sources.daily import read_daily, write_daily
from cartlens.sources.sample import AS_OF, sample_shop
from cartlens.sources.tables import conform


@pytest.fixture(scope="module")
def daily(spark):
    folder = scratch_path(spark, "daily")
    logs = conform(sample_shop(spark, "/root/testdata/sf0.001").behavior, schemas.BEHAVIOR)
    write_daily(logs, folder)
    return folder, logs


def test_only_the_days_asked_for_are_read(spark, daily):
    folder, logs = daily
    days = sorted(r[0] for r in logs.select(F.col("created_at").cast("date")).distinct().collect() if r[0])
    since = dt.datetime.combine(days[-3], dt.time(7, 30))
    until = dt.datetime.combine(days[-1], dt.time(1, 0))
    got = read_daily(spark, folder, since, until)
    assert {f.split("day=")[1][:10] for f in got.inputFiles()} <= {str(d) for d in days}
    at = lambda m: F.lit(m.isoformat(sep=" ")).cast("timestamp_ntz")
    want = logs.where((F.col("created_at") >= at(since)) & (F.col("created_at") < at(until)))
    assert got.drop("day").exceptAll(want).count() == 0 and got.count() == want.count() > 0
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and f"(day#" in plan
    assert read_daily(spark, folder).count() == logs.count()


def test_days_of_a_join_prune_the_scan(spark, daily):
    folder, logs = daily
    chosen = scratch_path(spark, "chosen")
    day = F.col("created_at").cast("date")
    logs.select(day.alias("day"), F.dayofmonth(day).alias("place")).distinct().write.parquet(chosen)
    joined = read_daily(spark, folder).join(spark.read.parquet(chosen).where("place = 3"), "day")
    assert joined.count() == logs.where(F.dayofmonth(day) == 3).count()
    assert "dynamicpruning" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_rows_equal_the_pivot(spark):
    shop = sample_shop(spark, "/root/testdata/sf0.001")
    scores = I.interaction_scores(I.behavior_logs(shop.behavior))
    wide = {r["user_id"]: r for r in I.interaction_matrix(scores, list(range(25))).collect()}
    rows = I.interaction_rows(scores).collect()
    assert {r["user_id"] for r in rows} == set(wide)
    for r in rows:
        held = dict(zip(r["products"], r["scores"]))
        assert r["products"] == sorted(held)
        assert [held.get(p, 0.0) for p in range(25)] == [wide[r["user_id"]][f"p{p}"] for p in range(25)]


def test_sparse_rows_of_a_wide_catalogue(spark):
    scores = spark.range(5000).select((F.col("id") % 2).alias("user_id"), F.col("id").alias("product_id"), F.lit(1.0).alias("score"))
    rows = I.interaction_rows(scores).collect()
    assert [len(r["products"]) for r in rows] == [2500, 2500]
    with pytest.raises(ValueError):
        I.interaction_matrix(scores, list(range(5000)))


def _silhouette(x, labels):
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = distance[i, own].sum() / (own.sum() - 1)
        b = min(distance[i, labels == c].mean() for c in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def clustered(spark):
    shop = sample_shop(spark, "/root/testdata/sf0.001")
    vectors = S._vectors(S.scaled_features(S.user_features(shop.users, shop.summary, AS_OF))).persist()
    models = {k: KMeans(k=k, seed=1).fit(vectors) for k in (2, 4, 6)}
    return vectors, models


def test_silhouette_matches_numpy(clustered):
    vectors, models = clustered
    found = silhouettes(vectors, models)
    for k, model in models.items():
        rows = model.transform(vectors).collect()
        x = np.array([r["features"].toArray() for r in rows])
        assert found[k] == pytest.approx(_silhouette(x, np.array([r["prediction"] for r in rows])), abs=1e-9)


def test_distances_by_small_tiles(clustered, monkeypatch):
    vectors, models = clustered
    whole = silhouettes(vectors, models)
    monkeypatch.setattr("cartlens.operators.silhouette._JUDGED_AT_ONCE", 3)
    monkeypatch.setattr("cartlens.operators.silhouette._POINTS_AT_ONCE", 7)
    assert silhouettes(vectors.coalesce(1), models) == pytest.approx(whole, abs=1e-12)


def test_a_sample_is_judged_against_all(clustered):
    vectors, models = clustered
    some, whole = silhouettes(vectors, models, most_judged=40), silhouettes(vectors, models)
    assert all(abs(some[k] - whole[k]) < 0.15 and some[k] != whole[k] for k in models)


def test_every_one_of_many_points_is_judged(spark, monkeypatch):
    """More points than a task holds, a third of them equal, ids that are missing or repeat: the mean over all of them."""
    n = 21_000
    monkeypatch.setattr("cartlens.operators.silhouette.CHUNK", 1 << 11)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, 2)) + np.where(np.arange(n) % 4 == 0, 4, 0)[:, None]
    x[::3] = [7.0, 0.1]
    ids = [None if u % 10 == 0 else u // 2 for u in range(n)]
    vectors = spark.createDataFrame([(u, Vectors.dense(v)) for u, v in zip(ids, x)], ["user_id", "features"]).persist()
    models = {k: KMeans(k=k, seed=1, maxIter=3).fit(vectors) for k in (2, 3)}
    found = silhouettes(vectors, models)
    for k, model in models.items():
        labels = np.array([((v - np.array(model.clusterCenters())) ** 2).sum(axis=1).argmin() for v in x])
        members = np.eye(k)[labels]
        sums = np.concatenate([
            np.sqrt(sum((x[at : at + 500, d, None] - x[:, d]) ** 2 for d in range(2))) @ members for at in range(0, n, 500)
        ])
        size, rows = members.sum(axis=0), np.arange(n)
        inside = sums[rows, labels] / (size[labels] - 1)
        means = sums / size
        means[rows, labels] = np.inf
        outside = means.min(axis=1)
        assert found[k] == pytest.approx(((outside - inside) / np.maximum(inside, outside)).mean(), abs=1e-9)


def test_a_hot_group_leaves_no_large_task(spark):
    """A basket with a third of all rows: its pairs are dealt to many tasks, without a window over it."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 997).alias("g"), F.col("id").alias("p"))
    narrow, wide = dealt(rows, "g", "p", None, None, 64)
    assert "Window" not in wide._jdf.queryExecution().toString()
    parts = -(-2000 // 64)
    assert wide.count() == 2000 * parts and narrow.count() == 4000
    per_key = wide.groupBy("lo", "hi").count().agg(F.max("count"), F.avg("count")).first()
    assert per_key[0] <= 3 * per_key[1]
    got = {(r["item_a"], r["item_b"]): r["total"] for r in pair_sums(rows, "g", "p", tile=64).where("item_a < 30").collect()}
    members = {}
    for i in range(6000):
        members.setdefault(-1 if i % 3 == 0 else i % 997, []).append(i)
    want = {(a, b): 1.0 for ids in members.values() for a in ids if a < 30 for b in ids if b > a}
    assert got == want
