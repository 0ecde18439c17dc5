import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.operators.ranks import dense_codes, exact_quantile, running_total, top_per_key


def test_dense_codes_follow_id_order(spark):
    rng = np.random.default_rng(1)
    ids = sorted(set(rng.integers(-(10**9), 10**12, 3000).tolist()))
    frame = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "id long").repartition(7)
    got = {r.id: r.code for r in dense_codes(frame, "id").collect()}
    assert got == {v: n for n, v in enumerate(ids)}


def test_running_total_with_most_keys_in_one_range(spark):
    keys = list(range(1000)) + [10**15 + 1]
    frame = spark.createDataFrame([(k, k % 7) for k in keys], "k long, n long")
    got = {r.k: r.running for r in running_total(frame, "k", "n", ranges=8).collect()}
    assert [got[k] for k in keys] == np.cumsum([k % 7 for k in keys]).tolist()


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1001])
@pytest.mark.parametrize("share", [0.25, 0.5, 0.75])
def test_quantile_is_exact(spark, size, share):
    values = np.random.default_rng(size).choice([1.0, 2.5, 2.5, 7.0, 1e6, -3.0], size)
    values = values + np.where(np.arange(size) % 3 == 0, np.arange(size), 0)
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = exact_quantile(frame, "v", share, "q").first().q
    assert got == pytest.approx(np.quantile(values, share))


def test_quantile_of_nothing_is_empty(spark):
    frame = spark.createDataFrame([(None,)], "v double")
    assert exact_quantile(frame, "v", 0.5, "q").first().q is None


def test_top_per_key(spark):
    frame = spark.createDataFrame([(1, 5), (1, 9), (1, 7), (2, 1)], "k int, v int")
    got = top_per_key(frame, ["k"], [F.desc("v")], 2).collect()
    assert sorted((r.k, r.v, r.rank) for r in got) == [(1, 7, 2), (1, 9, 1), (2, 1, 1)]


def test_codes_of_a_wide_frame_in_memory(spark):
    rows = [(u, (u * 7) % 30, 1.0, 2) for u in range(200)]
    frame = spark.createDataFrame(rows, "user_id long, product_id long, score double, n_events long").repartition(4)
    assert {r.product_id: r.code for r in dense_codes(frame, "product_id").collect()} == {i: i for i in range(30)}
