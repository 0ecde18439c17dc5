from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens import schemas
from cartlens.operators import baskets as B
from cartlens.operators import cooccurrence
from cartlens.operators.cooccurrence import pair_sums
from cartlens.sources.sample import sample_shop
from cartlens.sources.tables import normalise_vocabulary


def lines(spark, orders):
    rows = [(o, p) for o, items in orders.items() for p in items]
    return spark.createDataFrame(rows, "order_id long, product_id long")


def brute_pairs(groups):
    total = Counter()
    for cells in groups.values():
        for (a, x), (b, y) in combinations(sorted(cells.items()), 2):
            total[a, b] += x * y
    return total


@pytest.mark.parametrize("tile", [3, 10, 4096])
def test_pair_sums_match_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    groups = {
        g: {int(i): float(rng.integers(1, 5)) for i in rng.choice(60, size, replace=False)}
        for g, size in enumerate(rng.integers(1, 12, 200).tolist() + [60, 50])
    }
    rows = [(g, i, w) for g, cells in groups.items() for i, w in cells.items()]
    frame = spark.createDataFrame(rows, "g long, i long, w double").repartition(5)
    got = {(r.item_a, r.item_b): r.total for r in pair_sums(frame, "g", "i", "w", tile=tile).collect()}
    total = dict(brute_pairs(groups))
    assert got == pytest.approx(total)
    marked = frame.withColumn("wanted", F.col("i").isin(3, 7, 59))
    some = pair_sums(marked, "g", "i", "w", "wanted", tile).collect()
    assert {(r.item_a, r.item_b): r.total for r in some} == pytest.approx(
        {pair: v for pair, v in total.items() if {3, 7, 59} & set(pair)}
    )


def test_pair_sums_across_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "CHUNK_ROWS", 16)
    groups = {g: {i: 1.0 for i in range(g % 9 + 1)} for g in range(300)}
    rows = [(g, i) for g, cells in groups.items() for i in cells]
    frame = spark.createDataFrame(rows, "g long, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {(r.item_a, r.item_b): r.total for r in pair_sums(frame, "g", "i").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == dict(brute_pairs(groups))


def test_pair_sums_of_sparse_wide_ids(spark):
    """Item ids far apart, more of them than the dense counting allows for."""
    groups = {g: {g * 10**9 + i * 7: 2.0 for i in range(6)} for g in range(800)}
    rows = [(g, i, w) for g, cells in groups.items() for i, w in cells.items()]
    frame = spark.createDataFrame(rows, "g long, i long, w double").coalesce(1)
    got = {(r.item_a, r.item_b): r.total for r in pair_sums(frame, "g", "i", "w").collect()}
    assert got == dict(brute_pairs(groups))


def test_duplicate_lines_count_once_for_support(spark):
    items = B.basket_items(lines(spark, {1: [1, 1, 2]}))
    profile = B.basket_profile(items).first()
    assert (profile.total_orders, profile.total_items, profile.unique_products) == (1, 3, 2)
    assert profile.avg_items_per_order == 3.0
    assert {r.product_id: r.n_baskets for r in B.frequent_items(items).collect()} == {1: 1, 2: 1}


def test_status_case_does_not_matter(spark):
    orders = spark.createDataFrame([(1, 1, "Delivered", 1.0, None)], schemas.ORDERS)
    assert B.delivered(normalise_vocabulary(orders, "order_status")).count() == 1


def test_independent_pair_with_lift_one_is_kept(spark):
    orders = {1: [1, 2], 2: [1], 3: [2], 4: [3]}
    rules = B.association_rules(B.basket_items(lines(spark, orders)), min_support=0.25)
    got = {(r.antecedent_id, r.consequent_id): r.lift for r in rules.collect()}
    assert got[1, 2] == got[2, 1] == 1.0


def test_thresholds_are_inclusive(spark):
    orders = {1: [1, 2], 2: [1], 3: [1], 4: [1]}
    items = B.basket_items(lines(spark, orders))
    rules = B.association_rules(items, min_support=0.25, min_confidence=0.25)
    assert (1, 2) in {(r.antecedent_id, r.consequent_id) for r in rules.collect()}
    rules = B.association_rules(items, min_support=0.25, min_confidence=0.2501)
    assert (1, 2) not in {(r.antecedent_id, r.consequent_id) for r in rules.collect()}


def test_nothing_frequent_gives_no_rules(spark):
    items = B.basket_items(lines(spark, {o: [o] for o in range(400)}))
    assert B.association_rules(items).count() == 0
    assert B.frequent_itemsets(items).count() == 0


def test_one_basket_per_order_whatever_the_ids(spark):
    items = B.basket_items(lines(spark, {1: [1, 5000, 9000], 2: [3]}))
    assert {r.order_id: r["items"] for r in B.baskets(items).collect()} == {1: [1, 5000, 9000], 2: [3]}


def test_status_in_any_case_counts(spark):
    orders = spark.createDataFrame([(1, "Delivered"), (2, "DELIVERED"), (3, "pending")], "order_id long, order_status string")
    assert B.delivered(orders).count() == 2


def test_pair_rules_equal_fpgrowth_rules(spark):
    shop = sample_shop(spark, "/root/testdata/sf0.001")
    items = B.basket_items(B.order_items_delivered(shop.order_items, shop.orders)).persist()
    model, total = B.fpgrowth_model(items)
    sets = {tuple(sorted(r["items"])): r.freq for r in model.freqItemsets.collect()}
    pairs = {(r.item_a, r.item_b): r.n_baskets for r in B.frequent_pairs(items).collect()}
    assert pairs == {k: v for k, v in sets.items() if len(k) == 2}
    assert {r.product_id: r.n_baskets for r in B.frequent_items(items).collect()} == {
        k[0]: v for k, v in sets.items() if len(k) == 1
    }
    rules = {
        (r.antecedent[0], r.consequent[0]): r.confidence
        for r in model.associationRules.where("size(antecedent) = 1").collect()
    }
    for r in B.association_rules(items).collect():
        assert rules[r.antecedent_id, r.consequent_id] == pytest.approx(r.confidence)


def test_product_list_range(spark):
    rules = spark.createDataFrame([], schemas.ASSOCIATION_RULES)
    assert B.product_recommendations(rules, 20).count() == 0
    with pytest.raises(ValueError):
        B.product_recommendations(rules, 21)


def test_association_ties_go_to_the_lower_id(spark):
    rows = [(1, 9, 0.1, 0.5, 2.0), (1, 4, 0.1, 0.5, 2.0), (1, 7, 0.1, 0.6, 2.0)]
    rules = spark.createDataFrame(rows, schemas.ASSOCIATION_RULES)
    got = B.associated_products(rules, 2).orderBy("rank").collect()
    assert [r.recommended_id for r in got] == [7, 4]
    assert B.product_recommendations(rules, 2, product_id=5).count() == 0
    assert B.product_recommendations(rules, 2, product_id=1).count() == 2
