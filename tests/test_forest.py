"""Full-grown forests against a plain recursion."""

import random

import numpy as np
import pytest

from cartlens.operators import forest as FO

FEATURES = ["a", "b", "c"]
SCHEMA = "id long, a double, b int, c double, y int, w string, node string"


def _rows(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.randrange(9) / 2, rng.randrange(6)
        c = None if rng.random() < 0.1 else rng.random()
        rows.append((i, a, b, c, int(10 * a + (b > 2) * 30 + rng.randrange(25)), "x", "clash"))
    return rows + rows[:4]


def _x(rows):
    return np.array([[-np.inf if v is None else float(v) for v in r[1:4]] for r in rows])


def _grown(x, y, depth):
    """The tree as nested tuples, every cut tried by its squared error."""
    if depth == 0 or np.ptp(y) == 0 or (x == x[0]).all():
        return y.mean()
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] <= low
            error = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
            if best is None or error < best[0] - 1e-7:
                best = error, f, (low + high) / 2, left
    _, f, cut, left = best
    return f, cut, _grown(x[left], y[left], depth - 1), _grown(x[~left], y[~left], depth - 1)


def _told(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth", [None, 3])
@pytest.mark.parametrize("finish", [1000, 12])
def test_one_tree_equals_a_plain_recursion(spark, finish, depth):
    rows = _rows(70)
    train = spark.createDataFrame(rows, SCHEMA).repartition(3)
    forest = FO.fit_full_forest(train, FEATURES, "y", ["id"], 1, 42, depth, bootstrap=False, finish=finish)
    assert bool(forest.splits) == (finish == 12)
    tree = _grown(_x(rows), np.array([r[4] for r in rows], float), -1 if depth is None else depth)
    asked = _rows(60, seed=9)
    found = FO.predict(forest, spark.createDataFrame(asked, SCHEMA), most=10).collect()
    assert len(found) == len(asked) and found[0].w == "x" and found[0].node == "clash"
    want = {r[0]: _told(tree, x) for r, x in zip(asked, _x(asked))}
    assert {r.id: pytest.approx(r.prediction) for r in found} == want


def test_a_forest_is_the_mean_of_trees_over_their_draws(spark):
    rows = _rows(50)
    train = spark.createDataFrame(rows, SCHEMA)
    whole = FO.fit_full_forest(train, FEATURES, "y", ["id"], 6, 42)
    cut = FO.fit_full_forest(train.repartition(4), FEATURES, "y", ["id"], 6, 42, finish=9)
    told = [{r.id: r.prediction for r in FO.predict(f, train).collect()} for f in (whole, cut)]
    assert told[0] == pytest.approx(told[1])
    y = {r[0]: r[4] for r in rows}
    error = np.mean([abs(told[0][i] - y[i]) for i in y])
    assert 0 < error < np.mean(np.abs(np.array(list(y.values())) - np.mean(list(y.values())))) / 2
    nodes = whole.subtrees.collect()
    assert len(nodes) == 6 and len({tuple(r.threshold) for r in nodes}) == 6


def test_a_hot_vector_is_one_row(spark):
    hot = [(i, 1.0, 1, 0.5, i % 7, "x", "n") for i in range(4000)]
    train = spark.createDataFrame(hot + _rows(30), SCHEMA)
    forest = FO.fit_full_forest(train, FEATURES, "y", ["id"], 1, 42, bootstrap=False, finish=10)
    got = {r.prediction for r in FO.predict(forest, train.where("a = 1.0 and b = 1 and c = 0.5")).collect()}
    assert len(got) == 1 and got.pop() == pytest.approx(np.mean([i % 7 for i in range(4000)]))


def test_nothing_to_learn_from(spark):
    rows = spark.createDataFrame(_rows(5), SCHEMA)
    empty = FO.fit_full_forest(rows.limit(0), FEATURES, "y", ["id"], 2, 42)
    assert {r.prediction for r in FO.predict(empty, rows).collect()} == {None}
    assert FO.predict(FO.fit_full_forest(rows, FEATURES, "y", ["id"], 2, 42), rows.limit(0)).count() == 0


def test_a_tree_of_many_small_nodes_takes_few_steps(monkeypatch):
    """Nodes of a level are cut together: rows are sorted per level and feature, not per node."""
    rng, calls, sort = np.random.default_rng(3), [], np.argsort
    x = np.unique(np.c_[rng.integers(0, 40, 3000), rng.random(3000)], axis=0)
    w = np.ones(len(x))
    y = rng.integers(1, 365, len(x)).astype(float)
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or sort(*a, **k))
    nodes = FO.grow(x, w, y, None)
    assert len(nodes[0]) > 5000 and len(calls) < 500
    assert (FO.leaf_values(x, nodes) == y).all()
