"""Forests of full-grown regression trees for any number of rows.

A node with more rows than a task should hold is split by all tasks: sums per range of values, the best cut by a
window over at most ``BINS`` ranges. Once a node's rows fit, one task grows its whole subtree exactly. Neither the
rows nor the trees ever reach the driver; a forest is a pair of tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.session import cut_lineage

# Distinct feature vectors a task finishes, and scores, at once.
FINISH_VECTORS = 50_000
SCORE_VECTORS = 200_000
# Ranges of each feature where all tasks split a node.
BINS = 256
_MOST_DRAWS = 12
_NODES = "tree int, node string, feature array<int>, threshold array<double>, below array<int>, above array<int>, value array<double>"


@dataclass
class Forest:
    """``splits``: tree, node, feature, threshold of each level split by all tasks; ``subtrees``: the rest.

    A node is named by the turns (B or A, below or above) that lead to it.
    """

    features: list[str]
    trees: int
    splits: list[DataFrame]
    subtrees: DataFrame


def _inputs(features: list[str]) -> list[Column]:
    """Features as doubles; null and NaN lie below every number."""
    least = F.lit(-math.inf)
    return [F.coalesce(F.nanvl(F.col(f).cast("double"), least), least).alias(f"f{i}") for i, f in enumerate(features)]


def _draws(key: list[str], seed: int) -> Column:
    """How often a tree's bootstrap sample holds a row: Poisson with mean 1, from the row's key and the tree alone."""
    u = F.pmod(F.xxhash64(F.lit(seed), "tree", *key), F.lit(1 << 53)) / F.lit(float(1 << 53))
    below, total = [], 0.0
    for k in range(_MOST_DRAWS):
        total += math.exp(-1) / math.factorial(k)
        below.append((u >= total).cast("int"))
    return reduce(lambda a, b: a + b, below)


def _cuts(rows: DataFrame, width: int) -> DataFrame:
    """Best cut ``feature, threshold`` of each ``tree, node``: least squared error among at most ``BINS`` a feature."""
    node = ["tree", "node"]
    grid = [i / BINS for i in range(BINS)]
    edges = rows.groupBy(*node).agg(*[
        F.array_sort(F.array_distinct(F.array_append(F.percentile_approx(f"f{i}", grid, 10_000), F.max(f"f{i}"))))
        .alias(f"e{i}") for i in range(width)
    ])
    edges = cut_lineage(edges, "forest-edges")

    def cell(i: int) -> Column:
        x = F.col(f"f{i}")
        edge = F.element_at(F.filter(f"e{i}", lambda e: e >= x), 1)
        return F.struct(F.lit(i).alias("feature"), x.alias("x"), edge.alias("edge"))

    cells = rows.join(edges, node).select(*node, "w", "wy", F.explode(F.array(*map(cell, range(width)))).alias("at"))
    cells = cells.groupBy(*node, "at.feature", "at.edge").agg(
        F.sum("w").alias("w"), F.sum("wy").alias("wy"), F.min("at.x").alias("low"), F.max("at.x").alias("high")
    )
    whole = Window.partitionBy(*node, "feature")
    far = whole.orderBy("edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.select(
        *node, "feature", "high", F.sum("w").over(far).alias("w"), F.sum("wy").over(far).alias("wy"),
        (F.sum("w").over(whole) - F.sum("w").over(far)).alias("rw"),
        (F.sum("wy").over(whole) - F.sum("wy").over(far)).alias("ry"),
        F.lead("low").over(whole.orderBy("edge")).alias("next"),
    ).where(F.col("next").isNotNull())
    gain = F.col("wy") * F.col("wy") / F.col("w") + F.col("ry") * F.col("ry") / F.col("rw")
    middle = (F.col("high") + F.col("next")) / 2
    threshold = F.when(middle < F.col("next"), middle).otherwise(F.col("high"))
    best = F.max_by(F.struct("feature", threshold.alias("threshold")), F.struct(gain, -F.col("feature"), -F.col("high")))
    return cells.groupBy(*node).agg(best.alias("best")).select(*node, "best.feature", "best.threshold")


def _turn(width: int) -> Column:
    """The node a row goes to, from its node's cut."""
    x = F.element_at(F.array(*[f"f{i}" for i in range(width)]), F.col("feature") + 1)
    return F.concat("node", F.when(x <= F.col("threshold"), "B").otherwise("A"))


def grow(x: np.ndarray, w: np.ndarray, wy: np.ndarray, depth: int | None) -> tuple[np.ndarray, ...]:
    """Nodes ``feature, threshold, below, above, value`` of the tree of the rows ``x`` with weights and weighted sums.

    Each node takes the cut with the least squared error, the lowest feature and value among equals, halfway between
    two values, until its rows agree in their means or in all features. A leaf has feature -1. All nodes of a level
    are cut together, from rows sorted once by every feature, so a tree of many small nodes takes few steps.
    """
    n, width = x.shape
    means, parts = wy / w, []
    # Places of the open rows by feature; rows of a node lie together, nodes in one order in all features.
    order = [np.argsort(x[:, f], kind="stable") for f in range(width)]
    sizes, made, level = np.array([n]), 1, 0
    while len(sizes):
        first = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        weight, total = np.add.reduceat(w[order[0]], first), np.add.reduceat(wy[order[0]], first)
        m = means[order[0]]
        low, high = np.minimum.reduceat(m, first), np.maximum.reduceat(m, first)
        open_ = high - low > 1e-12 * np.maximum(np.abs(low), np.abs(high))
        best = np.full(len(sizes), -np.inf)
        feature, threshold, last = np.full(len(sizes), -1), np.zeros(len(sizes)), np.zeros(len(sizes), int)
        for f in range(width if level != depth else 0):
            xs, sums = x[order[f], f], []
            cut = np.flatnonzero((xs[:-1] < xs[1:]) & (of[:-1] == of[1:]) & open_[of[:-1]])
            if not len(cut):
                continue
            node = of[cut]
            for column in (w, wy):
                run = np.cumsum(column[order[f]])
                sums.append(run[cut] - np.where(first > 0, run[first - 1], 0.0)[node])
            gain = sums[1] ** 2 / sums[0] + (total[node] - sums[1]) ** 2 / (weight[node] - sums[0])
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            top = np.maximum.reduceat(gain, start)
            at = np.flatnonzero(gain == np.repeat(top, np.diff(np.r_[start, len(node)])))
            at = at[np.r_[True, node[at][1:] != node[at][:-1]]]  # the lowest of equal cuts
            better = (best[node[at]] == -np.inf) | (top > best[node[at]] * (1 + 1e-12))
            at, top = at[better], top[better]
            under, over = xs[cut[at]], xs[cut[at] + 1]
            with np.errstate(invalid="ignore"):
                middle = (under + over) / 2
            chosen = node[at]
            best[chosen], feature[chosen], last[chosen] = top, f, cut[at]
            threshold[chosen] = np.where(middle < over, middle, under)
        split = feature >= 0
        child = np.where(split, made + 2 * (np.cumsum(split) - 1), -1)
        parts.append((feature, threshold, child, np.where(split, child + 1, -1), total / weight))
        made, level = made + 2 * int(split.sum()), level + 1
        # Above or below its node's cut, by the cut's place in the order of its feature.
        side = np.zeros(n, bool)
        for f in np.unique(feature[split]):
            places = np.flatnonzero(feature[of] == f)
            side[order[f][places]] = places > last[of[places]]
        kept = split[of]
        group = 2 * (np.cumsum(split) - 1)[of[kept]]
        for f in range(width):
            rows = order[f][kept]
            order[f] = rows[np.argsort(group + side[rows], kind="stable")]
        sizes = np.bincount(group + side[order[0]], minlength=2 * int(split.sum())) if kept.any() else np.zeros(0, int)
    return tuple(np.concatenate(c) for c in zip(*parts))


def leaf_values(x: np.ndarray, nodes: tuple) -> np.ndarray:
    """What the tree says of each row."""
    feature, threshold, below, above, value = (np.asarray(c) for c in nodes)
    at = np.zeros(len(x), int)
    rows = np.flatnonzero(feature[at] >= 0)
    while len(rows):
        here = at[rows]
        low = x[rows, feature[here]] <= threshold[here]
        at[rows] = np.where(low, below[here], above[here])
        rows = rows[feature[at[rows]] >= 0]
    return value[at]


def fit_full_forest(
    train: DataFrame, features: list[str], label: str, key: list[str], trees: int, seed: int,
    max_depth: int | None = None, bootstrap: bool = True, finish: int = FINISH_VECTORS,
) -> Forest:
    """Regression trees over all features at each cut, as deep as the rows allow (or ``max_depth``).

    A tree's sample is drawn by the ``key`` columns of a row, so rows alike in all of them are drawn together and
    layout does not matter. Rows with equal features combine before anything else: a cut needs only their number and
    sum. Nodes above ``finish`` distinct vectors are cut among ``BINS`` quantiles of the node, others exactly. Rows
    without a label count for nothing; null features lie below every number; no rows give a forest that predicts null.
    """
    width = len(features)
    x = [f"f{i}" for i in range(width)]
    rows = train.where(F.col(label).isNotNull()).withColumn("tree", F.explode(F.array(*map(F.lit, range(trees)))))
    rows = rows.withColumn("w", _draws(key, seed) if bootstrap else F.lit(1)).where("w > 0")
    rows = rows.select("tree", *_inputs(features), F.col("w").cast("double"), (F.col(label) * F.col("w")).cast("double").alias("wy"))
    rows = rows.groupBy("tree", *x).agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    rows = cut_lineage(rows.withColumn("node", F.lit("")), "forest-rows")
    splits, parts, level = [], [], 0
    while True:
        sizes = rows.groupBy("tree", "node").agg(F.count("*").alias("vectors"))
        large = cut_lineage(sizes.where(F.col("vectors") > finish).select("tree", "node"), "forest-large")
        small = rows.join(large, ["tree", "node"], "left_anti")
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(small)
        rows = rows.join(large, ["tree", "node"], "left_semi")
        if level == max_depth:
            # Leaves, of any size: one row each.
            parts.append(rows.groupBy("tree", "node").agg(
                *[F.min(c).alias(c) for c in x], F.sum("w").alias("w"), F.sum("wy").alias("wy")
            ))
            break
        splits.append(cut_lineage(_cuts(rows, width), "forest-splits"))
        rows = rows.join(splits[-1], ["tree", "node"]).withColumn("node", _turn(width)).drop("feature", "threshold")
        rows, level = cut_lineage(rows, "forest-rows"), level + 1

    def finished(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        node = pdf["node"].iloc[0]
        left = None if max_depth is None else max_depth - len(node)
        grown = grow(pdf[x].to_numpy(float), pdf["w"].to_numpy(float), pdf["wy"].to_numpy(float), left)
        return pd.DataFrame([(pdf["tree"].iloc[0], node, *grown)], columns=[c.split()[0] for c in _NODES.split(", ")])

    rest = reduce(DataFrame.unionByName, parts)
    return Forest(features, trees, splits, cut_lineage(rest.groupBy("tree", "node").applyInPandas(finished, _NODES), "forest"))


def predict(forest: Forest, rows: DataFrame, column: str = "prediction", most: int = SCORE_VECTORS) -> DataFrame:
    """``rows`` with the mean of the trees' values.

    Distinct vectors are led down the levels by joins and meet their subtrees in groups of at most about ``most``;
    a subtree that many vectors reach is copied to several groups.
    """
    width = len(forest.features)
    x = [f"f{i}" for i in range(width)]
    asked = cut_lineage(rows.select(*_inputs(forest.features)).distinct(), "forest-asked")
    at = asked.withColumn("tree", F.explode(F.array(*map(F.lit, range(forest.trees))))).withColumn("node", F.lit(""))
    for cuts in forest.splits:
        met = at.join(cuts, ["tree", "node"], "left")
        at = met.withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(_turn(width)))
        at = at.drop("feature", "threshold")
    at = cut_lineage(at, "forest-at")
    parts = at.groupBy("tree", "node").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts"))
    group = ["tree", "node", "part"]
    at = at.join(parts, ["tree", "node"]).withColumn("part", F.pmod(F.xxhash64(*x), "parts").cast("int")).drop("parts")
    trees = forest.subtrees.join(parts, ["tree", "node"])
    trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def told(vectors: pd.DataFrame, subtree: pd.DataFrame) -> pd.DataFrame:
        out = vectors[x].copy()
        if len(subtree):
            nodes = tuple(subtree[c].iloc[0] for c in ("feature", "threshold", "below", "above", "value"))
            out["value"] = leaf_values(out[x].to_numpy(float), nodes)
        else:
            out["value"] = None
        return out

    values = at.groupBy(*group).cogroup(trees.groupBy(*group)).applyInPandas(
        told, ", ".join(f"{c} double" for c in [*x, "value"])
    )
    values = cut_lineage(values.groupBy(*x).agg(F.avg("value").alias(column)), "forest-values")
    keyed = rows.withColumns({f"_{c}": e for c, e in zip(x, _inputs(forest.features))})
    same = reduce(lambda a, b: a & b, [keyed[f"_{c}"] == values[c] for c in x])
    return keyed.join(values, same, "left").drop(*x, *[f"_{c}" for c in x])
