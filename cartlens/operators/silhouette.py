"""Mean Euclidean silhouette of several clusterings at once, from the exact distances of all pairs of points.

Points are dealt to chunks; a task gets pairs of chunks, each pair once, and adds up the distances of either chunk's points
to the clusters of the other. Within a chunk the points lie by their labels in all clusterings, so the distances between
two runs of equal labels are summed whole, once for every clustering. A point's sums meet by chunk, where its
silhouette follows; only one total per clustering and chunk reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.session import cut_lineage

# Points of a chunk, and the fewest where more chunks serve more cores.
CHUNK, LEAST_CHUNK = 1 << 14, 1 << 11
# Chunks on either side of a task, which bounds the sums it holds.
_CHUNKS_AT_ONCE = 32
# Distances held at once, points by points, few enough for a core's own cache.
_JUDGED_AT_ONCE, _POINTS_AT_ONCE = 32, 1000
# Tasks per core, so that none ends long after the others.
_TASKS_PER_CORE = 4
# Squared distances below this share of the squared extent lose too many digits as products.
_CLOSE = 1e-12


def silhouettes(vectors: DataFrame, models: dict, most_judged: int | None = None) -> dict[int, float]:
    """Silhouette for each k of ``models``, fitted K-Means, over ``user_id, features``.

    As usual a point alone in its cluster counts 0; with fewer than two clusters in use the value is 0. Every point is
    judged against all points. A caller may ask for the mean over the ``most_judged`` points with the smallest hashes.
    """
    if not models:
        return {}
    ks = sorted(models)
    labelled = vectors
    for k in ks:
        labelled = models[k].transform(labelled).withColumnRenamed("prediction", f"c_{k}")
    judged = F.lit(True)
    if most_judged is not None:
        hashes = labelled.select(F.xxhash64("user_id").alias("h")).orderBy("h").limit(most_judged)
        judged = F.xxhash64("user_id") <= hashes.agg(F.max("h")).scalar()
    points = labelled.select(vector_to_array("features").alias("x"), F.array(*[f"c_{k}" for k in ks]).alias("labels"), judged.alias("judged"))
    sizes = points.select(F.posexplode("labels").alias("at", "label")).groupBy("at", "label").agg(F.count("*").alias("n"))
    widths, counts = [max(2, k) for k in ks], {}
    for row in sizes.collect():  # one row per cluster
        counts[row["at"], row["label"]] = row["n"]
    firsts = np.cumsum([0, *widths])
    number = np.zeros(firsts[-1])
    for (at, label), n in counts.items():
        number[firsts[at] + label] = n
    if not number.any():
        return dict.fromkeys(ks, 0.0)
    chunks = _chunks(points, int(number[: firsts[1]].sum()))
    totals = _totals(chunks, _distance_sums(chunks, firsts), firsts, number)
    used = [(number[a:b] > 0).sum() for a, b in zip(firsts, firsts[1:])]
    return {k: totals[i][0] / totals[i][1] if used[i] > 1 and totals[i][1] else 0.0 for i, k in enumerate(ks)}


def _chunks(points: DataFrame, n: int) -> DataFrame:
    """``chunk, n, x, labels, judged``: points dealt at random, those of a chunk by their labels, as packed arrays."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    number = max(-(-n // CHUNK), min(-(-n // LEAST_CHUNK), 2 * _sides(cores)))

    def pack(key, found):
        import pyarrow as pa

        x, labels = _rows(found.column("x")), _rows(found.column("labels"))
        order = np.lexsort(labels.T[::-1])
        judged = found.column("judged").to_numpy()[order]
        packed = [x[order].astype(np.float64), labels[order].astype(np.int32), judged]
        return pa.table({"chunk": [key[0].as_py()], "n": [len(x)], **{c: [v.tobytes()] for c, v in zip(("x", "labels", "judged"), packed)}})

    # Dealt by place: ids may repeat or be missing.
    dealt = points.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(number)))
    return cut_lineage(dealt.groupBy("chunk").applyInArrow(pack, "chunk long, n long, x binary, labels binary, judged binary"), "chunks")


def _rows(lists) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _sides(cores: int) -> int:
    """Parts on either side of the pairs, for enough tasks."""
    return int(np.ceil(np.sqrt(_TASKS_PER_CORE * cores)))


def _distance_sums(chunks: DataFrame, firsts: np.ndarray) -> DataFrame:
    """``chunk, sums``: shares of the distances of each point of a chunk to every cluster of every clustering."""
    width, tile = int(firsts[-1]), (_JUDGED_AT_ONCE, _POINTS_AT_ONCE)

    def partial(found: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict = {}
        for batch in found:
            names = batch.schema.names
            for at in range(batch.num_rows):
                row = {name: batch.column(i)[at] for i, name in enumerate(names)}
                ids = [row[f"{side}_chunk"].as_py() for side in "ab"]
                (x, own, own_labels), (y, begins, labels) = (_unpacked(row[f"{s}_n"].as_py(), row[f"{s}_x"], row[f"{s}_labels"]) for s in "ab")
                for i, points in zip(ids, (x, y)):
                    total.setdefault(i, np.zeros((len(points), width)))
                member = np.zeros((len(begins), width))
                np.put_along_axis(member, firsts[:-1] + labels, 1, axis=1)
                for p, (first, end) in enumerate(zip(own, [*own[1:], len(x)])):
                    # Within a chunk a pair of runs is met once too, from the first run's side.
                    after = p if ids[0] == ids[1] else 0
                    skipped = begins[after]
                    to_runs, to_own = _between(x[first:end], y[skipped:], begins[after:] - skipped, *tile)
                    total[ids[0]][first:end] += to_runs @ member[after:]
                    others = end if ids[0] == ids[1] else 0
                    total[ids[1]][others:, firsts[:-1] + own_labels[p]] += to_own[others - skipped :, None]
        for chunk, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sums.tobytes()])], ["chunk", "sums"])

    number, cores = chunks.count(), chunks.sparkSession.sparkContext.defaultParallelism
    parts = max(_sides(cores), -(-number // _CHUNKS_AT_ONCE))
    a, b = (
        chunks.repartition(parts).select(*[F.col(c).alias(f"{side}_{c}") for c in ("chunk", "n", "x", "labels")]) for side in "ab"
    )
    pairs = a.hint("shuffle_replicate_nl").join(b, F.col("a_chunk") <= F.col("b_chunk"))
    return pairs.mapInArrow(partial, "chunk long, sums binary")


def _unpacked(n: int, x, labels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of a chunk, and the beginnings and labels of its runs of equal labels."""
    own = np.frombuffer(labels.as_buffer(), np.int32).reshape(n, -1)
    begins = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(axis=1)])
    return np.frombuffer(x.as_buffer(), np.float64).reshape(n, -1), begins, own[begins]


def _between(x: np.ndarray, y: np.ndarray, begins: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances: of each point of ``x`` to each run of ``y``, and of each point of ``y`` to all of ``x``."""
    middle = x.mean(axis=0)
    x, y = x - middle, y - middle
    to_runs, to_x = np.zeros((len(x), len(begins))), np.zeros(len(y))
    length = (x * x).sum(axis=1)
    left = np.column_stack([-2 * x, length, np.ones(len(x))])
    for start in range(0, len(y), columns):
        points = y[start : start + columns]
        square = (points * points).sum(axis=1)
        right = np.vstack([points.T, np.ones(len(points)), square])
        close = _CLOSE * (length.max() + square.max())
        lo, hi = np.searchsorted(begins, start, "right") - 1, np.searchsorted(begins, start + len(points))
        cuts = np.maximum(begins[lo:hi] - start, 0)
        for at in range(0, len(x), rows):
            squares = left[at : at + rows] @ right
            if squares.min() <= close:
                _by_differences(x[at : at + rows], points, squares, close)
            np.sqrt(squares, out=squares)
            to_runs[at : at + rows, lo:hi] += np.add.reduceat(squares, cuts, axis=1)
            to_x[start : start + len(points)] += np.ones(len(squares)) @ squares
    return to_runs, to_x


def _by_differences(x: np.ndarray, y: np.ndarray, squares: np.ndarray, close: float) -> None:
    """Squared distances of close points by differences, not products of lengths: equal points are at distance 0 exactly."""
    row, column = np.nonzero(squares <= close)
    if len(row) * 8 < squares.size:
        squares[row, column] = ((x[row] - y[column]) ** 2).sum(axis=1)
        return
    squares[:] = 0
    for own, other in zip(x.T, y.T):
        side = own[:, None] - other
        np.multiply(side, side, out=side)
        np.add(squares, side, out=squares)


def _totals(chunks: DataFrame, sums: DataFrame, firsts: np.ndarray, number: np.ndarray) -> list:
    """Of each clustering the sum of the judged points' silhouettes and their number."""

    def values(shares, held):
        import pyarrow as pa

        n = held.column("n")[0].as_py()
        labels = np.frombuffer(held.column("labels")[0].as_buffer(), np.int32).reshape(n, -1)
        judged = np.frombuffer(held.column("judged")[0].as_buffer(), bool)
        total = np.zeros((n, int(firsts[-1])))
        for share in shares.column("sums"):
            total += np.frombuffer(share.as_buffer()).reshape(total.shape)
        found = [_values(total, labels[:, i], number, a, b)[judged].sum() for i, (a, b) in enumerate(zip(firsts, firsts[1:]))]
        return pa.table({"at": np.arange(len(found)), "total": found, "n": np.full(len(found), judged.sum())})

    held = chunks.select("chunk", "n", "labels", "judged")
    parts = sums.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(values, "at long, total double, n long")
    rows = parts.groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("at").collect()
    return [(r["total"], r["n"]) for r in rows]


def _values(sums: np.ndarray, labels: np.ndarray, number: np.ndarray, first: int, end: int) -> np.ndarray:
    """Silhouette of each point in the clustering of the clusters ``first`` to ``end``."""
    own = first + labels
    rows = np.arange(len(labels))
    size = number[own]
    inside = sums[rows, own] / np.maximum(size - 1, 1)
    means = sums[:, first:end] / np.maximum(number[first:end], 1)
    means[:, number[first:end] == 0] = np.inf
    means[rows, labels] = np.inf
    outside = means.min(axis=1)
    most = np.maximum(inside, outside)
    alone = ~np.isfinite(outside)
    outside[alone] = most[alone] = 0.0
    return np.where((size > 1) & (most > 0), (outside - inside) / np.where(most > 0, most, 1), 0.0)
