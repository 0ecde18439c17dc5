"""Near duplicates of embeddings by int8 tile products with rigorous error bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.base import scaled_partitions
from cartlens.llm.graph import components
from cartlens.session import cut_lineage

LEAST_COSINE = 0.95
TILE_ROWS = 2048
_CENTRES = 64
_CENTRE_SAMPLE = 4096
_CAPS_AT_ONCE = 1 << 14


def unit_rows(values: list) -> np.ndarray:
    """Vectors in double precision, each divided by its length."""
    x = np.asarray([np.asarray(v, np.float64) for v in values])
    # Scaling first keeps the squares of very large and very small components finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scale and error length of unit vectors: ``|u - scale * code|`` is at most ``error``."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return codes, scale, error


def tile_links(
    left: np.ndarray, right: np.ndarray, least: float, same: bool
) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (row of ``left``, row of ``right``) of unit vectors with cosine ``least`` or more.

    For quantised q and exact u, ``u.v = q.w + q.(v - w) + (u - q).v``, so the quantised product errs by at most
    ``|q| * error(v) + error(u)``. Only pairs that may reach the threshold under this bound are computed anew in
    double precision. Products of 8-bit codes are whole numbers and exact in 32-bit floats up to 2^24.
    """
    (c1, s1, e1), (c2, s2, e2) = quantise(left), quantise(right)
    wide = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    q1 = s1 * np.sqrt((c1.astype(np.float64) ** 2).sum(axis=1))
    d2 = c2.astype(wide).T
    rows, columns = [], []
    for at in range(0, len(left), 256):
        part = slice(at, at + 256)
        product = c1[part].astype(wide) @ d2
        # Whole numbers against a bound rounded down, so nothing possible is lost.
        need = (least - q1[part, None] * e2 - e1[part, None] - 1e-9) / (s1[part, None] * s2)
        i, j = np.nonzero(product >= need)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        exact = np.concatenate(
            [np.einsum("ij,ij->i", left[i[k : k + 65536]], right[j[k : k + 65536]]) for k in range(0, len(i), 65536)]
            or [np.zeros(0)]
        )
        ok = exact >= least
        rows.append(i[ok])
        columns.append(j[ok])
    return np.concatenate(rows), np.concatenate(columns)


def joined(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` positions the smallest one reachable by links ``i, j``."""
    low = np.arange(n)
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            break
    return low


def _pair_links(key, pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one pair of tiles: how many copies each vector is linked to, and links that span the groups."""
    tiles = [pdf[pdf["tile"] == t] for t in sorted(pdf["tile"].unique())]
    first, second = tiles[0], tiles[-1]
    same = len(tiles) == 1
    if same != (key[0] == key[1]):
        return pd.DataFrame({"rep": [], "links": [], "a": [], "b": []}, dtype="int64")
    left = unit_rows(first["embedding"].tolist())
    right = left if same else unit_rows(second["embedding"].tolist())
    i, j = tile_links(left, right, least, same)
    reps1, reps2 = first["rep"].to_numpy(), second["rep"].to_numpy()
    n1, n2 = first["copies"].to_numpy(), second["copies"].to_numpy()
    got1 = np.bincount(i, n2[j], len(left)).astype(np.int64)
    got2 = np.bincount(j, n1[i], len(right)).astype(np.int64)
    # Positions on both sides as one range; each vector hangs on the smallest one it reaches here.
    reps = reps1 if same else np.concatenate([reps1, reps2])
    low = joined(i, j if same else j + len(left), len(reps))
    hangs = np.flatnonzero(low != np.arange(len(low)))
    found = pd.concat([
        pd.DataFrame({"rep": reps1, "links": got1}), pd.DataFrame({"rep": reps2, "links": got2}),
    ])
    found = found[found["links"] > 0]
    found["a"] = found["b"] = -1
    spans = pd.DataFrame({"rep": -1, "links": 0, "a": reps[hangs], "b": reps[low[hangs]]})
    return pd.concat([found, spans]).astype("int64")


@dataclass
class _Centres:
    """Unit vectors that order the tiles, and the angle within which a pair may be linked."""

    vectors: np.ndarray
    reach: float


def _centres(reps: DataFrame, size: int, least: float) -> _Centres:
    """A few far-apart vectors of a bounded sample by a hash; they only order the tiles, results do not depend on them."""
    rows = reps.where(F.col("size") == size).orderBy(F.xxhash64("rep")).limit(_CENTRE_SAMPLE).select("embedding").collect()
    unit = unit_rows([r["embedding"] for r in rows])
    chosen, best = [0], unit @ unit[0]
    while len(chosen) < min(_CENTRES, len(unit)):
        far = int(np.argmin(best))
        chosen.append(far)
        best = np.maximum(best, unit @ unit[far])
    return _Centres(unit[chosen], math.acos(min(1.0, least)) + 1e-6)


def _assign(batches, centres: np.ndarray):
    for pdf in batches:
        if len(pdf):
            cosines = unit_rows(pdf["embedding"].tolist()) @ centres.T
            near = cosines.argmax(axis=1)
            angle = np.arccos(np.clip(cosines[np.arange(len(pdf)), near], -1, 1))
            yield pdf.assign(centre=near.astype("int32"), angle=angle)


def _cap(pdf: pd.DataFrame) -> pd.DataFrame:
    """Direction of the mean of a tile's vectors and the greatest angle to it."""
    unit = unit_rows(pdf["embedding"].tolist())
    mean = unit.sum(axis=0)
    length = np.sqrt(mean @ mean)
    mean = mean / length if length > 1e-9 else unit[0]
    angle = float(np.arccos(np.clip(unit @ mean, -1, 1)).max())
    return pd.DataFrame({"tile": [int(pdf["tile"].iloc[0])], "cap": [mean.tolist()], "angle": [angle]})


def _near_tiles(caps: DataFrame, reach: float) -> DataFrame:
    """Pairs ``x <= y`` of tiles whose caps are close enough for a link, by blocks of caps against all caps."""
    spark, pairs = caps.sparkSession, None
    number = caps.count()
    for first in range(0, max(1, number), _CAPS_AT_ONCE):
        block = caps.where((F.col("tile") >= first) & (F.col("tile") < first + _CAPS_AT_ONCE)).toPandas()
        sent = spark.sparkContext.broadcast(block)

        def near(found, sent=sent):
            own = sent.value
            for pdf in found:
                if len(pdf) and len(own):
                    cosines = np.clip(np.array(pdf["cap"].tolist()) @ np.array(own["cap"].tolist()).T, -1, 1)
                    gap = np.arccos(cosines) - pdf["angle"].to_numpy()[:, None] - own["angle"].to_numpy()
                    i, j = np.nonzero(gap <= reach + 1e-6)
                    x, y = pdf["tile"].to_numpy()[i], own["tile"].to_numpy()[j]
                    yield pd.DataFrame({"x": x[x <= y], "y": y[x <= y]})

        part = caps.mapInPandas(near, "x long, y long")
        pairs = part if pairs is None else pairs.unionAll(part)
    return cut_lineage(pairs, "tile-pairs")


def usable(column: str = "embedding"):
    """Whether a vector has a direction: it holds numbers only, all finite, not all zero."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(x, lambda v: v != 0)


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``.

    Links join vectors of one length whose cosine in double precision is ``least`` or more. Equal vectors are
    one representative with a number of copies, so any number of copies costs one row in the tiles. Vectors near
    one centre stand in one tile; two tiles meet only if the angle between their caps allows a link. A pair
    of tiles gives counts per vector and a spanning forest of its links, never all links. Tiles have
    ``tile_rows`` vectors however many are near one centre.
    Null, empty, zero and non-finite vectors link with nothing. A null vec_id counts as a vector, but is
    never a smallest id unless alone. No rows give no rows; other columns, labels included, are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut_lineage(rows.withColumn("rep", F.when(usable(), F.xxhash64("embedding"))), "vectors")
    reps = rows.where("rep is not null").groupBy("rep", "embedding").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("low")
    )
    reps = cut_lineage(reps.withColumn("size", F.size("embedding")), "reps")
    counted, spans = [], []
    for size in [r["size"] for r in reps.select("size").distinct().orderBy("size").collect()]:
        found = _links_of_size(reps.where(F.col("size") == size), size, least, tile_rows)
        counted.append(found.where("rep != -1").select("rep", "links"))
        spans.append(found.where("a != -1 or b != -1").select("a", "b"))
    empty = spark.createDataFrame([], "rep long, links long")
    links = empty
    for part in counted:
        links = links.unionAll(part)
    edges = spark.createDataFrame([], "a long, b long")
    for part in spans:
        edges = edges.unionAll(part)
    links = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = components(edges).withColumnsRenamed({"node": "rep"})
    info = reps.join(links, "rep", "left").join(named, "rep", "left")
    info = info.select("rep", "copies", "low", F.coalesce("links", F.lit(0)).alias("links"),
                       F.coalesce("component", "rep").alias("component"))
    info = cut_lineage(info, "linked")
    lows = info.groupBy("component").agg(F.min("low").alias("component_id"))
    info = info.join(lows, "component").select("rep", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "rep").join(info, "rep", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("rep").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links_of_size(reps: DataFrame, size: int, least: float, tile_rows: int) -> DataFrame:
    spark = reps.sparkSession
    centres = _centres(reps, size, least)
    sent = spark.sparkContext.broadcast(centres.vectors)  # at most 64 vectors
    placed = reps.select("rep", "copies", "embedding").mapInPandas(
        lambda it: _assign(it, sent.value), "rep long, copies long, embedding array<double>, centre int, angle double"
    )
    placed = cut_lineage(placed, "placed")
    # Rings around each centre with about a tile of vectors; ring bounds from a histogram of angles.
    ring = F.floor(F.col("angle") * 256).cast("int")
    held = placed.groupBy("centre", ring.alias("ring")).agg(F.count("*").alias("n")).collect()  # 64 x 805 rows at most
    at, tiles, number = {}, 0, {}
    for row in sorted(held, key=lambda r: (r["centre"], r["ring"])):
        fill = at.get(row["centre"])
        if fill is None or fill[1] + row["n"] > tile_rows:
            fill = [tiles, 0]
            tiles += max(1, math.ceil(row["n"] / tile_rows))
        parts = max(1, math.ceil(row["n"] / tile_rows))
        number[row["centre"], row["ring"]] = (fill[0], parts)
        at[row["centre"]] = [fill[0], fill[1] + row["n"]]
    where = spark.createDataFrame(
        [(c, r, first, parts) for (c, r), (first, parts) in number.items()], "centre int, ring int, first long, parts int"
    )
    tile = F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))
    tiled = placed.withColumn("ring", ring).join(F.broadcast(where), ["centre", "ring"])
    tiled = cut_lineage(
        tiled.select("rep", "copies", "embedding", tile.alias("tile")).repartition(
            scaled_partitions(spark, tiles, 1), "tile"
        ).sortWithinPartitions("tile"),
        "tiles",
    )
    caps = cut_lineage(
        tiled.groupBy("tile").applyInPandas(lambda pdf: _cap(pdf), "tile long, cap array<double>, angle double"), "caps"
    )
    # One row per tile of many vectors, in blocks of a bounded number.
    pairs = _near_tiles(caps, centres.reach)
    sides = pairs.select("x", "y", F.col("x").alias("tile")).unionAll(
        pairs.where("x != y").select("x", "y", F.col("y").alias("tile"))
    )
    met = tiled.join(sides, "tile")
    found = met.groupBy("x", "y").applyInPandas(
        lambda key, pdf: _pair_links(key, pdf, least), "rep long, links long, a long, b long"
    )
    return cut_lineage(found, "tile-links")
