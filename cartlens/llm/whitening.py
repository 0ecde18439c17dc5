"""Whitening of embeddings: leading components of the exact grid vectors' covariance by spectrum slicing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.base import batches
from cartlens.llm.spectrum import Slices, leading
from cartlens.session import cut_lineage

COMPONENTS = 16
# Entries become whole numbers: GRID parts of one, moved by OFFSET.
GRID, OFFSET = 64, 1_000_000
_FURTHEST = float(1 << 61)
_LARGEST = (1 << 63) - 1


@dataclass
class Space:
    """What the fit list of one vector length says: size, sums, components and how well they whiten."""

    n: int
    sums: list[int]
    found: Slices
    trace: float
    identity_error: float = 0.0

    def __post_init__(self):
        # S / n as a whole number and a rest below one, so that no digit of x is lost when centring.
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], object)
        self.part = np.array([(s % self.n) / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.part

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.found.vectors / np.sqrt(self.found.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """``sum (n x - S)^2`` of each vector, exact; none where it does not fit a long."""
        y = x - self.base
        widest = (float(np.abs(y).max(initial=0)) + 1) * self.n
        if widest * widest * max(1, x.shape[1]) < 1 << 62:
            z = y * self.n - self.rest.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        z = y.astype(object) * self.n - self.rest
        return [int(v) if v <= _LARGEST else None for v in (z * z).sum(axis=1)]


def grid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, x``: vectors of finite numbers on the grid, as long; others are dropped."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.greatest(F.least(c * GRID, F.lit(_FURTHEST)), F.lit(-_FURTHEST))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(held(c)) + F.lit(OFFSET).cast("long")).alias("x"))


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch by length of their vector: places, and a matrix."""
    x = batch.column(batch.schema.get_field_index("x"))
    bounds = x.offsets.to_numpy()
    flat = x.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(bounds)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[bounds[at][:, None] + np.arange(size)]


def _add_rows(held: dict, size: int, matrix: np.ndarray) -> None:
    held[size] = held[size] + matrix if size in held else matrix


def _sum_rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal ``size, i`` added up, entry by entry."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches(found):
        lists = batch.column(2)
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            part = flat[bounds[k] : bounds[k + 1]]
            held[key] = held[key] + part if key in held else part.copy()
    yield from _rows_out(held)


def _rows_out(held: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys = list(held)
    for at in range(0, len(keys), 512):
        part = keys[at : at + 512]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in part], pa.int32()),
                pa.array([k[1] for k in part], pa.int32()),
                pa.array([held[k] for k in part], pa.list_(pa.float64())),
            ],
            ["size", "i", "sums"],
        )


def _products(fit: DataFrame, rows_of) -> dict[int, np.ndarray]:
    """For each vector length the sum of ``r r'`` over the fit list, ``r`` what ``rows_of(size, x)`` makes of x.

    Tasks add up their own vectors; what meets is one row per task and row of the matrix. The driver gets one
    matrix per vector length, however many vectors there are.
    """

    def partial(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches(found):
            for _, x in _by_size(batch):
                r = rows_of(x.shape[1], x)
                _add_rows(held, x.shape[1], r.T @ r)
        yield from _rows_out({(size, i): row for size, m in held.items() for i, row in enumerate(m)})

    schema = "size int, i int, sums array<double>"
    summed = fit.select("x").mapInArrow(partial, schema).repartition("size", "i").mapInArrow(_sum_rows, schema)
    out: dict[int, list] = {}
    for row in sorted(summed.collect(), key=lambda r: (r["size"], r["i"])):
        out.setdefault(row["size"], []).append(row["sums"])
    return {size: np.array(rows) for size, rows in out.items()}


def fit_spaces(fit: DataFrame, most: int = COMPONENTS) -> dict[int, Space]:
    """The space of each vector length among distinct grid vectors ``x``.

    Three passes: exact sums; products of the centred vectors; products of the whitened vectors, whose
    covariance is compared with the identity.
    """
    spark = fit.sparkSession
    entries = fit.select(F.size("x").alias("size"), F.posexplode("x").alias("i", "c"))
    sums = entries.groupBy("size", "i").agg(
        F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("sum")
    )
    spaces: dict[int, Space] = {}
    held: dict[int, list] = {}
    for row in sorted(sums.collect(), key=lambda r: (r["size"], r["i"])):
        held.setdefault(row["size"], []).append(row)
    for size, rows in held.items():
        spaces[size] = Space(rows[0]["n"], [int(r["sum"]) for r in rows], leading(np.zeros((size, size)), 0), 0.0)
    sent = spark.sparkContext.broadcast(spaces)  # a matrix per vector length
    products = _products(fit, lambda size, x: sent.value[size].centred(x))
    for size, space in spaces.items():
        covariance = products[size] / space.n
        space.found, space.trace = leading(covariance, most), float(np.trace(covariance))
    sent2 = spark.sparkContext.broadcast(spaces)
    products = _products(fit, lambda size, x: sent2.value[size].whiten(x))
    for size, space in spaces.items():
        if len(space.found.values):
            space.identity_error = float(np.abs(products[size] / space.n - np.eye(len(space.found.values))).max())
    return spaces


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per vector and component.

    The fit list holds each distinct grid vector once, so copies do not weigh. Components are numbered from 1 by
    falling eigenvalue, at most ``most`` of them; directions without variance are no components, so a fit list
    whose vectors are all alike gives no rows. Vectors that are null, empty or hold null or non-finite entries are
    dropped. Vectors of different lengths are spaces of their own. A null vec_id stays null; rows that repeat
    an id are returned each; other columns are ignored. Entries beyond 2^61 / 64 count as that. A deviation
    that exceeds a long is null.
    """
    rows = grid_vectors(vectors)
    fit = cut_lineage(rows.select("x").distinct(), "grid")
    spaces = fit_spaces(fit, most)
    sent = vectors.sparkSession.sparkContext.broadcast(spaces)

    def project(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            for at, x in _by_size(batch):
                space = sent.value[x.shape[1]]
                k, number = len(space.found.values), len(at)
                if not k:
                    continue
                each = np.repeat(np.arange(number), k)
                columns = [
                    batch.column(0).take(pa.array(at[each])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), number)),
                    pa.array(np.full(number * k, space.n, np.int64)),
                    pa.array(space.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(space.whiten(x).ravel()),
                    pa.array(np.tile(space.found.values / space.trace, number)),
                    pa.array(np.full(number * k, space.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(
        project,
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
