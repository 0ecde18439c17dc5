"""Leading right singular vectors of any score matrix by block Krylov iteration with thick restart.

The cells are dealt to parts once, the products to stretches of ``STRETCH`` codes. One step multiplies a block of columns
by the matrix and by its transpose. Where there are more codes than users, a part holds all cells of its codes, gets their
rows once and exchanges sums for its users; else a part holds all cells of its users and gets the rows of the products it
holds, packed by stretch. Either sends back its sums for the products. The subspace searched is kept as a table of
stretches, with its image, so a step never repeats an earlier one; blocks are added as they come and turned only at a
restart. Rayleigh-Ritz picks the best directions in it; what they lack of being exact, their residuals, is the next block.
Only matrices of the subspace's width reach the driver, whatever the data, and the numbers of stretches hotter than a part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens import constants as C
from cartlens.session import cut_lineage, discard, shuffles_dropped

# Columns of a block beyond the directions asked for, and the fewest worth a pass over the cells.
SPARE_COLUMNS, LEAST_COLUMNS = 10, 16
# The subspace is cut back to its best block beyond this many columns, or five blocks if those are more.
MOST_COLUMNS, MOST_BLOCKS = 320, 5
# Numbers in the table of the subspace, which is read and written anew in every step: a matrix with very many columns is
# cut back sooner, though never below ``MOST_BLOCKS`` blocks.
MOST_NUMBERS = 1 << 26
PASSES = 200
# Codes whose rows are held as one matrix, two to the power of ``_SHIFT``, and about the number of cells of a part.
_SHIFT = 11
STRETCH, PART_CELLS = 1 << _SHIFT, 1 << 20
# Cells of a part of codes: it holds the rows of its own codes only, and a row per user.
CODE_PART_CELLS = 5 << 20
# Length of a residual, as a share of the largest eigenvalue, at which a direction counts as found.
TOLERANCE = 1e-9
_BASIS = "stretch long, q binary, m binary"


class NotConverged(Exception):
    """A direction asked for still has a residual above the tolerance after the last pass."""


class Singular(NamedTuple):
    """``vectors``: ``code, f_0, f_1, …``; strength and residual of each direction, the strongest first."""

    vectors: DataFrame
    strengths: np.ndarray
    residuals: np.ndarray
    passes: int


def singular_vectors(
    cells: DataFrame,
    codes: DataFrame,
    rank: int,
    tolerance: float = TOLERANCE,
    passes: int = PASSES,
) -> Singular:
    """The ``rank`` leading right singular vectors of the cells ``user_id, code, score``.

    ``codes`` lists the columns of the matrix; those without a cell get zeros. A matrix of a few columns
    starts with all of them and is exact after one pass; the steps are the same for every size. Directions
    whose strength is below about 1e-8 of the largest cannot be told from rounding. Where the matrix has
    fewer columns with cells than ``rank``, columns without cells complete the directions at strength zero.
    """
    with shuffles_dropped(cells.sparkSession):
        return _searched(cut_lineage(cells, "cells"), codes, rank, tolerance, passes)


def _searched(cells: DataFrame, codes: DataFrame, rank: int, tolerance: float, passes: int) -> Singular:
    most = max(rank + SPARE_COLUMNS, LEAST_COLUMNS)
    held = cells.select("code").distinct()
    few = sorted(r["code"] for r in held.limit(most + 1).collect())
    number = len(few) if len(few) <= most else held.count()
    width, asked = min(number, most), min(rank, number)
    limit = max(min(MOST_COLUMNS, MOST_NUMBERS // max(number, 1)), MOST_BLOCKS * most)
    held = held if len(few) <= most else cut_lineage(held, "columns")
    kept, block = 0, cut_lineage(_packed(_start(held, few, width), width), "start")
    basis = block.select("stretch", F.lit(b"").alias("q"), F.lit(b"").alias("m"))
    # What crosses between parts and is summed: rows of the users, or of the codes where those are no more.
    shares = _by_code(cells, number) or _by_user(cells)
    turn, values, errors, done = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0
    while width and done < passes:
        done += 1
        wide = _with_shares(basis, block, shares(block, width), kept, width)
        for read in (basis, block) if kept else (block,):
            discard(read)
        basis, size = wide, kept + width
        overlap, product = _grams(basis, size)
        values, turn = _ritz(overlap, product)
        # Beyond the limit only the best block survives: the thick restart.
        full = size + width > limit
        values, turn = (values[:most], turn[:, :most]) if full else (values, turn)
        leading = min(len(values), most)
        inner, cross = _residual_grams(basis, turn[:, :leading], values[:leading])
        errors = np.sqrt(np.diag(inner)) / max(values[0], np.finfo(float).tiny)
        if len(values) >= asked and (errors[:asked] <= tolerance).all():
            break
        choice = _independent(inner, errors)
        if not choice.shape[1]:
            break  # nothing new in the residuals: the subspace is invariant
        block = cut_lineage(_next_block(basis, turn[:, :leading], values[:leading], turn @ (turn.T @ cross), choice), "block")
        kept, width = size, choice.shape[1]
        if full:
            basis, kept = cut_lineage(_turned(basis, turn), "ritz"), len(values)
            discard(wide)
            turn = np.eye(kept)
    found = min(rank, len(values))
    if found < asked or (errors[:found] > tolerance).any():
        worst = float(errors[:found].max(initial=0.0))
        raise NotConverged(f"after {done} passes a residual of {worst:.1e} is left, {tolerance:.1e} asked")
    own = _turned(basis, turn[:, :found]) if done else basis
    vectors = _completed(_unpacked(own, found, found), codes, held, found, rank)
    strengths = np.concatenate([np.sqrt(np.maximum(values[:found], 0)), np.zeros(rank - found)])
    return Singular(vectors, strengths, np.concatenate([errors[:found], np.zeros(rank - found)]), done)


def _start(held: DataFrame, few: list[int], width: int) -> DataFrame:
    """``code, f_0 …``: all columns of a matrix that has no more than ``width``, else reproducible noise."""
    if len(few) <= width:
        return held.select("code", *[(F.col("code") == c).cast("double").alias(f"f_{i}") for i, c in enumerate(few)])
    noise = [
        (F.pmod(F.xxhash64("code", F.lit(C.SEED), F.lit(i)), F.lit(2_000_001)) / 1e6 - 1.0).alias(f"f_{i}")
        for i in range(width)
    ]
    return held.select("code", *noise)


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """``stretch, own``: the rows ``code, f_0 …`` of each stretch as one matrix, codes that are not there as zeros."""

    def pack(found):
        import pyarrow as pa

        codes = found.column("code").to_numpy()
        own = np.zeros(((codes & (STRETCH - 1)).max() + 1, width))
        for k in range(width):
            own[codes & (STRETCH - 1), k] = found.column(f"f_{k}").to_numpy()
        return pa.table({"stretch": [int(codes[0]) >> _SHIFT], "own": [own.tobytes()]})

    return rows.groupBy(F.shiftright("code", _SHIFT).alias("stretch")).applyInArrow(pack, "stretch long, own binary")


def _unpacked(basis: DataFrame, size: int, found: int) -> DataFrame:
    """``code, f_0 …``: the first ``found`` directions of the ``size`` that a basis holds, a row per code."""
    names = [f"f_{i}" for i in range(found)]

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for stretch, q in _each(batches, "q"):
            q = _matrix(q, size)
            codes = (stretch << _SHIFT) + np.arange(len(q))
            yield pa.RecordBatch.from_arrays([pa.array(codes), *map(pa.array, np.ascontiguousarray(q[:, :found].T))], ["code", *names])

    return basis.select("stretch", "q").mapInArrow(rows, ", ".join(["code long", *(f"{n} double" for n in names)]))


def _each(batches: Iterator, *names: str) -> Iterator[tuple]:
    """The stretch and the named columns of each row."""
    for batch in batches:
        places = [batch.schema.get_field_index(n) for n in ("stretch", *names)]
        for at in range(batch.num_rows):
            stretch, *values = (batch.column(p)[at] for p in places)
            yield stretch.as_py(), *(v.as_buffer() for v in values)


def _matrix(packed, width: int) -> np.ndarray:
    rows = np.frombuffer(packed, np.float64) if packed.size else np.zeros(0)
    return rows.reshape(-1, width) if width else rows.reshape(0, 0)


def _parts(cells: DataFrame) -> DataFrame:
    """The matrix as one row per part of the users: its codes, rising, and for each cell the user's and code's place."""

    def pack(key, found):
        import pyarrow as pa

        users, owners = np.unique(found.column("user_id").to_numpy(), return_inverse=True)
        codes, places = np.unique(found.column("code").to_numpy(), return_inverse=True)
        scores = found.column("score").to_numpy()
        packed = [codes.astype(np.int64), owners.astype(np.int32), places.astype(np.int32), scores]
        return pa.table({"part": [key[0].as_py()], **{n: [v.tobytes()] for n, v in zip(("codes", "owners", "places", "scores"), packed)}})

    # A user without an id is no row of the matrix.
    known = cells.where(F.col("user_id").isNotNull())
    number = max(1, -(-known.count() // PART_CELLS))
    dealt = known.select(F.pmod(F.xxhash64("user_id"), F.lit(number)).alias("part"), "user_id", "code", F.col("score").cast("double").alias("score"))
    schema = "part long, codes binary, owners binary, places binary, scores binary"
    return cut_lineage(dealt.groupBy("part").applyInArrow(pack, schema), "parts")


_WANTED = "stretch long, part long, rows binary"
_SHARES = "stretch long, part long, rows binary, image binary"


def _by_stretch(batches: Iterator) -> Iterator:
    """Task function: the rows of each stretch that each part holds."""
    import pyarrow as pa

    for batch in batches:
        for at in range(batch.num_rows):
            codes = np.frombuffer(batch.column(1)[at].as_buffer(), np.int64)
            stretches, first = np.unique(codes >> _SHIFT, return_index=True)
            rows = np.split((codes & (STRETCH - 1)).astype(np.int32), first[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(stretches), pa.array(np.full(len(stretches), batch.column(0)[at].as_py())), pa.array([r.tobytes() for r in rows])],
                ["stretch", "part", "rows"],
            )


def _by_user(cells: DataFrame) -> Callable:
    """Shares of a block's image by parts of the users."""
    parts = _parts(cells)
    wanted = cut_lineage(parts.select("part", "codes").mapInArrow(_by_stretch, _WANTED), "wanted")
    return lambda block, width: _user_shares(parts, wanted, block, width)


def _user_shares(parts: DataFrame, wanted: DataFrame, block: DataFrame, width: int) -> DataFrame:
    """Shares of the block's image from parts of the users, each of which gets the rows of its codes."""

    def sent(asked, held):
        """The rows of one stretch for every part that holds some of them."""
        import pyarrow as pa

        if not len(asked):
            return pa.table({"part": pa.array([], pa.int64()), "stretch": pa.array([], pa.int64()), "own": pa.array([], pa.binary())})
        own = _matrix(held.column("own")[0].as_buffer(), width)
        rows = [own[np.frombuffer(r.as_buffer(), np.int32)].tobytes() for r in asked.column("rows")]
        return pa.table({"part": asked.column("part"), "stretch": asked.column("stretch"), "own": rows})

    def multiplied(held, got):
        """A part's share of the image of the rows it got."""
        import pyarrow as pa

        codes = np.frombuffer(held.column("codes")[0].as_buffer(), np.int64)
        owners, places = (np.frombuffer(held.column(n)[0].as_buffer(), np.int32) for n in ("owners", "places"))
        scores = np.frombuffer(held.column("scores")[0].as_buffer(), np.float64)
        order = np.argsort(got.column("stretch").to_numpy())
        rows = got.column("own").combine_chunks() if got.column("own").num_chunks > 1 else got.column("own").chunk(0)
        own = np.concatenate([_matrix(rows[int(i)].as_buffer(), width) for i in order])
        image = np.empty((len(codes), width))
        for k in range(width):
            column = np.ascontiguousarray(own[:, k])
            users = np.bincount(owners, scores * column[places])
            image[:, k] = np.bincount(places, scores * users[owners], len(codes))
        return pa.table(_by_stretches(held.column("part")[0].as_py(), codes, image))

    rows = wanted.groupBy("stretch").cogroup(block.groupBy("stretch")).applyInArrow(sent, "part long, stretch long, own binary")
    return parts.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(multiplied, _SHARES)


def _by_code(cells: DataFrame, number: int) -> Callable | None:
    """Shares of a block's image by parts of the codes, which hold the block's rows and exchange the sums of their users.

    None for a matrix of one part, where users are no fewer than the ``number`` of codes, or with ids that are no whole numbers.
    """
    known = cells.where(F.col("user_id").isNotNull())
    n, users = known.agg(F.count("*"), F.countDistinct("user_id")).first()
    if n <= PART_CELLS or users >= number or not isinstance(known.schema["user_id"].dataType, T.IntegralType):
        return None
    slots = -(-users // STRETCH)
    parts = _code_parts(known, n, slots)
    homes = cut_lineage(parts.select("part", "codes").mapInArrow(_by_stretch, _WANTED).select("stretch", "part"), "homes")

    def listed(batches: Iterator) -> Iterator:
        """The users of each slot that a part holds."""
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                own, ids = _slots(batch.column(1)[at]), np.frombuffer(batch.column(2)[at].as_buffer(), np.int64)
                numbers, first = np.unique(own, return_index=True)
                ids = [x.tobytes() for x in np.split(ids, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int64()), pa.array(np.full(len(numbers), batch.column(0)[at].as_py())), pa.array(ids)], ["slot", "part", "ids"]
                )

    def seated(found):
        """The place of each part's users among all users of a slot."""
        import pyarrow as pa

        held = [np.frombuffer(x.as_buffer(), np.int64) for x in found.column("ids")]
        every = np.unique(np.concatenate(held))
        seats = [np.searchsorted(every, x).astype(np.int32).tobytes() for x in held]
        return pa.table({"slot": found.column("slot"), "part": found.column("part"), "seats": seats, "n": np.full(len(held), len(every))})

    own = parts.select("part", "slots", "ids").mapInArrow(listed, "slot long, part long, ids binary")
    seats = cut_lineage(own.groupBy("slot").applyInArrow(seated, "slot long, part long, seats binary, n long"), "seats")

    def exchange(block: DataFrame, width: int) -> DataFrame:
        def scored(held, got):
            """A part's share of its users' sums."""
            import pyarrow as pa

            codes, owners, places, scores = _cells(held)
            own = _joined_rows(got, "stretch", width)
            # The rows of the part's stretches, of which it may lack some codes.
            order = np.unique(got.column("stretch").to_numpy())
            sizes = np.array([len(x.as_buffer()) // (8 * width) for x in _ordered(got, "stretch")])
            first = np.cumsum(sizes) - sizes
            own = own[first[np.searchsorted(order, codes >> _SHIFT)] + (codes & (STRETCH - 1))]
            at = _slots(held.column("slots")[0])
            sums = np.empty((len(at), width))
            for k in range(width):
                sums[:, k] = np.bincount(owners, scores * np.ascontiguousarray(own[:, k])[places], len(at))
            slots, first = np.unique(at, return_index=True)
            rows = [sums[a:b].tobytes() for a, b in zip(first, [*first[1:], len(at)])]
            return pa.table({"slot": slots.astype(np.int64), "part": np.full(len(slots), held.column("part")[0].as_py()), "own": rows})

        def summed(held, got):
            """The users' sums over all parts, for every part that holds some of them."""
            import pyarrow as pa

            shares = dict(zip(got.column("part").to_pylist(), got.column("own")))
            total = np.zeros((held.column("n")[0].as_py(), width))
            seats = {p: np.frombuffer(x.as_buffer(), np.int32) for p, x in zip(held.column("part").to_pylist(), held.column("seats"))}
            for part in sorted(seats):
                total[seats[part]] += _matrix(shares[part].as_buffer(), width)
            rows = [total[x].tobytes() for x in seats.values()]
            return pa.table({"part": list(seats), "slot": np.full(len(rows), held.column("slot")[0].as_py()), "own": rows})

        def returned(held, got):
            """A part's share of the image, from the sums of its users."""
            import pyarrow as pa

            codes, owners, places, scores = _cells(held)
            own = _joined_rows(got, "slot", width)
            image = np.empty((len(codes), width))
            for k in range(width):
                image[:, k] = np.bincount(places, scores * np.ascontiguousarray(own[:, k])[owners], len(codes))
            return pa.table(_by_stretches(held.column("part")[0].as_py(), codes, image))

        own, rows = parts.drop("ids"), block.join(homes, "stretch")
        shares = own.groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(scored, "slot long, part long, own binary")
        sums = seats.groupBy("slot").cogroup(shares.groupBy("slot")).applyInArrow(summed, "part long, slot long, own binary")
        return own.drop("slots").groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(returned, _SHARES)

    return exchange


def _code_parts(known: DataFrame, n: int, slots: int) -> DataFrame:
    """The matrix as one row per part of the codes: as in ``_parts``, with the ids and slots of its users, by slot and id."""

    def pack(key, found):
        import pyarrow as pa

        ids, at = found.column("user_id").to_numpy().astype(np.int64), found.column("slot").to_numpy()
        order = np.lexsort((ids, at))
        new = np.r_[True, ids[order][1:] != ids[order][:-1]]
        owners = np.empty(len(ids), np.int32)
        owners[order] = np.cumsum(new) - 1
        codes, places = np.unique(found.column("code").to_numpy(), return_inverse=True)
        packed = [codes.astype(np.int64), owners, places.astype(np.int32), found.column("score").to_numpy(), at[order][new].astype(np.int32), ids[order][new]]
        names = ("codes", "owners", "places", "scores", "slots", "ids")
        return pa.table({"part": [key[0].as_py()], **{n: [v.tobytes()] for n, v in zip(names, packed)}})

    cells = known.select(
        "user_id", "code", F.col("score").cast("double").alias("score"), F.shiftright("code", _SHIFT).alias("stretch"),
        F.pmod(F.xxhash64("user_id"), F.lit(slots)).alias("slot"),
    )
    counts = cells.groupBy("stretch").agg(F.count("*").alias("n"))
    cores = known.sparkSession.sparkContext.defaultParallelism
    number = -(-n // (CODE_PART_CELLS * cores)) * cores
    part = F.pmod(F.xxhash64("stretch"), F.lit(number))
    # A stretch with more cells than a part, of a best seller, is dealt to parts of its own by user.
    hot, first = [], number
    for r in counts.where(F.col("n") > CODE_PART_CELLS).orderBy("stretch").collect():
        hot.append((r["stretch"], first, -(-r["n"] // CODE_PART_CELLS)))
        first += hot[-1][2]
    if hot:
        cells = cells.join(known.sparkSession.createDataFrame(hot, "stretch long, first long, dealt long"), "stretch", "left")
        part = F.coalesce(F.col("first") + F.pmod(F.xxhash64(F.lit(C.SEED), "user_id"), F.col("dealt")), part)
    schema = "part long, codes binary, owners binary, places binary, scores binary, slots binary, ids binary"
    own = cells.select(part.alias("part"), "user_id", "code", "score", "slot")
    return cut_lineage(own.groupBy("part").applyInArrow(pack, schema), "parts")


def _cells(held) -> tuple[np.ndarray, ...]:
    """Codes of a part, and the owner, place and score of its cells."""
    kinds = {"codes": np.int64, "owners": np.int32, "places": np.int32, "scores": np.float64}
    return tuple(np.frombuffer(held.column(n)[0].as_buffer(), kind) for n, kind in kinds.items())


def _slots(packed) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.int32)


def _ordered(got, by: str) -> list:
    own = got.column("own").combine_chunks() if got.column("own").num_chunks > 1 else got.column("own").chunk(0)
    return [own[int(i)] for i in np.argsort(got.column(by).to_numpy())]


def _joined_rows(got, by: str, width: int) -> np.ndarray:
    """Matrices of ``width`` columns one below the other, in the order of ``by``."""
    return np.concatenate([_matrix(x.as_buffer(), width) for x in _ordered(got, by)])


def _by_stretches(part: int, codes: np.ndarray, image: np.ndarray) -> dict:
    stretches, first = np.unique(codes >> _SHIFT, return_index=True)
    ends = [*first[1:], len(codes)]
    here = (codes & (STRETCH - 1)).astype(np.int32)
    return {
        "stretch": stretches, "part": np.full(len(stretches), part),
        "rows": [here[a:b].tobytes() for a, b in zip(first, ends)], "image": [image[a:b].tobytes() for a, b in zip(first, ends)],
    }


def _with_image(parts: DataFrame, wanted: DataFrame, basis: DataFrame, block: DataFrame, kept: int, width: int) -> DataFrame:
    """The basis of ``kept`` columns with the block and its image under the transposed matrix times the matrix."""
    return _with_shares(basis, block, _user_shares(parts, wanted, block, width), kept, width)


def _with_shares(basis: DataFrame, block: DataFrame, shares: DataFrame, kept: int, width: int) -> DataFrame:
    """The basis with the block and the sum of the shares of its image."""

    def joined(held, got):
        """A stretch of the basis with its rows of the block and the sum of the parts' shares."""
        import pyarrow as pa

        schema = pa.schema([("stretch", pa.int64()), ("q", pa.binary()), ("m", pa.binary())])
        if not len(held):
            return schema.empty_table()
        own = _matrix(held.column("own")[0].as_buffer(), width)
        image, met = np.zeros_like(own), np.zeros((len(own), 1), bool)
        for at in np.argsort(got.column("part").to_numpy()):
            rows = np.frombuffer(got.column("rows")[int(at)].as_buffer(), np.int32)
            image[rows] += _matrix(got.column("image")[int(at)].as_buffer(), width)
            met[rows] = True
        sides = [own * met, image]  # a code that only users without an id have met is no column
        if kept:
            sides = [np.hstack([_matrix(held.column(n)[0].as_buffer(), kept), s]) for n, s in zip("qm", sides)]
        return pa.table([held.column("stretch"), *([s.tobytes()] for s in sides)], schema=schema)

    both = basis.join(block, "stretch")
    return cut_lineage(both.groupBy("stretch").cogroup(shares.groupBy("stretch")).applyInArrow(joined, _BASIS), "krylov")


def _summed(frame: DataFrame, make, count: int) -> list[np.ndarray]:
    """Sums over all stretches of ``count`` matrices that ``make`` gives for one: a partial sum per task and row."""

    def partial(found: Iterator) -> Iterator:
        import pyarrow as pa

        total: list = [0.0] * count
        for _, q, m in _each(found, "q", "m"):
            total = [a + b for a, b in zip(total, make(q, m))]
        for k, matrix in enumerate(total):
            if isinstance(matrix, np.ndarray):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(matrix), k)), pa.array(np.arange(len(matrix))), pa.array(list(matrix))],
                    ["k", "i", "sums"],
                )

    def added(found: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        for batch in found:
            for k, i, sums in zip(*(batch.column(c).to_pylist() for c in range(2)), batch.column(2)):
                own = sums.values.to_numpy()
                held[k, i] = held[k, i] + own if (k, i) in held else own
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys]), pa.array([i for _, i in keys]), pa.array([held[x] for x in keys])],
                ["k", "i", "sums"],
            )

    schema = "k long, i long, sums array<double>"
    rows = frame.mapInArrow(partial, schema).repartition("k", "i").mapInArrow(added, schema).collect()
    out: list = [[] for _ in range(count)]
    for row in sorted(rows, key=lambda r: (r["k"], r["i"])):
        out[row["k"]].append(row["sums"])
    return [np.array(m) for m in out]


def _grams(wide: DataFrame, size: int) -> list[np.ndarray]:
    def make(q, m):
        q, m = _matrix(q, size), _matrix(m, size)
        return q.T @ q, q.T @ m

    return _summed(wide, make, 2)


def _ritz(overlap: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues in the subspace, and the turn of its columns to the orthonormal directions."""
    lengths = np.sqrt(np.diag(overlap))
    scale = np.where(lengths > 0, lengths, 1)
    values, vectors = np.linalg.eigh(overlap / np.outer(scale, scale))
    solid = values > 1e-12
    flat = vectors[:, solid] / np.sqrt(values[solid]) / scale[:, None]
    inner = flat.T @ ((product + product.T) / 2) @ flat
    found, turn = np.linalg.eigh((inner + inner.T) / 2)
    return found[::-1], flat @ turn[:, ::-1]


def _turned(wide: DataFrame, turn: np.ndarray) -> DataFrame:
    """The basis in the directions found."""
    size = len(turn)

    def apply(found: Iterator) -> Iterator:
        import pyarrow as pa

        for stretch, *sides in _each(found, "q", "m"):
            turned = [pa.array([(_matrix(s, size) @ turn).tobytes()]) for s in sides]
            yield pa.RecordBatch.from_arrays([pa.array([stretch]), *turned], ["stretch", "q", "m"])

    return wide.mapInArrow(apply, _BASIS)


def _residual_grams(basis: DataFrame, turn: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Inner products of the leading directions' residuals, and of all columns of the basis with them."""
    size = len(turn)

    def make(q, m):
        q = _matrix(q, size)
        r = _matrix(m, size) @ turn - q @ (turn * values)
        return r.T @ r, q.T @ r

    return _summed(basis, make, 2)


def _independent(inner: np.ndarray, errors: np.ndarray) -> np.ndarray:
    """Turn of the residuals to orthonormal columns; lengths and angles lost in rounding are left out."""
    used = np.flatnonzero(errors > 1e-14)
    lengths = np.sqrt(np.diag(inner)[used])
    values, vectors = np.linalg.eigh(inner[np.ix_(used, used)] / np.outer(lengths, lengths))
    solid = values > 1e-10
    turn = np.zeros((len(inner), int(solid.sum())))
    turn[used] = vectors[:, solid] / np.sqrt(values[solid]) / lengths[:, None]
    return turn


def _next_block(basis: DataFrame, turn: np.ndarray, values: np.ndarray, cross: np.ndarray, choice: np.ndarray) -> DataFrame:
    """The residuals of the leading directions without what the basis already holds, in the columns of ``choice``."""
    size, to_image, to_own = len(turn), turn @ choice, (turn * values + cross) @ choice

    def apply(found: Iterator) -> Iterator:
        import pyarrow as pa

        for stretch, q, m in _each(found, "q", "m"):
            r = _matrix(m, size) @ to_image - _matrix(q, size) @ to_own
            yield pa.RecordBatch.from_arrays([pa.array([stretch]), pa.array([r.tobytes()])], ["stretch", "own"])

    return basis.mapInArrow(apply, "stretch long, own binary")


def _completed(own: DataFrame, codes: DataFrame, held: DataFrame, found: int, rank: int) -> DataFrame:
    full = codes.select("code").join(own, "code", "left")
    if found < rank:
        spare = codes.select("code").join(held, "code", "left_anti").orderBy("code").limit(rank - found)
        for i, row in enumerate(spare.collect(), found):  # ``rank`` rows at most
            full = full.withColumn(f"f_{i}", (F.col("code") == row["code"]).cast("double"))
    return full.fillna(0.0)
