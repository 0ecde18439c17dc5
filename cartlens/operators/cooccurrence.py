"""Sums of products over item pairs that share a group.

Counting pairs with a self-join writes every pair of a group as a row. Here the
pairs are summed inside the tasks: rows arrive clustered by group, each chunk is
added up with numpy, and only one partial sum per distinct item pair leaves the
task. A group wider than ``tile`` items is cut into parts, and every pair of
parts becomes its own piece of work, so no group is bound to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ITEMS = 4096
CHUNK_ROWS = 1 << 18
CELL = ["item", "weight", "wanted"]
PAIR_SCHEMA = "item_a long, item_b long, total double"


def pair_sums(
    rows: DataFrame,
    group: str,
    item: str,
    weight: str | None = None,
    wanted: str | None = None,
    tile: int = TILE_ITEMS,
) -> DataFrame:
    """``item_a < item_b, total``: the sum over groups of weight_a * weight_b.

    ``rows`` holds each (group, item) once; without ``weight`` every row weighs 1.
    ``wanted``, a boolean column that depends on the item, restricts the result to
    pairs with a wanted item on at least one side.
    """
    narrow, wide = dealt(rows, group, item, weight, wanted, tile)
    summer = _chunk_summer(CHUNK_ROWS, wanted is None)
    partial = [
        part.sortWithinPartitions("grp", "lo", "hi", "item").mapInArrow(summer, PAIR_SCHEMA)
        for part in (narrow, wide)
    ]
    return (
        partial[0]
        .unionAll(partial[1])
        .groupBy("item_a", "item_b")
        .agg(F.sum("total").alias("total"))
    )


def dealt(
    rows: DataFrame, group: str, item: str, weight: str | None, wanted: str | None, tile: int
) -> tuple[DataFrame, DataFrame]:
    """The rows as work for tasks: narrow groups whole, wide ones cut into pairs of parts.

    Sizes come from partial sums, so no task ever holds a hot group. The wide groups are few, at most one per
    ``tile`` rows, and joining them back splits a hot one where Spark does not broadcast them.
    """
    cells = rows.select(
        F.col(group).alias("grp"),
        F.col(item).alias("item"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
        (F.col(wanted) if wanted else F.lit(True)).alias("wanted"),
    )
    sizes = cells.groupBy("grp").agg(F.count("*").alias("n_items"), F.max("wanted").alias("any_wanted"))
    wide_groups = sizes.where(F.col("n_items") > tile).select(
        F.col("grp").alias("wide"), F.ceil(F.col("n_items") / tile).cast("int").alias("parts"), "any_wanted"
    )
    marked = cells.join(wide_groups, F.col("grp") == F.col("wide"), "left")
    narrow = marked.where("wide is null").select(
        "grp", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("part"), *CELL
    )
    wide = (
        marked.where("any_wanted")
        .withColumn("part", F.pmod(F.xxhash64("item"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "grp",
            F.least("part", "other").alias("lo"),
            F.greatest("part", "other").alias("hi"),
            "part",
            *CELL,
        )
    )
    return narrow.repartition("grp"), wide.repartition("grp", "lo", "hi")


def both_directions(pairs: DataFrame, *values: str) -> DataFrame:
    """Each pair once from either side, as ``item, other``."""
    sides = F.array(
        F.struct(F.col("item_a").alias("item"), F.col("item_b").alias("other")),
        F.struct(F.col("item_b").alias("item"), F.col("item_a").alias("other")),
    )
    return pairs.select(F.inline(sides), *values)


def _chunk_summer(chunk_rows: int, all_wanted: bool):
    """Task function: sum the pairs of sorted, clustered rows chunk by chunk."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["grp", "lo", "hi", "part", "item", "weight", "wanted"]
        slice_pairs = 1 << 21

        def totals(keys, values, cells):
            if cells <= slice_pairs:
                found = np.flatnonzero(np.bincount(keys, minlength=cells))
                return found, np.bincount(keys, weights=values, minlength=cells)[found]
            found, where = np.unique(keys, return_inverse=True)
            return found, np.bincount(where, weights=values)

        def partner_ranges(cols):
            """Rows with the first and last+1 row of their partners within the group."""
            change = np.ones(len(cols["item"]) + 1, dtype=bool)
            change[1:-1] = False
            for name in ("grp", "lo", "hi"):
                change[1:-1] |= cols[name][1:] != cols[name][:-1]
            starts = np.flatnonzero(change)
            sizes = np.diff(starts)
            row, end = np.arange(sizes.sum()), np.repeat(starts[1:], sizes)
            if all_wanted:
                return row, row + 1, end
            row = np.flatnonzero(cols["wanted"])
            return row, np.repeat(starts[:-1], sizes)[row], end[row]

        def pairs_of(cols):
            """Yield summed pairs, a bounded number of pairs at a time."""
            items, code = np.unique(cols["item"], return_inverse=True)
            width = len(items)
            row, first, end = partner_ranges(cols)
            size = end - first
            piece = np.cumsum(size) // slice_pairs
            for cut in np.split(np.arange(len(row)), np.flatnonzero(np.diff(piece)) + 1):
                n = size[cut]
                if not n.sum():
                    continue
                a = np.repeat(row[cut], n)
                b = np.arange(n.sum()) + np.repeat(first[cut] - (np.cumsum(n) - n), n)
                kept = (cols["lo"][a] == cols["hi"][a]) | (cols["part"][a] != cols["part"][b])
                if not all_wanted:
                    # A pair of two wanted items shows up from both sides.
                    kept &= (a != b) & ~(cols["wanted"][b] & (b < a))
                a, b = a[kept], b[kept]
                if not len(a):
                    continue
                # Rows are in item order within a group, so the lower row is item_a.
                keys = code[np.minimum(a, b)] * width + code[np.maximum(a, b)]
                found, sums = totals(keys, cols["weight"][a] * cols["weight"][b], width * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items[found // width]), pa.array(items[found % width]), pa.array(sums)],
                    names=["item_a", "item_b", "total"],
                )

        def columns(table):
            return {n: table[n].to_numpy() for n in names}

        def settled(tables):
            """Split the rows before the last, maybe unfinished, group from the rest."""
            table = pa.concat_tables(tables).combine_chunks()
            cols = columns(table)
            last = np.ones(table.num_rows, dtype=bool)
            for name in ("grp", "lo", "hi"):
                last &= cols[name] == cols[name][-1]
            cut = int(np.argmax(last))
            return {n: c[:cut] for n, c in cols.items()}, table.slice(cut)

        pending, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pending.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            if count >= chunk_rows:
                done, rest = settled(pending)
                pending, count = [rest], 0
                if len(done["item"]):
                    yield from pairs_of(done)
        if pending:
            yield from pairs_of(columns(pa.concat_tables(pending).combine_chunks()))

    return run
