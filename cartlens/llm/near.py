"""Near duplicates by BagMinHash signatures of word shingles, with exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm import words as WD
from cartlens.llm.base import WORD, batches, texts, whole
from cartlens.llm.graph import components
from cartlens.session import cut_lineage

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
# A tile of a bucket whose members are compared within one task.
TILE_SHINGLES = 1 << 19
_TEXT_BYTES = 1 << 20
_ONE = np.uint64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray, length: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words and the text of each; a shorter text is one run of all its words."""
    found = WD.split(raw, offsets)
    starts, hashes = WD.runs(found, length)
    rows = found.rows[starts]
    counts = np.diff(found.bounds)
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        hashes = np.concatenate([hashes, WD.spans_hash(found.hashes, found.bounds[short], found.bounds[short + 1])])
        rows = np.concatenate([rows, short])
    return hashes, rows


def bags(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by row and value, and how often each occurs."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return hashes[first], rows[first], np.diff(np.append(first, len(hashes)))


def _uniform(seeds: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) drawn from seeds."""
    return ((WD.mix(seeds, salt) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _leaves(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray, rate: float, most: np.ndarray):
    """First points of the unit weights above the first, ``(seed, row, time)``, by splitting Poisson processes.

    The weight axis above 1 is cut into [1, 2), [2, 4), [4, 8) and so on. Each part has one process with a rate
    in proportion to its width. A part splits into halves: its first point falls into one of them by a coin of
    the part, the other half starts a process of its own from that time on. The coins depend on the shingle and
    the part alone, so bags of any weights see the same points. Halves beyond the weight, and halves whose first
    point comes after all points that the row still needs, are not followed.
    """
    seeds, at, times = [], [], []
    width = 1
    while True:
        inside = counts > width
        if not inside.any():
            break
        h, r, w = hashes[inside], rows[inside], counts[inside]
        low = np.full(len(h), width, np.int64)
        part = WD.mix(h ^ np.uint64(width), 11)
        time = -np.log(_uniform(part, 12)) / (rate * width)
        size = width
        while True:
            keep = (low < w) & (time <= most[r])
            h, r, w, low, part, time = (x[keep] for x in (h, r, w, low, part, time))
            if size == 1 or not len(h):
                break
            size //= 2
            left, right = WD.mix(part, 13), WD.mix(part, 14)
            other = time - np.log(_uniform(part, 15)) / (rate * size)
            first = _uniform(part, 16) < 0.5
            time = np.concatenate([np.where(first, time, other), np.where(first, other, time)])
            h, r, w = np.tile(h, 2), np.tile(r, 2), np.tile(w, 2)
            low = np.concatenate([low, low + size])
            part = np.concatenate([left, right])
        seeds.append(part)
        at.append(r)
        times.append(time)
        width *= 2
    if not seeds:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(seeds), np.concatenate(at), np.concatenate(times)


def signatures(hashes: np.ndarray, rows: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """BagMinHash signatures ``[row, component]`` of weighted bags; 0 where a row has no shingle.

    Each shingle and unit of weight has a Poisson process in time whose points go to random components; a
    component keeps the unit with its earliest point. Two bags agree in a component with a probability equal
    to their weighted Jaccard similarity. Points after the latest one a row needs are never drawn.
    """
    best = np.full(n * size, np.inf)
    owner = np.zeros(n * size, np.uint64)
    rate = float(size)

    def latest() -> np.ndarray:
        return best.reshape(n, size).max(axis=1)

    def play(seed: np.ndarray, row: np.ndarray, time: np.ndarray) -> None:
        step = 0
        limit = latest()
        while len(seed):
            if step % 8 == 7:
                limit = latest()
            keep = time <= limit[row]
            seed, row, time = seed[keep], row[keep], time[keep]
            draw = WD.mix(seed, 20 + 2 * step)
            place = row * size + (draw % np.uint64(size)).astype(np.int64)
            np.minimum.at(best, place, time)
            won = best[place] == time
            owner[place[won]] = seed[won]
            time = time - np.log(_uniform(draw, 21)) / rate
            step += 1

    first = WD.mix(hashes, 10)
    play(first, rows, -np.log(_uniform(first, 12)) / rate)
    play(*_leaves(hashes, rows, counts, rate, latest()))
    return owner.reshape(n, size)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of rows with about a megabyte of text, and the bags of their shingles."""
    raw, offsets = texts(batch)
    groups = offsets[:-1] // _TEXT_BYTES
    for group in np.unique(groups):
        a, b = (int(np.searchsorted(groups, group, side=side)) for side in ("left", "right"))
        yield a, b - a, *bags(*shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


def _bag_hash(h: np.ndarray, c: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    values = WD.mix(h ^ c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return WD.spans_hash(values, cuts[:-1], cuts[1:]).view(np.int64)


def _sign(found: Iterator[pa.RecordBatch], bands: int, per_band: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(found):
        for a, n, h, r, c in _parts(batch):
            sign = signatures(h, r, c, n, bands * per_band)
            cuts = np.searchsorted(r, np.arange(n + 1))
            starts = np.arange(n * bands) * per_band
            keys = WD.spans_hash(sign.reshape(-1), starts, starts + per_band)
            keys = WD.mix(keys ^ np.tile(np.arange(bands, dtype=np.uint64), n), 30)
            bounds = pa.array((np.arange(n + 1) * bands).astype(np.int32))
            keys = pa.ListArray.from_arrays(bounds, pa.array(keys.view(np.int64)))
            total = np.bincount(r, c, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x).slice(a, n) for x in ("doc_id", "body")),
                 pa.array(_bag_hash(h, c, cuts)), pa.array(total), keys],
                ["doc_id", "body", "bag", "n", "keys"],
            )


def _bag_rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(found):
        for _, n, h, r, c in _parts(batch):
            cuts = np.searchsorted(r, np.arange(n + 1))
            lists = [
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x))
                for x in (h.view(np.int64), c.astype(np.int32))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(_bag_hash(h, c, cuts)), *lists], ["bag", "shingles", "counts"])


def _verify(found: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Exact weighted Jaccard of pairs of bags."""
    for batch in batches(found):
        columns = [batch.column(c) for c in ("h1", "c1", "h2", "c2")]
        out = []
        for i in range(batch.num_rows):
            h1, c1, h2, c2 = (np.asarray(c[i].values) for c in columns)
            _, at1, at2 = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
            shared = np.minimum(c1[at1], c2[at2]).sum()
            out.append(shared >= least * (c1.sum() + c2.sum() - shared) - 1e-9)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "similar"]
        )


@dataclass
class NearGroups:
    """``members``: doc_id, bag, group_id (smallest doc_id of the class), group_size, kept; ``links``: a, b of bags;
    ``chosen``: doc_id, body (hash of the text) of one row of each class that has words."""

    members: DataFrame
    links: DataFrame
    chosen: DataFrame


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _shingles_of(used: DataFrame, docs: DataFrame, bag: DataFrame) -> DataFrame:
    """``bag, shingles, counts`` of the bags in ``used``, made again from one document of each and no others."""
    wanted = bag.join(used, "bag").select(F.col("doc_id").alias("rep"), F.col("body").alias("rep_body"))
    rows = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["rep"]) & (docs["body"] == wanted["rep_body"]), "left_semi")
    return cut_lineage(
        rows.select("text").mapInArrow(_bag_rows, "bag long, shingles array<long>, counts array<int>"), "shingles"
    )


def _similar(pairs: DataFrame, shingles_of: DataFrame, least: float) -> DataFrame:
    """Pairs ``a < b`` of bags whose weighted Jaccard similarity is at least ``least``."""
    one, two = (shingles_of.select(F.col("bag").alias(x), F.col("shingles").alias(f"h{i}"), F.col("counts").alias(f"c{i}"))
                for i, x in ((1, "a"), (2, "b")))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "h1", "c1", "h2", "c2")
    found = full.mapInArrow(lambda x: _verify(x, least), "a long, b long, similar boolean")
    return cut_lineage(found.where("similar").select("a", "b"), "similar")


def _alike_in_size(least: float):
    """Bags of too different sizes cannot be similar."""
    return (F.col("n_a") >= least * F.col("n_b")) & (F.col("n_b") >= least * F.col("n_a"))


def near_groups(
    docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, tile_shingles: int = TILE_SHINGLES
) -> NearGroups:
    """Classes of ``doc_id, text`` linked by a weighted Jaccard similarity of word shingles of ``least`` or more.

    1. Each text becomes a bag (multiset) of five-word shingles and a BagMinHash signature; equal bags are one.
    2. Bags that agree in a band of the signature share a bucket. Its pivots are the member that meets most other
       bags in all its buckets (the original of many copies, say) and the smallest, which is random. Every member
       is compared with both exactly: rows in proportion to the members, however large the bucket.
    3. Components of the links found. A bucket whose members already belong together needs nothing more. The
       members of the others go to tasks as whole tiles, where all bags of different classes are compared
       exactly. Only links that join two classes leave a task, so no class is missed and no pairs are shuffled.

    Texts below five words are one shingle of all their words; null and blank texts have none and are
    classes of their own. A class's id is its smallest doc_id, null only if all are null. Rows that repeat a
    doc_id are members of their own. No rows give no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", whole().alias("text")).withColumn("body", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.mapInArrow(
        lambda found: _sign(found, bands, rows), f"doc_id {kind}, body long, bag long, n long, keys array<long>"
    )
    signed = cut_lineage(signed, "signatures")
    first = F.min(F.struct("doc_id", "body"))
    bag = signed.where("n > 0").groupBy("bag").agg(
        first.alias("rep"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys")
    )
    bag = cut_lineage(bag.select("bag", "rep.doc_id", "rep.body", "n", "keys"), "bags")
    member = bag.select("bag", F.explode("keys").alias("key"))
    buckets = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = cut_lineage(member.join(buckets, "key"), "buckets")
    central = shared.join(shared.groupBy("bag").agg(F.sum("m").alias("met")), "bag")
    pivots = central.groupBy("key").agg(F.max(F.struct("met", "bag")).alias("p"), F.min("bag").alias("q"))
    shared = shared.select("key", "bag")
    pairs = shared.join(pivots.select("key", "p.bag", "q").withColumnRenamed("bag", "p"), "key")
    pairs = pairs.select("bag", F.explode(F.array("p", "q")).alias("pivot")).where(F.col("bag") != F.col("pivot"))
    pairs = cut_lineage(pairs.select(*_ordered("bag", "pivot")).distinct(), "pairs")
    one, two = (bag.select(F.col("bag").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = cut_lineage(pairs.join(one, "a").join(two, "b").where(_alike_in_size(least)).select("a", "b"), "pairs")
    used = pairs.select(F.col("a").alias("bag")).unionAll(pairs.select("b")).distinct()
    links = _similar(pairs, _shingles_of(used, docs, bag), least)

    named = cut_lineage(components(links), "classes")
    placed = shared.join(named, shared["bag"] == named["node"], "left")
    placed = cut_lineage(placed.select("key", "bag", F.coalesce("component", "bag").alias("class")), "placed")
    spread = cut_lineage(_tiled(placed, bag, tile_shingles), "open")
    more = _across_classes(spread, _shingles_of(spread.select("bag").distinct(), docs, bag), least)
    if not more.isEmpty():
        links = links.unionAll(more)
        # Bags hang on their class already, so few rounds are left.
        hung = named.select(F.col("node").alias("a"), F.col("component").alias("b"))
        named = cut_lineage(components(hung.unionAll(more)), "classes")
    found = signed.select("doc_id", "body", "bag", "n").join(named, signed["bag"] == named["node"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "bag"))
    found = cut_lineage(found.select("doc_id", "body", "bag", own.alias("class")), "named")
    # Null ids are larger than others.
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body")).alias("row")
    chosen = found.where("class is not null").groupBy("class").agg(least_row).select("row.doc_id", "row.body")
    sizes = found.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")
    )
    # Sizes are written first, so that the join may split the rows of a large class among tasks.
    known = found.where("class is not null").join(cut_lineage(sizes, "sizes"), "class")
    blank = found.where("class is null").withColumns({"group_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    members = known.unionByName(blank).select(
        "doc_id", "bag", "group_id", "group_size", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept")
    )
    return NearGroups(members, links, chosen)


def _runs_of(found: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows that stand next to each other with equal ``names``, as one table each, also across batches."""
    held, last = [], None
    for batch in batches(found):
        keys = np.stack([batch.column(x).to_numpy() for x in names])
        cuts = np.flatnonzero(np.any(keys[:, 1:] != keys[:, :-1], axis=0)) + 1
        for low, high in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
            if held and tuple(keys[:, low]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = tuple(keys[:, low])
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Items of all lists one after another, and each list's length."""
    return column.combine_chunks().flatten().to_numpy(), pa.compute.list_value_length(column).to_numpy()


def _joining(group: pa.Table, least: float) -> list[tuple[int, int]]:
    """Links between bags of one bucket's tiles that join classes; one for each two classes that it joins.

    Each shingle lists the bags that hold it, so one pass over a bag's shingles sums what it shares with every
    bag behind it. The largest class stands last: its members need not be compared among themselves.
    """
    label = np.unique(group["class"].to_numpy(), return_inverse=True)[1]
    order = np.lexsort((label, np.bincount(label)[label]))
    group, label = group.take(pa.array(order)), label[order]
    bag, tile = group["bag"].to_numpy(), group["tile"].to_numpy()
    across = group["i"][0] != group["j"][0]
    h, size = _flat(group["shingles"])
    c, _ = _flat(group["counts"])
    owner = np.repeat(np.arange(len(bag)), size)
    n = np.bincount(owner, c, len(bag))
    by = np.lexsort((owner, h))
    h, c, owner = h[by], c[by], owner[by]
    end = np.searchsorted(h, h, side="right")
    shared_by = end - np.arange(len(h)) - 1
    entries = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[entries], np.arange(len(bag) + 1))
    links = []
    for a in range(len(bag) - 1):
        if (label[a:] == label[a]).all():
            continue
        at = entries[bounds[a] : bounds[a + 1]]
        times = shared_by[at]
        total = int(times.sum())
        if not total:
            continue
        others = np.arange(total) + np.repeat(at + 1 - (np.cumsum(times) - times), times)
        both = np.bincount(owner[others], np.minimum(c[others], np.repeat(c[at], times)), len(bag))
        near = (both >= least * (n[a] + n - both) - 1e-9) & (both > 0) & (label != label[a])
        if across:
            near &= tile != tile[a]
        names, first = np.unique(label[near], return_index=True)
        links += [(int(bag[a]), int(bag[b])) for b in np.flatnonzero(near)[first]]
        label[np.isin(label, names)] = label[a]
    return links


def _join_classes(found: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for group in _runs_of(found, ["key", "i", "j"]):
        links = np.array(_joining(group, least), np.int64).reshape(-1, 2)
        if len(links):
            links.sort(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def _tiled(placed: DataFrame, bag: DataFrame, tile_shingles: int) -> DataFrame:
    """``key, i, j, tile, bag, class``: members of the buckets that hold several classes, once for each pair of tiles.

    Of buckets with the same members one is enough. Tiles hold about ``tile_shingles`` shingles, so most
    buckets are a single tile.
    """
    alike = ("m", "members", "low", "high")
    state = placed.join(bag.select("bag", "n"), "bag").groupBy("key").agg(
        F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("m"),
        F.bit_xor(F.xxhash64("bag")).alias("members"),
        F.ceil(F.sum("n") / tile_shingles).cast("int").alias("tiles"),
    )
    mixed = state.where("low != high").groupBy(*alike).agg(F.min("key").alias("key"), F.any_value("tiles").alias("tiles"))
    tile = F.pmod(F.xxhash64("key", "bag"), F.col("tiles")).cast("int")
    open_ = placed.join(mixed.select("key", "tiles"), "key").withColumn("tile", tile)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    spread = open_.select("key", "bag", "class", "tile", other.alias("other"))
    return spread.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "bag", "class")


def _across_classes(spread: DataFrame, shingles_of: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` between classes that share a bucket, found by whole tiles within tasks: no pair leaves a task
    unless it joins two classes."""
    full = spread.join(shingles_of, "bag").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    full = full.select("key", "i", "j", "tile", "bag", "class", "shingles", "counts")
    return cut_lineage(full.mapInArrow(lambda x: _join_classes(x, least), "a long, b long"), "joining")


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each class, the one with the smallest doc_id; all columns unchanged.

    Null ids are larger than others; of rows that repeat an id the hash of the text decides. Rows without words are
    classes of their own and all stay.
    """
    chosen = near_groups(docs, **options).chosen.withColumnsRenamed({"doc_id": "__doc", "body": "__chosen"})
    named = whole().rlike(WORD)
    rows = docs.where(named).withColumn("__body", F.xxhash64(whole()))
    same = rows["doc_id"].eqNullSafe(chosen["__doc"]) & (rows["__body"] == chosen["__chosen"])
    # Rows alike in id and text; they combine before the shuffle.
    once = rows.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "__body"]).drop("__body")
    return once.unionByName(docs.where(~named))
