"""Mixing sources to target weights by a low-discrepancy schedule (SQL functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cartlens.llm.base import GAP, WORD, word_count
from cartlens.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 4096

# 2^32 divided by the golden ratio; multiples of it modulo 2^32 are evenly spread at every length.
GOLDEN = 2654435769
_CELLS = 1024
_CHUNK_SLOTS = 4096
_GROUP_DOCS = 2048


@dataclass
class Mix:
    """Parts of a mixture.

    ``sources``: source, place, weight, source_size, target, words (whole words to take), blocks.
    ``schedule``: slot, place, block: the order in which the blocks of the sources follow one another.
    ``pieces``: what each block holds: doc_id, repeat, and the words from ``begin`` to ``end`` of the text.
    ``taken``: one row per document: doc_id, source, body, size, source_size, target, taken.
    """

    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame
    taken: DataFrame


def _targets(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """Words wanted of each source: by weight, at most ``repeats`` times its size, the excess shared anew."""
    most = F.col("source_size") * repeats
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = most <= F.col("weight") * level if full >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(capped, 1).otherwise(0)).alias("n"),
            F.sum(F.when(capped, most).otherwise(0)).alias("held"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] is None or row["n"] == full or not row["weight"]:
            break
        full, level = row["n"], (total - row["held"]) / row["weight"]
    if row["n"] is not None and not row["weight"]:
        return sources.withColumn("target", most.cast("double"))
    return sources.withColumn(
        "target", F.least(most.cast("double"), F.col("weight") * F.lit(float(level)))
    )


def _point(n: Column) -> Column:
    """The n-th golden-ratio point of [0, 1), in whole numbers up to the division."""
    low = F.pmod(n, F.lit(65536)) * GOLDEN
    high = F.pmod(F.shiftright(n, 16) * GOLDEN, F.lit(65536)) * 65536
    return F.pmod(low + high, F.lit(1 << 32)) / float(1 << 32)


def _ranked(rows: DataFrame, group: str, chunk: Column, order: list) -> DataFrame:
    """Rank from 0 within a group of any size: by chunk, then chunks one after another."""
    rows = rows.withColumn("chunk", chunk)
    sizes = rows.groupBy(group, "chunk").agg(F.count("*").alias("n"))
    ahead = W.partitionBy(group).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(group, "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = F.row_number().over(W.partitionBy(group, "chunk").orderBy(*order)) - 1
    return rows.join(sizes, [group, "chunk"]).withColumn("rank", F.col("ahead") + within).drop("chunk", "ahead")


def _schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """``slot, place, block``: which source's next block stands at each slot."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("words")).first()[0] or 0
    slots = math.ceil(total / block_words)
    upto = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    # One row per source; sources are few, their documents are not touched here.
    shares = sources.where("words > 0").select(
        "place", (F.sum("words").over(upto) / F.lit(float(max(total, 1)))).alias("high"), "words"
    )
    shares = shares.withColumn("low", F.col("high") - F.col("words") / F.lit(float(max(total, 1))))
    edge = lambda c: F.floor(F.least(c, F.lit(1.0)) * _CELLS).cast("int")
    cells = shares.select("place", "high", F.explode(F.sequence(edge(F.col("low")), edge(F.col("high")))).alias("cell"))
    # The first source whose upper bound lies above the point.
    points = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * _CELLS).cast("int"))
    drawn = (
        points.join(cells, "cell").where(F.col("u") < F.col("high"))
        .groupBy("slot").agg(F.min("place").alias("place"))
    )
    # A source too small for any point gets one slot after all others.
    missed = sources.where("words > 0").join(drawn.select("place").distinct(), "place", "left_anti")
    drawn = drawn.unionAll(missed.select((F.lit(slots) + F.col("place")).cast("long").alias("slot"), "place"))
    chunk = F.floor(F.col("slot") / _CHUNK_SLOTS)
    return _ranked(drawn, "place", chunk, ["slot"]).withColumnRenamed("rank", "block")


def _start(block: Column) -> Column:
    """First word of a block, when ``words`` are cut into ``blocks`` equal parts."""
    return block * F.col("short") + F.least(block, F.col("longer"))


def _block(word: Column) -> Column:
    """The block that holds a word."""
    edge = F.col("longer") * (F.col("short") + 1)
    after = F.floor((word - edge) / F.greatest(F.col("short"), F.lit(1)))
    return F.when(word < edge, F.floor(word / (F.col("short") + 1))).otherwise(F.col("longer") + after).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block_words: int = BLOCK_WORDS,
) -> Mix:
    """Take ``share`` times the words of ``doc_id, text, source``, by weight of the sources.

    Sources in code point order, null last, take the weights in turn. The documents of a source
    stand in hash order, one after another, and the row repeats at most ``repeats`` times; its
    wanted words are cut into equal blocks, as many as the source has slots in the golden-ratio
    schedule. So a source gets its target to the word, at any prefix of the schedule about its
    share, and no document more than ``repeats`` times its size.
    Null or blank texts have size 0 and nothing is taken of them; no rows give no rows. Rows that
    repeat a doc_id are documents of their own. Other columns are ignored.
    """
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("body"), word_count().alias("size"))
    sizes = cut_lineage(sizes, "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source.
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut_lineage(sources.withColumn("place", place).withColumn("weight", turn), "sources")
    sources = _targets(sources, share, repeats).withColumn("words", F.floor("target").cast("long"))
    sources = cut_lineage(sources, "sources")
    schedule = cut_lineage(_schedule(sources, block_words), "schedule")
    blocks = schedule.groupBy("place").agg(F.count("*").alias("blocks"))
    sources = cut_lineage(sources.join(blocks, "place", "left").fillna(0, ["blocks"]), "sources")

    named = sources.select(
        F.col("source").alias("name"), "place", "source_size", "target", "words", "blocks",
        F.floor(F.col("words") / F.greatest("blocks", F.lit(1))).cast("long").alias("short"),
        F.when(F.col("blocks") > 0, F.col("words") % F.col("blocks")).otherwise(0).alias("longer"),
    )
    groups = max(1, math.ceil(sizes.count() / _GROUP_DOCS))
    key = F.xxhash64("doc_id", "body", "source")
    rows = sizes.join(named, sizes["source"].eqNullSafe(named["name"])).drop("name")
    rows = rows.withColumn("key", key).withColumn("part", F.pmod("key", F.lit(groups)))
    parts = rows.groupBy("place", "part").agg(F.sum("size").alias("n"))
    ahead = W.partitionBy("place").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("place", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    order = W.partitionBy("place", "part").orderBy("key", "doc_id", "body", "size")
    rows = (
        rows.join(parts, ["place", "part"])
        .withColumn("row", F.row_number().over(order))
        .withColumn("from", F.col("ahead") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .drop("ahead", "key")
    )
    rows = cut_lineage(rows, "streams")

    turns = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    turns = turns.withColumn("from", F.col("from") + F.col("repeat") * F.col("source_size"))
    turns = turns.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
    some = F.col("to") > F.col("from")
    spans = F.when(some, F.sequence(_block(F.col("from")), _block(F.col("to") - 1)))
    cut = turns.withColumn("block", F.explode_outer(spans))
    first = F.greatest("from", _start(F.col("block")))
    last = F.least("to", _start(F.col("block") + 1))
    cut = cut.withColumns({"begin": first - F.col("from"), "end": last - F.col("from")})
    placed = cut.join(schedule, ["place", "block"], "left")
    words = F.when(F.col("slot").isNotNull(), F.col("end") - F.col("begin")).otherwise(0)
    taken = placed.groupBy("place", "part", "row", "doc_id", "source", "body", "size", "source_size", "target").agg(
        F.sum(words).cast("long").alias("taken")
    )
    pieces = placed.where("slot is not null").select("slot", "place", "block", "doc_id", "body", "repeat", "begin", "end")
    return Mix(sources, schedule, pieces, taken.drop("place", "part", "row"))


def take_mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the mixture, whole: as often as the mixture takes their words, to the nearest whole time.

    Only the document in which a source's stream ends is taken in part; it stays when at least half of it is taken.
    Rows alike in id, source and text get the same number. All columns unchanged.
    """
    taken = mix(docs, **options).taken
    times = (
        taken.groupBy("doc_id", "source", "body")
        .agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("times"))
        .select(
            F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("body").alias("__body"),
            F.round("times").cast("int").alias("__times"),
        )
        .where("__times > 0")
    )
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    same = (
        (rows["__hash"] == times["__body"])
        & rows["doc_id"].eqNullSafe(times["__doc"])
        & rows["source"].eqNullSafe(times["__source"])
    )
    found = rows.join(times, same).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return found.select(*[rows[c] for c in docs.columns])


def take_pieces(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in the mixture, word for word: a row for each time a document is taken whole, and where a
    source's stream ends within a document a row with the words of its pieces, a prefix of its text. Columns unchanged.
    """
    key = ["__doc", "__source", "__body"]
    taken = mix(docs, **options).taken
    taken = taken.select(
        F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("body").alias("__body"), "size", "taken"
    )
    # Each of the rows alike in id, source and text has its own number of words.
    order = W.partitionBy(*key).orderBy(F.desc("taken"))
    taken = taken.withColumn("__n", F.row_number().over(order)).where("taken > 0")
    # Pieces of a document start at its first word every time, so what is left is a prefix.
    left = F.col("taken") % F.col("size")
    whole_times = F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    turns = F.concat(whole_times, F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<long>")))
    taken = taken.select(*key, F.col("__n").alias("__m"), turns.alias("__turns"))
    rows = docs.withColumns({"__d": F.col("doc_id"), "__s": F.col("source"), "__h": F.xxhash64("text")})
    rows = rows.withColumn("__n", F.row_number().over(W.partitionBy("__d", "__s", "__h").orderBy(F.lit(1))))
    same = (
        (rows["__h"] == taken["__body"])
        & (rows["__n"] == taken["__m"])
        & rows["__d"].eqNullSafe(taken["__doc"])
        & rows["__s"].eqNullSafe(taken["__source"])
    )
    found = rows.join(taken, same).withColumn("__words", F.explode("__turns"))
    # Each word with the gap before it, so the prefix keeps its bytes.
    parts = F.regexp_extract_all("text", F.lit(f"(?:{GAP})?{WORD}"), F.lit(0))
    prefix = F.array_join(F.slice(parts, F.lit(1), F.col("__words").cast("int")), "")
    text = F.when(F.col("__words") > 0, prefix).otherwise(F.col("text")).alias("text")
    return found.select(*[text if c == "text" else rows[c] for c in docs.columns])
