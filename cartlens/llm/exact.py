"""Exact duplicates by an extendible-hash index on shared files (SQL functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cartlens.llm.base import GAP, whole
from cartlens.session import cut_lineage, scratch_path

# The directory addresses buckets by the leading bits of the hash.
DIRECTORY_BITS = 12
SLOTS = 1 << DIRECTORY_BITS
BUCKET_ENTRIES = 50_000


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(whole(text), GAP, " ")


def _slot(h: str) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - DIRECTORY_BITS).cast("int")


def directory(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int]]:
    """``slot, bucket, depth`` of every slot: buckets above the capacity are split by one more bit.

    A bucket is named by its first slot. All slots of an unsplit bucket point to it, which is
    what doubling the directory does. ``counts`` has at most ``SLOTS`` numbers.
    """
    found, todo = [], [(0, 0)]
    while todo:
        first, depth = todo.pop()
        width = SLOTS >> depth
        held = sum(counts.get(s, 0) for s in range(first, first + width))
        if held > capacity and width > 1:
            todo += [(first, depth + 1), (first + width // 2, depth + 1)]
        else:
            found += [(s, first, depth) for s in range(first, first + width)]
    return sorted(found)


@dataclass
class ExactIndex:
    """``entries``: bucket, h, chain, text_sha256, keep_id, group_size; ``keys``: doc_id, h, text_sha256."""

    entries: DataFrame
    keys: DataFrame
    directory: DataFrame


def exact_index(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> ExactIndex:
    """Index of the distinct normalised texts of ``doc_id, text``.

    The hash of a text picks its bucket through the directory. Owner tasks group a
    bucket's rows by hash and by the text itself, so colliding texts are told apart by
    their bytes and get places in a chain. Copies combine before the shuffle: a group
    with a third of all rows sends one row per task. Entries are written without texts,
    sorted by bucket and hash, one folder per bucket.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", normalised().alias("body"))
    keys = text.select(
        "doc_id", F.xxhash64("body").alias("h"), F.sha2("body", 256).alias("text_sha256")
    )
    keys = cut_lineage(keys, "keys")
    # At most SLOTS counts reach the driver.
    held = keys.groupBy("h").agg(F.lit(1).alias("one")).groupBy(_slot("h").alias("slot")).count()
    counts = {r["slot"]: r["count"] for r in held.collect()}
    capacity = max(capacity, sum(counts.values()) * 2 // SLOTS)
    slots = spark.createDataFrame(directory(counts, capacity), "slot int, bucket int, depth int")

    owned = (
        text.groupBy(F.xxhash64("body").alias("h"), "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    chain = W.partitionBy("h").orderBy("text_sha256")
    entries = (
        owned.withColumn("slot", _slot("h"))
        .join(F.broadcast(slots), "slot")  # SLOTS rows
        .withColumn("chain", F.row_number().over(chain))
        .select("bucket", "h", "chain", "text_sha256", "keep_id", "group_size")
    )
    path = scratch_path(spark, "exact-index")
    entries.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h", "chain").write.partitionBy(
        "bucket"
    ).parquet(path)
    return ExactIndex(spark.read.schema(entries.schema).parquet(path), keys, slots)


def exact_groups(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row.

    Null texts are empty texts. Ids that are null are never smaller than others; a group
    of null ids alone keeps null. Rows that repeat a kept id and its text are the same
    document and all count as kept. No rows give no rows; other columns are ignored.
    """
    index = exact_index(docs, capacity)
    found = index.entries.select("h", "text_sha256", "keep_id", "group_size")
    return index.keys.join(found, ["h", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, all columns unchanged."""
    index = exact_index(docs, capacity)
    kept = index.entries.select(F.col("h").alias("__h"), F.col("keep_id").alias("__keep"))
    body = normalised()
    rows = docs.withColumns({"__h": F.xxhash64(body), "__sha": F.sha2(body, 256)})
    same = rows["doc_id"].eqNullSafe(F.col("__keep"))
    stay = rows.join(kept.distinct(), (rows["__h"] == kept["__h"]) & same, "left_semi")
    once = W.partitionBy("doc_id", "__h", "__sha").orderBy(F.lit(1))
    return stay.withColumn("__n", F.row_number().over(once)).where("__n = 1").drop("__h", "__sha", "__n")
