"""Substring dedup: passages of many words that repeat across documents, found by FM-indexes of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm import words as WD
from cartlens.llm.base import batches, scaled_partitions, texts, whole
from cartlens.llm.fm_index import FMIndex
from cartlens.session import cut_lineage

WINDOW = 50
ANCHOR = 8
SHARD_WORDS = 300_000
_PASSAGE_WINDOWS = 64
_TEXT_BYTES = 2 << 20
_LAST = (1 << 63) - 1


def anchors(found: WD.Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, and the smallest hash of ``anchor`` consecutive words within each.

    Equal windows have equal anchors, so only texts that share an anchor can share a window.
    """
    n = len(found.hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(n - anchor + 1)
    value = WD.spans_hash(found.hashes, starts, starts + anchor)
    span, width = window - anchor + 1, 1
    while width * 2 <= span:
        value = np.minimum(value[: len(value) - width], value[width:])
        width *= 2
    if width < span:
        value = np.minimum(value[: len(value) - (span - width)], value[span - width :])
    counts = np.diff(found.bounds)
    ends = np.repeat(found.bounds[1:], counts)
    ok = np.flatnonzero(np.arange(len(value)) + window <= ends[: len(value)])
    return ok, value[ok]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = texts(batch)
    groups = offsets[:-1] // _TEXT_BYTES
    for group in np.unique(groups):
        a, b = (int(np.searchsorted(groups, group, side=side)) for side in ("left", "right"))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _passages(found: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows with one anchor: text, first word, number of windows, hash of all their words."""
    for batch in batches(found):
        for a, b, raw, offsets in _slices(batch):
            words = WD.split(raw, offsets)
            at, value = anchors(words, window, anchor)
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            # Long runs are cut at fixed distances from their start.
            run = np.repeat(first, np.diff(np.append(first, len(at))))
            new |= (np.arange(len(at)) - run) % _PASSAGE_WINDOWS == 0
            first = np.flatnonzero(new)
            number = np.diff(np.append(first, len(at)))
            start = at[first]
            content = WD.spans_hash(words.hashes, start, start + number + window - 1)
            row = words.rows[start]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a).take(pa.array(row)),
                    batch.column("body").slice(a, b - a).take(pa.array(row)),
                    pa.array((start - words.bounds[row]).astype(np.int32)), pa.array(number.astype(np.int32)),
                    pa.array(value[first].view(np.int64)), pa.array(content.view(np.int64)),
                ],
                ["doc_id", "body", "start", "windows", "anchor", "content"],
            )


def _digest(raw: np.ndarray, words: WD.Words, row: int, covers: list, window: int) -> tuple[int, int, str]:
    """Number of words, of removed words, and the hash of the kept ones of a text."""
    a, b = int(words.bounds[row]), int(words.bounds[row + 1])
    marks = np.zeros(b - a + 1, np.int64)
    for start, windows in covers:
        marks[start] += 1
        marks[start + windows + window - 1] -= 1
    removed = np.cumsum(marks[:-1]) > 0
    starts, ends = words.starts[a:b], words.ends[a:b]
    kept = np.flatnonzero(~removed)
    # Stretches of kept words with the bytes between them, each gap one space.
    size = ends[kept] - starts[kept] + 1
    total = int(size.sum())
    out = np.full(total, 32, np.uint8)
    place = np.cumsum(size) - size
    inner = np.arange(total) - np.repeat(place, size)
    source = np.repeat(starts[kept], size) + inner
    letter = inner < np.repeat(size - 1, size)
    out[letter] = raw[source[letter]]
    return b - a, int(removed.sum()), hashlib.sha256(out[:-1].tobytes() if total else b"").hexdigest()


_FIRST_PASS = (
    "kind int, doc_id long, body long, n_words long, n_removed long, kept_sha256 string, text string, "
    "starts array<int>, windows array<int>, key long, start int, words binary"
)
_COLUMNS = [x.split()[0] for x in _FIRST_PASS.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
          pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.binary()]
_DONE, _OPEN, _PASSAGE, _HOT = range(4)
_COVERED, _INDEXED, _EXPLODED = range(3)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], _COLUMNS)


def _resolve(found: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Finish texts whose windows are all decided; hand out the words of the passages that are not.

    Of rows with the same id and text the first of the task speaks for all.
    """
    spoken: set[tuple] = set()
    for batch in batches(found):
        for a, b, raw, offsets in _slices(batch):
            words = WD.split(raw, offsets)
            ids, bodies = (batch.column(c).slice(a, b - a).to_pylist() for c in ("doc_id", "body"))
            lists = [batch.column(c).slice(a, b - a).to_pylist() for c in ("starts", "windows", "anchors", "states")]
            rows = []
            for i in range(b - a):
                parts = list(zip(*(x[i] or [] for x in lists)))
                covers = [(s, w) for s, w, _, state in parts if state == _COVERED]
                rest = [p for p in parts if p[3] != _COVERED]
                if not rest:
                    rows.append((_DONE, ids[i], bodies[i], *_digest(raw, words, i, covers, window), *[None] * 6))
                    continue
                text = raw[offsets[i] : offsets[i + 1]].tobytes().decode()
                rows.append((_OPEN, ids[i], bodies[i], None, None, None, text,
                             [s for s, _ in covers], [w for _, w in covers], None, None, None))
                if (ids[i], bodies[i]) in spoken:
                    continue
                spoken.add((ids[i], bodies[i]))
                low = int(words.bounds[i])
                for start, number, anchor, state in rest:
                    own = words.hashes[low + start : low + start + number + window - 1]
                    if state == _INDEXED:
                        rows.append((_PASSAGE, ids[i], bodies[i], *[None] * 6, anchor, start, own.tobytes()))
                        continue
                    at = np.arange(number)
                    for k, h in enumerate(WD.spans_hash(own, at, at + window).view(np.int64).tolist()):
                        rows.append((_HOT, ids[i], bodies[i], *[None] * 6, h, start + k, None))
                if len(rows) >= 4096:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _repeated(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Windows of a shard's passages that start in a document with a smaller id, as runs."""
    # What several tasks say of rows with the same id and text.
    pdf = pdf.drop_duplicates(["key", "place", "unnamed", "body", "start"])
    passages = [np.frombuffer(x, np.int64) for x in pdf["words"]]
    # Words as small numbers from 1.
    flat = np.concatenate(passages)
    _, number = np.unique(flat, return_inverse=True)
    cuts = np.cumsum([len(p) for p in passages])[:-1]
    passages = np.split(number + 1, cuts)
    owners = pdf["place"].to_numpy(np.int64)
    index = FMIndex(passages, owners, window)
    rows = []
    for i, least in enumerate(index.least_owners(passages)):
        hit = least < owners[i]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        for low, high in zip(edges[::2], edges[1::2]):
            rows.append((owners[i], pdf["unnamed"].iloc[i], pdf["body"].iloc[i], pdf["start"].iloc[i] + low, high - low))
    out = pd.DataFrame(rows, columns=["place", "unnamed", "body", "start", "windows"])
    return out.astype({"place": "int64", "unnamed": "bool", "body": "int64", "start": "int32", "windows": "int32"})


def _finish(found: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(found):
        raw, offsets = texts(batch)
        words = WD.split(raw, offsets, with_hashes=False)
        lists = [batch.column(c).to_pylist() for c in ("starts", "windows")]
        out = [
            _digest(raw, words, i, list(zip(*(x[i] or [] for x in lists))), window) for i in range(batch.num_rows)
        ]
        columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every text of ``doc_id, text``.

    A word goes if a window of ``window`` consecutive words over it also starts in a document with a smaller id.

    1. Each text is cut into passages, runs of windows with the same anchor (smallest hash of a few words).
       Equal windows have equal anchors, so a shard of all passages with certain anchors holds all their copies.
    2. Anchors of one document only need nothing. Equal passages are decided by the smallest id among them, a
       minimum that combines before the shuffle, however many copies there are.
    3. Where passages with one anchor differ, the first copy of each goes to the anchor's shard. The shard builds
       an FM-index of them, and backward search gives the matching statistics of each, window by window. Anchors
       with more words than a shard should hold (a very common passage in many different surroundings) are
       exploded to windows, which are compared by the hash of their words, again by minima.

    Null and empty texts have no words. A null doc_id is larger than all others. Rows that repeat a doc_id are
    texts of one document. No rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    docs = docs.withColumn("body", F.xxhash64("text"))
    passages = cut_lineage(
        docs.mapInArrow(
            lambda found: _passages(found, window, anchor),
            "doc_id long, body long, start int, windows int, anchor long, content long",
        ),
        "passages",
    )
    place = F.coalesce("doc_id", F.lit(_LAST))
    rank = place.alias("place")
    by_anchor = passages.groupBy("anchor").agg(
        F.min(place).alias("first"), F.max(place).alias("last"),
        F.min("content").alias("low"), F.max("content").alias("high"),
    )
    by_anchor = by_anchor.where(F.col("first") < F.col("last")).select(
        "anchor", "first", (F.col("low") != F.col("high")).alias("mixed")
    )
    shared = cut_lineage(passages.join(by_anchor, "anchor").withColumn("place", place), "shared")
    # Words of distinct passages decide whether an anchor is too large for a shard.
    sizes = shared.where("mixed").groupBy("anchor", "content").agg(
        F.min("place").alias("own_first"), F.max("windows").alias("w")
    )
    sizes = cut_lineage(sizes, "contents")
    own = sizes.select("anchor", "content", "own_first")
    hot = sizes.groupBy("anchor").agg(F.sum((F.col("w") + window - 1).cast("long")).alias("distinct_words"))
    hot = hot.where(F.col("distinct_words") > shard_words).select("anchor", F.lit(True).alias("hot"))
    mixed = shared.where("mixed").join(own, ["anchor", "content"]).join(hot, "anchor", "left")
    state = (
        F.when(F.col("own_first") < F.col("place"), _COVERED)
        .when(F.col("hot"), _EXPLODED)
        .otherwise(_INDEXED)
    )
    columns = ["doc_id", "body", "start", "windows", "anchor"]
    decided = mixed.select(*columns, state.alias("state")).unionByName(
        shared.where("not mixed").where(F.col("first") < F.col("place")).select(*columns, F.lit(_COVERED).alias("state"))
    )
    part = F.struct("start", "windows", "anchor", "state")
    by_text = decided.groupBy("doc_id", "body").agg(F.collect_set(part).alias("parts"))
    by_text = by_text.select(
        F.col("doc_id").alias("d"), F.col("body").alias("b"), F.col("parts.start").alias("starts"),
        F.col("parts.windows").alias("windows"), F.col("parts.anchor").alias("anchors"), F.col("parts.state").alias("states"),
    )
    met = docs.join(by_text, docs["doc_id"].eqNullSafe(by_text["d"]) & (docs["body"] == by_text["b"]), "left")
    met = met.select("doc_id", "body", "text", "starts", "windows", "anchors", "states")
    first = cut_lineage(met.mapInArrow(lambda found: _resolve(found, window), _FIRST_PASS), "resolved")

    # No column of a shard holds nulls, which pandas would turn into floats that round ids above 2^53.
    unnamed = F.col("doc_id").isNull().alias("unnamed")
    pieces = first.where(F.col("kind") == _PASSAGE).select("key", rank, unnamed, "body", "start", "words")
    total = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = scaled_partitions(spark, total / 8, shard_words)
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    covers = pieces.groupBy("shard").applyInPandas(
        lambda pdf: _repeated(pdf, window), "place long, unnamed boolean, body long, start int, windows int"
    )
    own_id = F.when(~F.col("unnamed"), F.col("place")).alias("doc_id")
    covers = covers.select(own_id, "body", "start", "windows")
    single = first.where(F.col("kind") == _HOT).select("key", "doc_id", "body", "start", rank)
    firsts = single.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    firsts = firsts.where(F.col("first") < F.col("last")).select("key", "first")
    hits = single.join(firsts, "key").where(F.col("first") < F.col("place"))
    covers = covers.unionByName(hits.select("doc_id", "body", "start", F.lit(1).cast("int").alias("windows")))
    more = covers.groupBy("doc_id", "body").agg(F.collect_set(F.struct("start", "windows")).alias("parts"))
    more = more.select(
        F.col("doc_id").alias("d"), F.col("body").alias("b"),
        F.col("parts.start").alias("more_starts"), F.col("parts.windows").alias("more_windows"),
    )
    still = first.where(F.col("kind") == _OPEN).select("doc_id", "body", "text", "starts", "windows")
    none = F.array().cast("array<int>")
    still = still.join(more, still["doc_id"].eqNullSafe(more["d"]) & (still["body"] == more["b"]), "left").select(
        "doc_id", "text",
        F.concat("starts", F.coalesce("more_starts", none)).alias("starts"),
        F.concat("windows", F.coalesce("more_windows", none)).alias("windows"),
    )
    done = first.where(F.col("kind") == _DONE).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(
        still.mapInArrow(lambda found: _finish(found, window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    )
