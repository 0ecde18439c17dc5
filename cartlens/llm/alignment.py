"""Tokens of two tokenizers side by side: groups between common byte offsets, found by galloping intersection."""

from __future__ import annotations

import base64
import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cartlens.llm.base import batches, slices
from cartlens.llm.bpe import ragged, tokenizer_path
from cartlens.session import cut_lineage

FIRST, SECOND = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
# The ranks are those of byte_bpe_50k.json, which the tokenizers library reads four times more slowly.
# Id pairs whose counts one task holds at a time, 16 bytes each.
PAIRS_AT_ONCE = 1 << 22
_PAIRS_COUNTED = 1 << 20
_CHARS_AT_ONCE = 1 << 19
# Links of a group with more are summed by distinct ids before they are listed.
_WIDE_GROUP = 1 << 12


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ascending ``short`` the first place in ascending ``long`` that is not below it.

    The shorter list drives: every value starts where its left neighbour ended, doubles its step until it has
    passed its place, and halves the last step. Neighbours are met in rounds, every second of those left, so
    all values of a round search side by side, never beyond what the right neighbour found.
    """
    n = len(short)
    place = np.zeros(n + 2, np.int64)  # one place ahead; in front of the first, and behind the last
    place[n + 1] = len(long)
    stride = 1 << max(0, n - 1).bit_length()
    while stride:
        own = np.arange(stride - 1, n, 2 * stride)
        value = short[own]
        low = place[own - stride + 1]
        high = place[np.minimum(own + stride, n) + 1]
        step, live = 1, np.flatnonzero(low < high)
        while len(live):
            probe = np.minimum(low[live] + step, high[live]) - 1
            below = long[probe] < value[live]
            high[live[~below]] = probe[~below]
            live = live[below]
            low[live] = probe[below] + 1
            live = live[low[live] < high[live]]
            step *= 2
        live = np.flatnonzero(low < high)
        while len(live):
            probe = (low[live] + high[live]) // 2
            below = long[probe] < value[live]
            low[live[below]] = probe[below] + 1
            high[live[~below]] = probe[~below]
            live = live[low[live] < high[live]]
        place[own + 1] = low
        stride //= 2
    return place[1 : n + 1]


def common(ends_a: np.ndarray, bounds_a: np.ndarray, ends_b: np.ndarray, bounds_b: np.ndarray):
    """Places in A and in B of the offsets where tokens of both end; in each text its shorter list drives.

    The offsets of all texts go up without a break, ``bounds`` say where each text's tokens start.
    """
    drives = np.diff(bounds_a) <= np.diff(bounds_b)
    mask_a, mask_b = np.repeat(drives, np.diff(bounds_a)), np.repeat(drives, np.diff(bounds_b))
    at_a, at_b = [], []
    for own in (True, False):
        a, b = np.flatnonzero(mask_a == own), np.flatnonzero(mask_b == own)
        short, long = (ends_a[a], ends_b[b]) if own else (ends_b[b], ends_a[a])
        found = gallop(short, long)
        hit = found < len(long)
        hit[hit] = long[found[hit]] == short[hit]
        driver, other = np.flatnonzero(hit), found[hit]
        at_a.append(a[driver] if own else a[other])
        at_b.append(b[other] if own else b[driver])
    return np.sort(np.concatenate(at_a)), np.sort(np.concatenate(at_b))


class Side:
    """A tokenizer: ids of texts, the bytes of each id, and the decimal digits of each id."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        self.name, self.other = name, None
        if name.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self._piece(i) for i in range(self.model.get_piece_size())]
            self.encode = self._pieces
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            # No special tokens, so their strings are plain text.
            self.model = tiktoken.Encoding(
                name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
            pieces = [b""] * (max(ranks.values()) + 1)
            for data, i in ranks.items():
                pieces[i] = data
            self.encode = self._ranks
        self.size = len(pieces)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        # Each id with each of the marks that may follow it.
        written = [f"{i}{mark}".encode() for i in range(self.size) for mark in ",|;"]
        self.digits = np.frombuffer(b"".join(written), np.uint8)
        self.digit_lengths = np.array([len(w) for w in written], np.int64)
        self.digit_starts = np.cumsum(self.digit_lengths) - self.digit_lengths

    def _piece(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]

    def _ranks(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self._rank(" " + text), np.int64) for text in texts]

    def _rank(self, text: str) -> list[int]:
        try:
            return self.model.encode_ordinary(text)
        except BaseException as failed:
            # Very long runs of mixed white space exhaust the stack of its regular expressions.
            if type(failed).__name__ != "PanicException":
                raise
            if not self.other:
                from tokenizers import Tokenizer

                self.other = Tokenizer.from_file(tokenizer_path(self.name.replace(".tiktoken", ".json")))
                self.other.encode_special_tokens = True
            return self.other.encode(text, add_special_tokens=False).ids

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids start."""
        ids = self.encode(texts)
        return np.concatenate([*ids, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, ids)])

    def spells(self, ids: np.ndarray, bounds: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text's tokens joined are its bytes."""
        sums = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        same = np.diff(sums[bounds]) == np.diff(offsets)
        rows = np.flatnonzero(same)
        own, _ = ragged(ids, bounds[:-1], np.diff(bounds), rows)
        spelled, _ = ragged(self.bytes, self.starts, self.lengths, own)
        data, cuts = ragged(raw, offsets[:-1], np.diff(offsets), rows)
        wrong = np.concatenate([[0], np.cumsum(spelled != data)])
        same[rows] = wrong[cuts[1:]] == wrong[cuts[:-1]]
        return same


@functools.cache
def side(name: str) -> Side:
    """One per Python worker and tokenizer file."""
    return Side(name)


class Aligned:
    """Tokens of some texts on both sides, cut into groups where tokens of both end."""

    def __init__(self, texts: list[str | None], a: Side, b: Side):
        self.n, self.a, self.b = len(texts), a, b
        spoken = [t or "" for t in texts]
        data = [b" " + t.encode() for t in spoken]
        offsets = np.cumsum([0, *map(len, data)])
        raw = np.frombuffer(b"".join(data), np.uint8)
        ids_a, bounds_a = a.tokens(spoken)
        ids_b, bounds_b = b.tokens(spoken)
        good = np.array([bool(t) for t in spoken], bool)
        good &= a.spells(ids_a, bounds_a, raw, offsets) & b.spells(ids_b, bounds_b, raw, offsets)
        rows = np.flatnonzero(good)
        self.ids_a, cuts_a = ragged(ids_a, bounds_a[:-1], np.diff(bounds_a), rows)
        self.ids_b, cuts_b = ragged(ids_b, bounds_b[:-1], np.diff(bounds_b), rows)
        ends_a, ends_b = np.cumsum(a.lengths[self.ids_a]), np.cumsum(b.lengths[self.ids_b])
        at_a, at_b = common(ends_a, cuts_a, ends_b, cuts_b)
        # Rank differences: how many tokens of either side lie between one common end and the next.
        self.firsts_a, self.firsts_b = np.append(-1, at_a)[:-1] + 1, np.append(-1, at_b)[:-1] + 1
        self.sizes_a, self.sizes_b = at_a + 1 - self.firsts_a, at_b + 1 - self.firsts_b
        # Bounds of every text's tokens and groups; texts without tokens have empty ranges.
        place = np.concatenate([[0], np.cumsum(good)])
        self.bounds_a, self.bounds_b = cuts_a[place], cuts_b[place]
        self.bounds = np.searchsorted(at_a, self.bounds_a)
        self.ends = ends_a[at_a]  # bytes from the first text on
        self.base = np.concatenate([[0], ends_a])[self.bounds_a]
        self.links = np.concatenate([[0], np.cumsum(self.sizes_a * self.sizes_b)])

    def written(self) -> list[str]:
        """Hash of each text's groups as decimal ids; without tokens the text ''."""
        groups = len(self.sizes_a)
        # Tokens of A and B by turns of groups, each with the mark behind it: , | or ;
        marks_a, marks_b = np.zeros(len(self.ids_a), np.int64), np.zeros(len(self.ids_b), np.int64)
        marks_a[self.firsts_a + self.sizes_a - 1] = 1
        marks_b[self.firsts_b + self.sizes_b - 1] = 2
        coded = np.concatenate([self.ids_a * 3 + marks_a, self.ids_b * 3 + marks_b + 3 * self.a.size])
        starts = np.stack([self.firsts_a, self.firsts_b + len(self.ids_a)], axis=1).ravel()
        order, _ = ragged(coded, starts, np.stack([self.sizes_a, self.sizes_b], axis=1).ravel(), np.arange(2 * groups))
        table = np.concatenate([self.a.digits, self.b.digits])
        first = np.concatenate([self.a.digit_starts, self.b.digit_starts + len(self.a.digits)])
        text, cuts = ragged(table, first, np.concatenate([self.a.digit_lengths, self.b.digit_lengths]), order)
        at = cuts[self.bounds_a + self.bounds_b].tolist()
        whole = text.tobytes()
        return [hashlib.sha256(whole[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds by text, distinct linked id pairs ``a * size of B + b`` ascending, and the links of each."""
        width = self.b.size
        text = np.repeat(np.arange(self.n), np.diff(self.bounds))
        wide = self.sizes_a * self.sizes_b > _WIDE_GROUP
        plain = np.flatnonzero(~wide)
        sizes = (self.sizes_a * self.sizes_b)[plain]
        each = np.repeat(np.arange(len(plain)), sizes)
        within = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        group = plain[each]
        a = self.ids_a[self.firsts_a[group] + within // self.sizes_b[group]]
        b = self.ids_b[self.firsts_b[group] + within % self.sizes_b[group]]
        texts, keys, times = [text[group]], [a * width + b], [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            a, n = np.unique(self.ids_a[self.firsts_a[g] :][: self.sizes_a[g]], return_counts=True)
            b, m = np.unique(self.ids_b[self.firsts_b[g] :][: self.sizes_b[g]], return_counts=True)
            keys.append((a[:, None] * width + b).ravel())
            times.append((n[:, None] * m).ravel())
            texts.append(np.full(len(keys[-1]), text[g]))
        texts, keys, times = np.concatenate(texts), np.concatenate(keys), np.concatenate(times)
        whole = texts * (self.a.size * width) + keys
        order = np.argsort(whole)
        whole, times = whole[order], times[order]
        first = np.flatnonzero(np.append(True, whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, np.int64)
        summed = np.add.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
        texts, keys = np.divmod(whole[first], self.a.size * width)
        return np.searchsorted(texts, np.arange(self.n + 1)), keys, summed


def _aligned(found: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    a, b = side(first), side(second)
    for batch in batches(found):
        rows = batch.column("text").to_pylist()
        for x, y in slices([t or "" for t in rows], _CHARS_AT_ONCE):
            yield batch.slice(x, y - x), Aligned(rows[x:y], a, b)


def align(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """``doc_id, ids_a, ids_b, groups`` of every whole text of ``doc_id, text``.

    ``groups`` has the end of each group: tokens of A and of B up to there, and bytes of space and text. A text that
    is null or empty, or whose joined tokens of either side are not its bytes after a space, has no tokens.
    Rows that repeat an id are aligned each; no rows give no rows; other columns are ignored.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in _aligned(found, first, second):
            text = np.repeat(np.arange(own.n), np.diff(own.bounds))
            ends = pa.StructArray.from_arrays(
                [
                    pa.array(own.firsts_a + own.sizes_a - own.bounds_a[text], pa.int32()),
                    pa.array(own.firsts_b + own.sizes_b - own.bounds_b[text], pa.int32()),
                    pa.array(own.ends - own.base[text], pa.int64()),
                ],
                ["a", "b", "bytes"],
            )
            lists = [
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
                for bounds, values in (
                    (own.bounds_a, pa.array(own.ids_a, pa.int32())),
                    (own.bounds_b, pa.array(own.ids_b, pa.int32())),
                    (own.bounds, ends),
                )
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids_a", "ids_b", "groups"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    groups = "array<struct<a: int, b: int, bytes: long>>"
    return rows.mapInArrow(run, f"doc_id {kind}, ids_a array<int>, ids_b array<int>, groups {groups}")


def linked_pairs(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """Per text: sizes, the hash of its groups, and its distinct linked id pairs with their links, packed.

    ``pairs`` are steps from one pair to the next and ``times`` the links, little-endian unsigned 32-bit; a text
    with 2^32 links of one pair, or vocabularies with more pairs than that, would not fit and raise.
    """

    def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
        if len(values) and values.max() >= 1 << 32:
            raise OverflowError("a number of links or an id pair exceeds 32 bits")
        data = values.astype("<u4").tobytes()
        return pa.Array.from_buffers(
            pa.binary(), len(bounds) - 1,
            [None, pa.py_buffer((bounds * 4).astype(np.int32).tobytes()), pa.py_buffer(data)],
        )

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in _aligned(found, first, second):
            bounds, keys, times = own.pairs()
            steps = np.diff(keys, prepend=0)
            heads = bounds[:-1][np.diff(bounds) > 0]
            steps[heads] = keys[heads]
            columns = [np.diff(own.bounds_a), np.diff(own.bounds_b), np.diff(own.bounds), np.diff(own.links[own.bounds])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns), pa.array(own.written()),
                 packed(steps, bounds), packed(times, bounds)],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary",
    )


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds by row, id pairs and links."""
    out = []
    for name in ("pairs", "times"):
        column = batch.column(name).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        out.append(raw[bounds[0] : bounds[-1]].view("<u4").astype(np.int64))
        bounds = (bounds - bounds[0]) // 4
    steps, times = out
    sums = np.cumsum(steps)
    before = np.concatenate([[0], sums])[bounds[:-1]]
    return bounds, sums - np.repeat(before, np.diff(bounds)), times


def pair_counts(linked: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: how many texts hold each id pair linked, and whether no pair of its A id has more."""

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            own, which = np.unique(np.concatenate([keys, *held]), return_inverse=True)
            return own, np.bincount(which, np.append(sums, np.ones(len(which) - len(sums))), len(own)).astype(np.int64)

        for batch in batches(found):
            held.append(_unpacked(batch)[1])
            size += len(held[-1])
            if size >= _PAIRS_COUNTED:
                keys, sums = merged()
                held, size = [], 0
                if len(keys) >= _PAIRS_COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])
                    keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])

    counts = linked.select("pairs", "times").mapInArrow(count, "pair long, n long")
    counts = cut_lineage(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.expr(f"pair div {width}").alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    best = counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return cut_lineage(best, "best-pairs")


def _summed(linked: DataFrame, block: Row | None) -> DataFrame:
    """``row`` of each text with the sums over those of its pairs whose counts are in the block."""
    sent = linked.sparkSession.sparkContext.broadcast(block)  # PAIRS_AT_ONCE pairs

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, best = sent.value
        for batch in batches(found):
            bounds, pairs, times = _unpacked(batch)
            at = np.searchsorted(keys, pairs)
            at[at == len(keys)] = 0
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[known]
            times, at = times[known], at[known]
            sums = [np.zeros(len(bounds) - 1, np.int64) for _ in range(2)]
            for total, part in zip(sums, (times * best[at], times * numbers[at])):
                np.add.at(total, rows, part)
            names = [n for n in batch.schema.names if n not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *map(pa.array, sums)], [*names, "n_best", "count_sum"]
            )

    kept = [f for f in linked.schema.fields if f.name not in ("pairs", "times")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"
    return linked.mapInArrow(run, schema)


def _block(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = rows.orderBy("pair").toArrow()
    return tuple(found.column(c).to_numpy() for c in ("pair", "n", "best"))


def link_sums(docs: DataFrame, first: str = FIRST, second: str = SECOND, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """Per text ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A link is a pair of token occurrences of one group; the count of its ids is the number of texts, corpus-wide,
    that hold them linked. ``n_best`` are the links whose count no other pair of the A id exceeds, ``count_sum`` is
    the sum of counts over all links. Texts without tokens (see ``align``) have zeros and the hash ''. The counts
    are looked up in blocks of about ``at_once`` pairs, as many passes over the packed pairs as that takes.
    """
    linked = cut_lineage(
        linked_pairs(docs, first, second).withColumn("row", F.monotonically_increasing_id()), "linked-pairs"
    )
    counts = pair_counts(linked, side(second).size)
    blocks = max(1, math.ceil(counts.count() / at_once))
    if blocks == 1:
        return _summed(linked, _block(counts)).drop("row").select(*_COLUMNS)
    parts = None
    for k in range(blocks):
        own = _summed(linked, _block(counts.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k)))
        parts = own if parts is None else parts.unionAll(own)
    # Rows of one text differ in the sums only.
    whole = parts.groupBy("row").agg(
        *(F.max(c).alias(c) for c in _COLUMNS if c not in ("n_best", "count_sum")),
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"),
    )
    return whole.select(*_COLUMNS)


_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
