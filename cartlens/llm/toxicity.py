"""Toxicity by the nearest labelled examples: exact TF-IDF cosine, block-max index, distance-weighted votes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm import words as WD
from cartlens.llm.base import batches, remainder, texts, whole
from cartlens.llm.blockmax import BlockMax, Sparse, unit
from cartlens.llm.ftrl import probabilities
from cartlens.session import cut_lineage

SAMPLE_DOCS = 10_000
# A term belongs to the vocabulary if its log-likelihood ratio with the label is at least this.
LEAST_GAIN = 16.0
MOST_TERMS = 1 << 14
NEIGHBOURS = 15
PREDICT = 0.3
FOLDS, HELD_OUT = 4, 2
# Bytes of the beginnings of words that are terms beside the words.
STEMS = (4, 5, 6, 7)
# The calibration's pull of both of its numbers towards one and zero.
_RIDGE = 1.0
_TEXT_BYTES = 1 << 20
_IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term: words of letters and digits, and the first bytes of longer words."""
    # Other marks part words as spaces do.
    found = WD.split(np.where(_IS_TERM[raw], raw, 32).astype(np.uint8), offsets)
    rows = found.rows
    hashes, at = [found.hashes], [rows]
    for size in STEMS:
        long = np.flatnonzero(found.ends - found.starts > size)
        bytes_ = raw[found.starts[long][:, None] + np.arange(size)].astype(np.uint64)
        packed = (bytes_ << (np.arange(size, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)
        hashes.append(WD.mix(packed, 16 + size))
        at.append(rows[long])
    return np.concatenate(hashes).view(np.int64), np.concatenate(at)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with about a megabyte of text, in lower case; a longer text is a range of its own."""
    column = pc.utf8_lower(batch.column("text").fill_null(""))
    raw, offsets = texts(pa.RecordBatch.from_arrays([column], ["text"]))
    groups = offsets[:-1] // _TEXT_BYTES
    for group in np.unique(groups):
        a, b = (int(np.searchsorted(groups, group, side=side)) for side in ("left", "right"))
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def counted(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds by row, distinct terms and how often each occurs."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(h)))
    return np.searchsorted(r[first], np.arange(n + 1)), h[first], times


def _example_terms(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(found):
        for a, b, raw, offsets in _parts(batch):
            bounds, h, times = counted(*terms(raw, offsets), b - a)
            rows = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("label"),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(times.astype(np.int32))),
                ],
                ["doc_id", "label", "terms", "times"],
            )


@dataclass
class Examples:
    """Vocabulary with its weights, the index of the labelled examples, and the calibration of their votes."""

    vocabulary: np.ndarray
    idf: np.ndarray
    index: BlockMax
    ids: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS
    scale: float = 1.0
    shift: float = 0.0

    def rows(self, bounds: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> Sparse:
        """Unit TF-IDF vectors of counted terms, those outside the vocabulary left out."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        kept = np.concatenate([[0], np.cumsum(known)])[bounds]
        at = at[known]
        return unit(kept, at, (1 + np.log(times[known])) * self.idf[at])

    def votes(self, rows: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Share of the label among the neighbours, each weighing by its nearness; the prior counts as a far one.

        The weight falls with the angular distance, from one for an equal vector to zero without shared terms.
        """
        weight = np.where(rows >= 0, 1 - np.arccos(np.clip(cosines, 0, 1)) / (np.pi / 2), 0)
        held = np.where(rows >= 0, self.labels[np.maximum(rows, 0)], 0) if len(self.labels) else np.zeros(rows.shape)
        return ((weight * held).sum(axis=1) + 0.1 * self.prior) / (weight.sum(axis=1) + 0.1)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return probabilities((self.scale * _logit(votes) + self.shift)[:, None])[:, 0]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _calibrate(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the votes' log-odds with the greatest penalised likelihood (Newton steps, convex)."""
    x = np.stack([_logit(votes), np.ones(len(votes))], axis=1)
    prior = np.array([1.0, 0.0])
    found = prior.copy()
    for _ in range(50):
        p = probabilities((x @ found)[:, None])[:, 0]
        gradient = x.T @ (p - labels) + _RIDGE * (found - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + _RIDGE * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        found = found - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return float(found[0]), float(found[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, label, text`` of at most ``limit`` labelled training documents, chosen by a hash of the id.

    A document with several labels has the larger one; of rows that repeat an id the smallest text counts. Equal
    texts are one example, with the larger label: copies would make terms of all their words.
    """
    marked = labels.where(
        F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT)
    )
    chosen = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id")  # ``limit`` rows
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))


def vocabulary(examples: DataFrame, least_gain: float = LEAST_GAIN, most: int = MOST_TERMS) -> np.ndarray:
    """Terms that tell the labels apart, ascending: those whose log-likelihood ratio is at least ``least_gain``.

    The ratio is twice the information that a term's presence in a document gives about its label, in
    nats, over all examples; unlike chi-square it does not flatter rare terms. At most ``most``, the best first.
    """
    sizes = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    clean, marked = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not marked:
        return np.zeros(0, np.int64)
    found = examples.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")
    )
    n = F.lit(float(clean + marked))

    def part(seen, row, column):
        return F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(F.lit(0.0))

    a, b = F.col("a"), F.col("b")
    with_, without = a + b, n - a - b
    c, d = F.lit(float(marked)) - a, F.lit(float(clean)) - b
    gain = 2 * (
        part(a, with_, F.lit(float(marked))) + part(b, with_, F.lit(float(clean)))
        + part(c, without, F.lit(float(marked))) + part(d, without, F.lit(float(clean)))
    )
    best = found.withColumn("gain", gain).where(F.col("gain") >= least_gain)
    kept = best.orderBy(F.desc("gain"), "term").limit(most).collect()
    return np.sort(np.array([r["term"] for r in kept], np.int64))


def document_frequencies(docs: DataFrame, known: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of all documents, and how many of them hold each known term."""
    sent = docs.sparkSession.sparkContext.broadcast(known)  # MOST_TERMS numbers

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        held, rows = np.zeros(len(own), np.int64), 0
        for batch in batches(found):
            rows += batch.num_rows
            for a, b, raw, offsets in _parts(batch):
                hashes, at = terms(raw, offsets)
                place = np.searchsorted(own, hashes)
                place[place == len(own)] = 0
                hit = own[place] == hashes if len(own) else np.zeros(len(hashes), bool)
                pairs = np.unique(at[hit] * len(own) + place[hit])
                held += np.bincount(pairs % max(1, len(own)), minlength=len(own))
        hit = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(hit, -1)), pa.array(np.append(held[hit], rows))], ["place", "n"]
        )

    counts = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = {r["place"]: r["n"] for r in counts.collect()}
    return found.pop(-1, 0), np.array([found.get(i, 0) for i in range(len(known))], np.int64)


def fit_examples(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    least_gain: float = LEAST_GAIN,
    neighbours: int = NEIGHBOURS,
) -> Examples:
    """Index of at most ``sample_docs`` labelled documents, with terms weighed by how many of all documents hold them.

    The votes are calibrated on the examples themselves, each judged by the others. Without labels of both
    kinds the vocabulary is empty, and every score is the share of the label among the examples, 0.5 without any.
    """
    sample = labelled_sample(docs, labels, sample_docs).select("doc_id", "label", "text")
    kind = sample.schema["doc_id"].dataType.simpleString()
    examples = cut_lineage(
        sample.mapInArrow(_example_terms, f"doc_id {kind}, label int, terms array<long>, times array<int>"), "examples"
    )
    known = vocabulary(examples, least_gain)
    number, held = document_frequencies(docs, known)
    idf = np.log((1 + number) / (1 + held)) + 1
    # Only terms of the vocabulary reach the driver: at most ``sample_docs`` rows of as many terms.
    keep = examples.sparkSession.createDataFrame([(int(t),) for t in known], "term long")
    pairs = examples.select("doc_id", "label", F.explode(F.arrays_zip("terms", "times")).alias("x"))
    pairs = pairs.select("doc_id", "label", F.col("x.terms").alias("term"), F.col("x.times").alias("n"))
    rows = pairs.join(F.broadcast(keep), "term").groupBy("doc_id", "label").agg(  # MOST_TERMS numbers
        F.sort_array(F.collect_list(F.struct("term", "n"))).alias("own")
    )
    rows = rows.orderBy("doc_id").collect()
    total = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    marked, all_ = total.get(1, 0), sum(total.values())
    bounds = np.cumsum([0, *(len(r["own"]) for r in rows)])
    hashes = np.array([t for r in rows for t, _ in r["own"]], np.int64)
    times = np.array([n for r in rows for _, n in r["own"]], np.int64)
    out = Examples(
        known, idf, None, np.array([r["doc_id"] for r in rows]), np.array([r["label"] for r in rows], np.float64),
        marked / all_ if all_ else 0.5, neighbours,
    )
    vectors = out.rows(bounds, hashes, times)
    out.index = BlockMax(vectors, len(known))
    if len(rows):
        # Each example without itself, which is among its nearest or tied with them.
        near, cosines = out.index.search(vectors, neighbours + 1)
        own = near == np.arange(len(rows))[:, None]
        own[~own.any(axis=1), -1] = True
        votes = out.votes(near[~own].reshape(len(rows), -1), cosines[~own].reshape(len(rows), -1))
        rest = all_ - len(rows)  # examples without a known term
        nothing = out.votes(np.full((1, 1), -1), np.zeros((1, 1)))
        alike = np.concatenate([votes, np.repeat(nothing, rest)])
        lone = np.zeros(rest)
        lone[: int(marked - out.labels.sum())] = 1
        out.scale, out.shift = _calibrate(alike, np.concatenate([out.labels, lone]))
    return out


def score_toxicity(docs: DataFrame, examples: Examples, column: str = "score") -> DataFrame:
    """``docs`` with its score and ``evidence``: the nearest labelled examples, ids with cosine and label.

    The score is how likely each whole text carries the label, 0 to 1. Null and empty texts, and texts without a
    known term, have no neighbours and get the calibrated prior. No rows give no rows. Columns that already
    have these names are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in (column, "evidence")])
    sent = docs.sparkSession.sparkContext.broadcast(examples)  # SAMPLE_DOCS sparse rows
    kind = "long" if examples.ids.dtype.kind in "iu" or not len(examples.ids) else "string"
    arrow = pa.int64() if kind == "long" else pa.string()

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches(found):
            for a, b, raw, offsets in _parts(batch):
                queries = own.rows(*counted(*terms(raw, offsets), b - a))
                near, cosines = own.index.search(queries, own.neighbours)
                values = own.calibrated(own.votes(near, cosines))
                hit = near >= 0
                bounds = np.concatenate([[0], np.cumsum(hit.sum(axis=1))])
                ids = own.ids[near[hit]] if len(own.ids) else np.zeros(0)
                labels = own.labels[near[hit]] if len(own.ids) else np.zeros(0)
                evidence = pa.StructArray.from_arrays(
                    [pa.array(ids.tolist(), arrow), pa.array(cosines[hit]), pa.array(labels.astype(np.int32))],
                    ["doc_id", "cosine", "label"],
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(values),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), evidence)],
                    [*batch.schema.names, column, "evidence"],
                )

    near = T._parse_datatype_string(f"array<struct<doc_id: {kind}, cosine: double, label: int>>")
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(column, T.DoubleType()), T.StructField("evidence", near)]
    )
    return docs.mapInArrow(score, schema)
