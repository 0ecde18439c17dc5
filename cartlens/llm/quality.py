"""Quality classifier: logistic regression on hashed word n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm import words as WD
from cartlens.llm.base import batches, remainder, texts, whole
from cartlens.llm.ftrl import Ftrl, probabilities

BITS = 18
SAMPLE_DOCS = 10_000
EPOCHS = 3
KEEP = 0.7
FOLDS, HELD_OUT = 4, 2
# Bytes of ASCII marks, neither letter nor digit.
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def ngrams(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed word n-grams of the texts: feature and row of each occurrence.

    Words, word pairs, one feature for any word that follows itself, and the marks that end a word,
    which rare words share.
    """
    found = WD.split(raw, offsets)
    rows = found.rows
    starts, pairs = WD.runs(found, 2)
    again = starts[found.hashes[starts] == found.hashes[starts + 1]] if len(starts) else starts
    last = raw[found.ends - 1].astype(np.uint64) if len(rows) else np.zeros(0, np.uint64)
    marked = np.flatnonzero(_MARK[last.astype(np.int64)] & (found.ends - found.starts > 1))
    marks = WD.mix(last[marked] * np.uint64(256) + raw[found.ends[marked] - 2].astype(np.uint64), 5)
    repeated = WD.mix(np.full(len(again), 1, np.uint64), 6)
    shift = np.uint64(64 - bits)
    features = np.concatenate([found.hashes, pairs, marks, repeated]) >> shift
    return features.astype(np.int64), np.concatenate([rows, rows[starts], rows[marked], rows[again]])


def _examples(found: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(found):
        features, rows = ngrams(*texts(batch), bits)
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
        parts = [features[order[a:b]].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(parts, pa.binary())], ["label", "features"]
        )


def _fit(found: Iterator[pa.RecordBatch], bits: int, epochs: int) -> Iterator[pa.RecordBatch]:
    examples = []
    for batch in batches(found):
        for label, packed in zip(batch.column("label").to_pylist(), batch.column("features").to_pylist()):
            features, counts = np.unique(np.frombuffer(packed, "<u4"), return_counts=True)
            examples.append((features, counts.astype("<u4"), label))
    model = Ftrl((1 << bits) + 1)
    for _ in range(epochs):
        for features, counts, label in examples:
            values = np.append(counts / np.sqrt(max(1, counts.sum(dtype=np.int64))), 1.0)
            model.update(np.append(features.astype(np.int64), 1 << bits), values, label)
    weights = model.weights()[:, 0].astype("<f8").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([weights], pa.binary())], ["weights"])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_DOCS) -> DataFrame:
    """``key, text, label`` of at most ``limit`` labelled training documents, chosen by a hash of the id.

    A document with several labels has the larger one; of rows that repeat an id the smallest text counts.
    """
    marked = labels.where(
        F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT)
    )
    chosen = (
        marked.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label"))
        .withColumn("key", F.xxhash64("doc_id"))
        .orderBy("key", "doc_id").limit(limit)
    )
    rows = docs.select("doc_id", whole().alias("text")).join(F.broadcast(chosen), "doc_id")  # ``limit`` rows
    return rows.groupBy("doc_id", "key", "label").agg(F.min("text").alias("text"))


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, bits: int = BITS, epochs: int = EPOCHS
) -> np.ndarray:
    """Weights of the hashed n-grams, the last one for every text alike.

    The fit sees at most ``sample_docs`` labelled documents in a fixed order, so it runs in one task of
    bounded size. Without labelled documents all weights are zero and every score is 0.5.
    """
    sample = labelled_sample(docs, labels, sample_docs)
    examples = sample.select("key", "doc_id", "label", "text")
    examples = examples.repartition(1).sortWithinPartitions("key", "doc_id").select("label", "text")
    # One step of Python: with two, the task's executor would start and keep two workers for it.
    row = examples.mapInArrow(lambda found: _fit(_examples(found, bits), bits, epochs), "weights binary").first()
    return np.frombuffer(row["weights"], "<f8") if row else np.zeros((1 << bits) + 1)


def scores(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Sparse dot product of each text's n-gram counts, over the root of their number, with the weights."""
    rows = len(offsets) - 1
    total, number = np.zeros(rows), np.zeros(rows)
    # About a megabyte of text at a time.
    groups = offsets[:-1] // (1 << 20)
    for group in np.unique(groups):
        first, last = np.searchsorted(groups, group), np.searchsorted(groups, group, side="right")
        part = raw[offsets[first] : offsets[last]]
        features, at = ngrams(part, offsets[first : last + 1] - offsets[first], bits)
        total[first:last] = np.bincount(at, weights[features], last - first)
        number[first:last] = np.bincount(at, minlength=last - first)
    return probabilities((total / np.sqrt(np.maximum(number, 1)) + weights[-1])[:, None])[:, 0]


def score_quality(docs: DataFrame, weights: np.ndarray, column: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with one more column: how likely each whole text is of good quality, 0 to 1.

    Null and empty texts get the score that holds before any word is seen. No rows give no rows. A column
    that already has the name is replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c != column])
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits numbers

    def score(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            values = scores(*texts(batch), sent.value, bits)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values)], [*batch.schema.names, column]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    return docs.mapInArrow(score, schema)
