"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.base import batches, remainder, slices, whole
from cartlens.llm.ftrl import Ftrl, probabilities

BITS = 16
ORDERS = (1, 2, 3)
SAMPLE_DOCS = 8_000
EPOCHS = 3
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
_CHARS = 1 << 19
# TF-IDF values of a text sum to this.
_SCALE = 30.0


@dataclass
class LanguageModel:
    """``weights[gram, language]`` already times the gram's inverse document frequency ``idf``."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(rows: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams that end in a letter, the row of each, and whether a row has a letter at all.

    Case is folded; everything but letters counts as one and the same gap.
    """
    low = [row.lower() for row in rows]
    lengths = np.fromiter((len(x) + 1 for x in low), np.int64, len(low))
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    row = np.repeat(np.arange(len(low)), lengths)
    ends = np.flatnonzero(letter)
    found, at = [], []
    state = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for order in range(1, max(ORDERS) + 1):
            # The gap before the first row also closes each row.
            state = (state + codes[(np.arange(len(codes)) - order + 1)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            state ^= state >> np.uint64(29)
            if order in ORDERS:
                mixed = (state[ends] * np.uint64(0xBF58476D1CE4E5B9 + 2 * order)) >> np.uint64(64 - bits)
                found.append(mixed.astype(np.int64))
                at.append(row[ends])
    some = np.bincount(row[ends], minlength=len(low)) > 0
    return np.concatenate(found), np.concatenate(at), some


def _strings(batch: pa.RecordBatch) -> list[str]:
    return batch.column("text").fill_null("").to_pylist()


def _frequencies(found: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """In how many texts of the partition each gram occurs."""
    seen = np.zeros(1 << bits, np.int64)
    for batch in batches(found):
        rows = _strings(batch)
        for a, b in slices(rows, _CHARS):
            features, at, _ = grams(rows[a:b], bits)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(b - a + 1))
            features = features[order]
            flag = np.zeros(1 << bits, bool)
            for i, j in zip(cuts, cuts[1:]):
                flag[features[i:j]] = True
                here = np.flatnonzero(flag)
                seen[here] += 1
                flag[here] = False
    here = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(seen[here])], ["gram", "n"])


def training_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` to learn from."""
    rows = docs.select("doc_id", whole().alias("text"), "lang")
    return rows.where(F.col("lang").isNotNull() & (remainder("doc_id", FOLDS) != HELD_OUT))


def _examples(found, idf: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches(found):
        rows, packed = _strings(batch), []
        for a, b in slices(rows, _CHARS):
            features, at, _ = grams(rows[a:b], bits)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(b - a + 1))
            for i, j in zip(cuts, cuts[1:]):
                own, counts = np.unique(features[order[i:j]], return_counts=True)
                values = counts * idf[own]
                values *= _SCALE / max(values.sum(), 1e-12)
                packed.append(pickle.dumps((own.astype(np.uint32), values)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("calibrates"), pa.array(packed, pa.binary())],
            ["lang", "calibrates", "packed"],
        )


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, to a hundredth of a power of two."""
    if not len(labels):
        return 1.0
    steps = 2.0 ** np.linspace(-4, 4, 801)
    rows = np.arange(len(labels))
    losses = [-np.log(probabilities(logits / t)[rows, labels] + 1e-300).mean() for t in steps]
    return float(steps[int(np.argmin(losses))])


def _fit(found, languages: list[str], bits: int, epochs: int) -> Iterator[pa.RecordBatch]:
    place = {name: i for i, name in enumerate(languages)}
    learn, check = [], []
    for batch in batches(found):
        for lang, calibrates, packed in zip(*(batch.column(c).to_pylist() for c in ("lang", "calibrates", "packed"))):
            features, values = pickle.loads(packed)
            features = np.append(features.astype(np.int64), 1 << bits)
            example = (features, np.append(values, 1.0), place[lang])
            (check if calibrates else learn).append(example)
    model = Ftrl((1 << bits) + 1, max(2, len(languages)), alpha=0.3, l1=0.05, l2=0.1)
    for _ in range(epochs):
        for example in learn:
            model.update(*example)
    weights = model.weights()
    logits = np.array([x @ weights[f] for f, x, _ in check]).reshape(len(check), -1)
    heat = _temperature(logits, np.array([y for *_, y in check], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((weights, heat))], pa.binary())], ["model"])


def fit_language(
    docs: DataFrame, sample_docs: int = SAMPLE_DOCS, bits: int = BITS, epochs: int = EPOCHS
) -> LanguageModel:
    """Learn the languages of ``doc_id, text, lang``.

    Document frequencies count every training text. The weights are fitted in one task on a sample of about
    ``sample_docs`` texts, chosen by a hash of the id, with equal shares for the languages as far as they
    have texts. A fifth of the sample only calibrates the temperature.
    """
    rows = training_rows(docs)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return LanguageModel()
    seen = rows.select("text").mapInArrow(lambda found: _frequencies(found, bits), "gram long, n long")
    known = seen.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # 2^bits rows at most
    df = np.zeros(1 << bits)
    df[known["gram"]] = known["n"]
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1.0

    languages = sorted(counts)
    share = sample_docs / len(languages)
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, share / counts[lang]))])
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1e6
    sample = rows.where(spot < rates[F.col("lang")])
    sample = sample.withColumn("key", F.xxhash64(F.lit(7), "doc_id", "text"))
    sample = sample.withColumn("calibrates", F.pmod("key", F.lit(5)) == 0)
    ordered = sample.repartition(1).sortWithinPartitions("key", "doc_id").select("lang", "calibrates", "text")
    packed = ordered.mapInArrow(
        lambda found: _examples(found, idf, bits), "lang string, calibrates boolean, packed binary"
    )
    row = packed.mapInArrow(lambda found: _fit(found, languages, bits, epochs), "model binary").first()
    weights, heat = pickle.loads(row["model"])
    return LanguageModel(languages, idf, weights[:-1] * idf[:, None], weights[-1], heat)


def predict(rows: list[str], model: LanguageModel, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Language and its calibrated probability for each text."""
    names, scores = [], []
    for a, b in slices(rows, _CHARS):
        features, at, some = grams(rows[a:b], bits)
        if model.weights is None:
            names += [UNKNOWN] * (b - a)
            scores.append(np.zeros(b - a))
            continue
        n = b - a
        logits = np.stack([np.bincount(at, w[features], n) for w in model.weights.T], axis=1)
        mass = np.bincount(at, model.idf[features], n)
        logits = logits * (_SCALE / np.maximum(mass, 1e-12))[:, None] + model.bias
        p = probabilities(logits / model.temperature)[:, : len(model.languages)]
        best = p.argmax(axis=1)
        names += [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, some)]
        scores.append(np.where(some, p[np.arange(n), best], 0.0))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def identify(docs: DataFrame, model: LanguageModel, bits: int = BITS) -> DataFrame:
    """``doc_id, lang_pred, score`` for every whole text of ``doc_id, text``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Equal scores go to
    the language first in code point order. No rows give no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits numbers per language

    def apply(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            names, scores = predict(_strings(batch), sent.value, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"doc_id {kind}, lang_pred string, score double")
