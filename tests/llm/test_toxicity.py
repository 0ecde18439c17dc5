"""Nearest labelled examples: search against all pairs, scores on held-out documents, edge cases."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cartlens.llm import toxicity
from cartlens.llm.blockmax import BlockMax, Sparse, unit

DOCS = "doc_id long, text string, label string, evidence string, term long"


def _sparse(rows, terms):
    bounds = np.cumsum([0, *map(len, rows)])
    flat = [t for row in rows for t in sorted(row.items())]
    return unit(bounds, np.array([t for t, _ in flat], np.int64), np.array([w for _, w in flat], np.float64))


def _dense(rows: Sparse, terms):
    out = np.zeros((len(rows), terms))
    out[rows.rows, rows.terms] = rows.weights
    return out


vectors = st.lists(st.dictionaries(st.integers(0, 11), st.integers(1, 4), max_size=5), max_size=60)


@settings(max_examples=60, deadline=None)
@given(vectors, vectors, st.integers(1, 9))
def test_search_is_exact(examples, queries, k):
    e, q = _sparse(examples, 12), _sparse(queries, 12)
    near, cosines = BlockMax(e, 12, block=4).search(q, k)
    every = _dense(q, 12) @ _dense(e, 12).T
    for i in range(len(q)):
        hits = [j for j in range(len(e)) if every[i, j] > 0]
        best = sorted(every[i, hits], reverse=True)[:k]
        held = near[i] >= 0
        assert np.allclose(cosines[i][held], best)
        assert np.allclose(every[i, near[i][held]], best)
        assert len(set(near[i][held])) == len(best)


def _rows():
    rng = random.Random(5)
    plain = [f"word{i}" for i in range(300)]
    rude = ["dolt", "oaf", "nitwit", "Blockheadery", "blockheaded", "blockheads"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 3) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


ROWS = _rows()


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame([(i, t, "l", "e", 1) for i, t, _ in ROWS], DOCS).repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in ROWS], "doc_id long, quality int, toxic int")
    return docs, labels, toxicity.fit_examples(docs, labels)


def test_held_out_documents(fitted):
    docs, _, examples = fitted
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, examples).collect()}
    held = [(i, y) for i, _, y in ROWS if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(found[i]["score"] >= toxicity.PREDICT) == (y == 1) for i, y in held]
    assert len(held) > 60 and sum(right) / len(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    # The evidence never comes from documents held out.
    assert all(zlib.crc32(str(e["doc_id"]).encode()) % 4 != 2 for r in found.values() for e in r["evidence"])


def test_scores_match_all_pairs(fitted):
    """Terms, weights, neighbours and votes anew, one document at a time."""
    docs, _, examples = fitted

    def terms(text):
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        raw = [w.encode() for w in words]
        return collections.Counter([("word", w) for w in raw] + [(s, w[:s]) for w in raw for s in toxicity.STEMS if len(w) > s])

    held = [terms(t) for _, t, _ in ROWS]
    train = [k for k, (i, _, _) in enumerate(ROWS) if zlib.crc32(str(i).encode()) % 4 != 2]
    n, marked = len(train), sum(ROWS[k][2] for k in train)
    gains = {}
    for t in {t for k in train for t in held[k]}:
        a = sum(ROWS[k][2] for k in train if t in held[k])
        b = sum(1 - ROWS[k][2] for k in train if t in held[k])
        cells = [(a, a + b, marked), (b, a + b, n - marked), (marked - a, n - a - b, marked), (n - marked - b, n - a - b, n - marked)]
        gains[t] = 2 * sum(x * math.log(x * n / (r * c)) for x, r, c in cells if x)
    known = {t for t, g in gains.items() if g >= toxicity.LEAST_GAIN}
    assert len(known) == len(examples.vocabulary)
    idf = {t: math.log((1 + len(ROWS)) / (1 + sum(t in x for x in held))) + 1 for t in known}

    def vector(x):
        v = {t: (1 + math.log(c)) * idf[t] for t, c in x.items() if t in known}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in v.items()}

    every = [vector(x) for x in held]
    scored = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, examples).collect()}
    prior = marked / n
    for k, (i, _, _) in enumerate(ROWS):
        near = sorted((-sum(w * every[j].get(t, 0) for t, w in every[k].items()), ROWS[j][0]) for j in train)
        near = [(-c, j) for c, j in near if c < 0][: toxicity.NEIGHBOURS]
        assert np.allclose([e["cosine"] for e in scored[i]["evidence"]], [c for c, _ in near])
        weight = [1 - math.acos(min(1, e["cosine"])) / (math.pi / 2) for e in scored[i]["evidence"]]
        vote = (sum(w * e["label"] for w, e in zip(weight, scored[i]["evidence"])) + 0.1 * prior) / (sum(weight) + 0.1)
        vote = min(max(vote, 1e-3), 1 - 1e-3)
        expected = 1 / (1 + math.exp(-(examples.scale * math.log(vote / (1 - vote)) + examples.shift)))
        assert abs(scored[i]["score"] - expected) < 1e-6


def test_odd_rows(spark, fitted):
    _, labels, examples = fitted
    rows = [(1, None), (1, ""), (None, "dolt"), (2, "dolt " * 300_000), (3, " \t"), (4, "DOLT! oaf"), (4, "DOLT! oaf")]
    docs = spark.createDataFrame([(*r, "l", "e", 1) for r in rows], DOCS)
    found = toxicity.score_toxicity(docs, examples)
    assert found.columns == ["doc_id", "text", "label", "term", "score", "evidence"]
    found = {(r["doc_id"], r["text"]): r for r in found.collect()}
    assert found[1, None]["score"] == found[1, ""]["score"] == found[3, " \t"]["score"] < toxicity.PREDICT
    assert found[1, None]["evidence"] == []
    assert found[None, "dolt"]["score"] == found[2, "dolt " * 300_000]["score"] > 0.5
    assert toxicity.score_toxicity(docs.limit(0), examples).count() == 0


def test_no_labels(spark, fitted):
    docs, labels, _ = fitted
    nothing = toxicity.fit_examples(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, nothing).collect()} == {0.5}
    one_kind = toxicity.fit_examples(docs, labels.where("toxic = 0"))
    assert max(r["score"] for r in toxicity.score_toxicity(docs, one_kind).collect()) < toxicity.PREDICT
    empty = toxicity.fit_examples(docs.limit(0), labels)
    assert toxicity.score_toxicity(docs.limit(0), empty).count() == 0


def test_labels_with_nulls_and_copies(spark, fitted):
    docs, labels, examples = fitted
    odd = spark.createDataFrame([(None, 1, 1), (0, 1, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    again = toxicity.fit_examples(docs.unionAll(docs), labels.unionAll(odd))
    assert set(examples.vocabulary) == set(again.vocabulary)
    assert (again.ids == examples.ids).all()
