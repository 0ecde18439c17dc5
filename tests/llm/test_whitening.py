"""Whitening against numpy's eigenvectors and whole-number sums; the spectrum's certificates."""

import numpy as np
import pytest

from cartlens.llm import spectrum, whitening

ROWS = "vec_id long, embedding array<float>, n long, label int"


def _matrix(values, seed=0):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return (q * np.asarray(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    np.linspace(5, 0.1, 40), 1 + np.arange(30) * 1e-9, np.repeat([4.0, 3.0, 1.0], 4), [1.0], [2e-14, 1e-14], [1e12, 1.0, 1e-3],
    [3.0] * 20, [7.0, 5.0, 0.0, 0.0, 0.0],
])
def test_leading_pairs(values):
    m = _matrix(values)
    m = (m + m.T) / 2
    found = spectrum.leading(m, 16)
    expected = np.sort(np.asarray(values))[::-1][:16]
    expected = expected[expected > 8 * len(values) * np.finfo(float).eps * np.abs(m).sum(axis=1).max()]
    top = max(values)
    assert len(found.values) == len(expected)
    assert np.abs(found.values - expected).max() <= 1e-13 * top
    assert np.abs(m @ found.vectors.T - found.vectors.T * found.values).max() <= 1e-13 * top
    assert np.abs(found.vectors @ found.vectors.T - np.eye(len(expected))).max() < 1e-12
    assert found.certified()


def test_inertia_counts():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        m = rng.standard_normal((9, 9))
        m = m + m.T
        m[0, 0] = m[1, 1] = 0  # pivots of two rows
        values = np.linalg.eigvalsh(m)
        for shift in (0.0, values[0] - 1, values[-1] + 1, (values[3] + values[4]) / 2):
            assert spectrum.inertia_above(m, shift) == (values > shift).sum()
    assert spectrum.inertia_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert spectrum.inertia_above(np.zeros((3, 3)), 0.0) == 0


def test_wrong_numbers_are_not_certified():
    found = spectrum.leading(np.diag([4.0, 3.0, 2.0, 1.0]), 2)
    found.above_high = found.above_high + 1
    assert not found.certified()


def _expected(rows):
    x = np.array([np.floor(64 * np.asarray(v, np.float64)).astype(np.int64) + 1_000_000 for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_matches_numpy(spark):
    rng = np.random.default_rng(2)
    data = (rng.standard_normal((300, 20)) * np.linspace(1, 0.2, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(1000 + i, data[0].tolist()) for i in range(200)]
    bad = [(2000, None), (2001, [float("nan")] * 20), (2002, [None] + [1.0] * 19), (2003, [float("-inf")] + [1.0] * 19), (2004, [])]
    frame = spark.createDataFrame([(*r, 7, 1) for r in rows + bad], ROWS).repartition(5)
    found = whitening.whiten(frame)
    got = sorted(found.collect(), key=lambda r: (r["vec_id"], r["component"]))
    n, deviation, whitened, explained = _expected(rows)
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c) for i, _ in rows for c in range(1, 17)]
    assert {r["n"] for r in got} == {n} and n < len(rows)
    assert [r["deviation"] for r in got[::16]] == deviation.tolist()
    assert np.allclose([r["explained"] for r in got[:16]], explained, rtol=1e-9)
    own = np.array([r["whitened"] for r in got]).reshape(-1, 16)
    signs = np.sign((own * whitened).sum(axis=0))
    assert np.abs(own - whitened * signs).max() < 1e-8
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_odd_tables(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, -1.0]), (4, [0.5, 0.5]), (5, [1.0]), (6, [3e38, 0.0, 1.0]),
            (7, [0.0, 0.0, 1.0]), (7, [0.0, 0.0, 1.0])]
    frame = spark.createDataFrame([(*r, 7, 1) for r in rows], ROWS)
    found = whitening.whiten(frame).collect()
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], []).append(r)
    assert sorted(r["component"] for r in by[1]) == [1, 2] == sorted(r["component"] for r in by[None])
    assert by[1][0]["n"] == 3
    # Lengths are spaces of their own; a space of one vector has no components.
    assert 5 not in by
    # Entries too far apart for whole numbers of 64 bits leave the deviation null.
    assert [r["deviation"] for r in by[6]] == [None] and by[6][0]["n"] == 2 and len(by[7]) == 2
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("vec_id in (1, 2)")).count() == 0
