"""Leading eigenpairs of a symmetric matrix by spectrum slicing: inertia counts, then Rayleigh quotient iteration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_EPS = np.finfo(np.float64).eps
# Pivots of the Bunch-Kaufman rule: below this share of its column's largest entry a pivot is taken two by two.
_ALPHA = (1 + 17**0.5) / 8
_ITERATIONS = 200


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``.

    By Sylvester's law they are as many as the positive eigenvalues of D in ``matrix - shift I = L D L'``, with
    pivots of one or two rows. A zero pivot counts as negative: an eigenvalue equal to the shift is not above it.
    """
    a = np.array(matrix, np.float64)
    a[np.diag_indices_from(a)] -= shift
    n, at, above = len(a), 0, 0
    while at < n:
        column = np.abs(a[at + 1 :, at])
        widest = column.max() if len(column) else 0.0
        size = 1
        if widest > 0:
            if abs(a[at, at]) < _ALPHA * widest:
                r = at + 1 + int(column.argmax())
                row = np.abs(a[r, at:])
                row[r - at] = 0
                other = row.max()
                if abs(a[at, at]) * other >= _ALPHA * widest * widest:
                    pass
                elif abs(a[r, r]) >= _ALPHA * other:
                    _swap(a, at, r)
                else:
                    _swap(a, at + 1, r)
                    size = 2
        if size == 1:
            pivot = a[at, at]
            above += pivot > 0
            if pivot:
                rest = a[at + 1 :, at]
                a[at + 1 :, at + 1 :] -= np.outer(rest / pivot, rest)
        else:
            block = a[at : at + 2, at : at + 2]
            # Such a pivot has a negative determinant: one eigenvalue on either side.
            above += 1
            rest = a[at + 2 :, at : at + 2]
            a[at + 2 :, at + 2 :] -= rest @ np.linalg.solve(block, rest.T)
        at += size
    return above


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


@dataclass
class Slices:
    """Eigenpairs by falling eigenvalue, the row of ``vectors`` each, and what certifies their numbers."""

    values: np.ndarray
    vectors: np.ndarray
    # Bounds around each eigenvalue, and how many eigenvalues the inertia counts say lie above either bound.
    low: np.ndarray
    high: np.ndarray
    above_low: np.ndarray
    above_high: np.ndarray

    def certified(self) -> bool:
        """Whether the counts place the eigenvalues numbered from 1 between their bounds, and all larger ones above."""
        number = np.arange(len(self.values))
        return bool(((self.above_high <= number) & (number < self.above_low)).all())


def _brackets(count, top: float, bottom: float, most: int, narrow: float) -> list[tuple[float, float, int, int]]:
    """Bounds ``low, high`` and the counts above them around the ``most`` largest eigenvalues.

    Halved until each holds one eigenvalue, or is as narrow as ``narrow`` with several that double precision
    hardly tells apart.
    """
    found = []
    open_ = [(bottom, top, count(bottom), 0)]
    while open_:
        low, high, at_low, at_high = open_.pop()
        if at_high >= most or at_low == at_high:
            continue
        # One eigenvalue alone, and far enough from the bounds' width for its quotients to settle on it.
        if high - low <= narrow or (at_low - at_high == 1 and high - low <= 1e-3 * max(abs(high), abs(low))):
            found.append((low, high, at_low, at_high))
            continue
        middle = (low + high) / 2
        held = count(middle)
        open_ += [(low, middle, at_low, held), (middle, high, held, at_high)]
    return sorted(found, key=lambda b: b[3])


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """``(matrix - shift I)^-1 right``; a shift on an eigenvalue moves by what rounding hides."""
    n = len(matrix)
    for bump in (0.0, 4 * _EPS, 64 * _EPS):
        try:
            found = np.linalg.solve(matrix - (shift + bump * max(1.0, abs(shift))) * np.eye(n), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    return right


def _pair(matrix: np.ndarray, low: float, high: float, start: np.ndarray, count) -> tuple[float, np.ndarray]:
    """The one eigenpair between the bounds: inverse steps at the middle, then Rayleigh quotients, which converge cubically.

    An eigenvalue lies within a quotient's error of it. So once that range is inside the bounds, the quotients can
    only settle on the eigenvalue there. Where the inverse steps are slow, a count halves the bounds.
    """
    vector = start / np.sqrt(start @ start)
    scale = np.abs(matrix).sum(axis=1).max()
    inside = count(low)
    slow, best = 0, (np.inf, (low + high) / 2, vector)
    for _ in range(_ITERATIONS):
        value = float(vector @ matrix @ vector)
        gap = matrix @ vector - value * vector
        error = float(np.sqrt(gap @ gap))
        safe = low <= value - error and value + error <= high
        # At the smallest errors, rounding decides; no step can better them.
        settled = error <= 4 * _EPS * scale and low - error <= value <= high + error
        if settled or (safe and error >= best[0]):
            return (value, vector) if error < best[0] else best[1:]
        if safe:
            best = (error, value, vector)
        else:
            slow += 1
            if slow % 4 == 0:
                middle = (low + high) / 2
                if count(middle) == inside:
                    low = middle
                else:
                    high = middle
        vector = _solve(matrix, value if safe else (low + high) / 2, vector)
        vector = vector / np.sqrt(vector @ vector)
    return best[1:]


def leading(matrix: np.ndarray, most: int, least: float | None = None) -> Slices:
    """The ``most`` largest eigenpairs of a symmetric positive semidefinite matrix above ``least``.

    ``least`` is by default the size of rounding errors, so directions without variance are left out. Inertia
    counts isolate each eigenvalue; eigenvalues too close to part share an orthonormal basis from subspace
    iteration. At the end counts at bounds around the values found certify their numbers; where they do not, the
    numbers are unproven and ``numpy.linalg.LinAlgError`` is raised.
    """
    matrix = (matrix + matrix.T) / 2
    n = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    if not scale or not most:
        return Slices(*(np.zeros(s) for s in (0, (0, n), 0, 0, 0, 0)))
    unit = matrix / scale  # counts and solves on numbers of order one
    least = 8 * n * _EPS if least is None else max(least / scale, 8 * n * _EPS)
    memory: dict[float, int] = {}

    def count(shift: float) -> int:
        if shift not in memory:
            memory[shift] = inertia_above(unit, shift)
        return memory[shift]

    narrow = 64 * _EPS
    draw = np.random.default_rng(13).standard_normal((n, n))
    values, vectors = [], []
    for low, high, at_low, at_high in _brackets(count, 1.0 + 1e-9, least, most, narrow):
        held = at_low - at_high
        if held == 1:
            value, vector = _pair(unit, low, high, draw[at_high], count)
            values.append(value)
            vectors.append(vector)
            continue
        basis = draw[:, at_high:at_low]
        for _ in range(4):
            basis = np.linalg.qr(_solve(unit, (low + high) / 2, basis))[0]
        inner, turn = np.linalg.eigh(basis.T @ unit @ basis)
        values += inner[::-1].tolist()
        vectors += list((basis @ turn[:, ::-1]).T)
    values, vectors = values[:most], vectors[:most]
    # Vectors of neighbours are as orthogonal as their gap allows; one pass in order makes them so to rounding.
    for i, vector in enumerate(vectors):
        for before in vectors[:i]:
            vector = vector - (before @ vector) * before
        vectors[i] = vector / np.sqrt(vector @ vector)
    values = np.array(values)
    slack = 16 * n * _EPS
    low, high = values - slack, values + slack
    above_low = np.array([count(float(x)) for x in low], np.int64)
    above_high = np.array([count(float(x)) for x in high], np.int64)
    found = Slices(values * scale, np.array(vectors).reshape(-1, n), low * scale, high * scale, above_low, above_high)
    if not found.certified():
        raise np.linalg.LinAlgError("inertia counts do not confirm the numbers of the eigenvalues")
    return found
