"""Exact cosine top-k over sparse unit vectors by an inverted index with the largest weight of each block."""

from __future__ import annotations

import numpy as np

BLOCK = 64
_QUERIES_AT_ONCE = 2048


class Sparse:
    """Rows of term numbers and weights: row r holds ``terms[bounds[r]:bounds[r + 1]]``, ascending."""

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.bounds, self.terms, self.weights = bounds, terms, weights

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.bounds))

    def take(self, which: np.ndarray) -> Sparse:
        sizes = np.diff(self.bounds)[which]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.bounds[which] - bounds[:-1], sizes) + np.arange(bounds[-1])
        return Sparse(bounds, self.terms[at], self.weights[at])


def unit(bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Sparse:
    """Rows divided by their length; a row of zeros stays."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    length = np.sqrt(np.bincount(rows, weights * weights, len(bounds) - 1))
    return Sparse(bounds, terms, weights / np.where(length > 0, length, 1)[rows])


class BlockMax:
    """Postings by term and block of examples, and the largest weight of each term in each block.

    Examples are ordered by their heaviest terms, so a block holds examples alike and most blocks lack
    most terms; that only decides how many blocks a query reads, not what it finds.
    """

    def __init__(self, examples: Sparse, terms: int, block: int = BLOCK):
        self.size, self.block = len(examples), block
        self.blocks = -(-self.size // block)
        self.order = self._order(examples)
        own = examples.take(self.order)
        rows = own.rows
        by = np.lexsort((rows, own.terms))
        self.rows, self.weights = rows[by], own.weights[by]
        cell = own.terms[by] * self.blocks + self.rows // block
        self.starts = np.searchsorted(cell, np.arange(terms * self.blocks + 1))
        self.most = np.zeros(terms * self.blocks)
        np.maximum.at(self.most, cell, self.weights)
        self.most = self.most.reshape(terms, self.blocks)

    @staticmethod
    def _order(examples: Sparse) -> np.ndarray:
        """Rows by their heaviest, second and third heaviest term."""
        rows = examples.rows
        by = np.lexsort((examples.terms, -examples.weights, rows))
        ranks = np.arange(len(by)) - examples.bounds[rows[by]]
        keys = np.full((3, len(examples)), -1, np.int64)
        for k in range(3):
            at = ranks == k
            keys[k, rows[by][at]] = examples.terms[by][at]
        return np.lexsort((np.arange(len(examples)), keys[2], keys[1], keys[0]))

    def search(self, queries: Sparse, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the ``k`` nearest examples of each query; row -1 and cosine 0 where there are fewer.

        Nearest first, equal cosines by row; examples that share no term with a query are not found.
        """
        found = [self._search(queries.take(np.arange(a, min(a + _QUERIES_AT_ONCE, len(queries)))), k)
                 for a in range(0, len(queries), _QUERIES_AT_ONCE)]
        if not found:
            return np.zeros((0, k), np.int64), np.zeros((0, k))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _search(self, queries: Sparse, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        best_rows = np.full((n, k), self.size, np.int64)
        best = np.zeros((n, k))
        if not self.size:
            return np.full((n, k), -1, np.int64), best
        # No example of a block scores above the sum of the block's largest weights.
        bounds = np.zeros((n, self.blocks))
        full = np.flatnonzero(np.diff(queries.bounds))
        if len(full):
            parts = queries.weights[:, None] * self.most[queries.terms]
            bounds[full] = np.add.reduceat(parts, queries.bounds[full], axis=0)
        turn = np.argsort(-bounds, axis=1, kind="stable")
        live = np.arange(n)
        for r in range(self.blocks):
            block = turn[live, r]
            # Rounding moves a sum by far less than this; at equality a smaller row may still enter.
            going = (bounds[live, block] > 0) & (bounds[live, block] * (1 + 1e-9) >= best[live, k - 1])
            live, block = live[going], block[going]
            if not len(live):
                break
            scores = self._scores(queries, live, block)
            rows = self.order_of(block)
            seen_rows = np.concatenate([best_rows[live], np.where(scores > 0, rows, self.size)], axis=1)
            seen = np.concatenate([best[live], scores], axis=1)
            top = np.lexsort((seen_rows, -seen), axis=1)[:, :k]
            best[live] = np.take_along_axis(seen, top, axis=1)
            best_rows[live] = np.take_along_axis(seen_rows, top, axis=1)
        return np.where(best_rows < self.size, best_rows, -1), best

    def order_of(self, block: np.ndarray) -> np.ndarray:
        """Original rows of the places of each block; places behind the last example are no row."""
        place = block[:, None] * self.block + np.arange(self.block)
        return np.where(place < self.size, self.order[np.minimum(place, self.size - 1)], self.size)

    def _scores(self, queries: Sparse, live: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Cosines of each query with the examples of its block, from the postings of its terms there."""
        own = queries.take(live)
        query = own.rows
        cell = own.terms * self.blocks + block[query]
        first, sizes = self.starts[cell], self.starts[cell + 1] - self.starts[cell]
        ends = np.cumsum(sizes)
        at = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        place = np.repeat(query, sizes) * self.block + self.rows[at] % self.block
        scores = np.bincount(place, np.repeat(own.weights, sizes) * self.weights[at], len(live) * self.block)
        return scores.reshape(len(live), self.block)
