"""A generative label model over patterns of votes.

Every matching function votes 1 (same), -1 (different) or 0 (no opinion) on a
candidate.  The model knows candidates only as patterns of votes with counts, so
its size depends on the functions and not on the data.  Expectation-maximisation
learns, without labels, how each function votes on matches and on non-matches.
Functions whose votes still depend on each other given the class are joined into
one factor that votes with the whole combination, so agreeing twins count once.
A function without opinion neither speaks for nor against: it is summed out.
Patterns of pairs that are known to differ, such as any two records drawn from all,
may be given beside the candidates: they show how votes on non-matches look, even
if hardly any candidate is one.
"""

from __future__ import annotations

import numpy as np

#: Rounds of expectation-maximisation, and pseudo-votes that keep probabilities off 0 and 1; those of a joined factor.
ROUNDS, PRIOR, JOINED = 60, 0.5, 10.0
#: Residual correlation from which two functions are joined, and functions a factor may have.
CORRELATED, FACTOR = 0.25, 3
#: First guess: weight of a vote.
FIRST_GUESS = 1.5


class LabelModel:
    """Fitted by ``fit``; ``posterior`` gives P(same) of each pattern."""

    def __init__(self, functions: int):
        self.factors = [[j] for j in range(functions)]

    def fit(self, patterns: np.ndarray, counts: np.ndarray, apart: tuple[np.ndarray, np.ndarray] | None = None) -> LabelModel:
        """``patterns``: (n, functions) of -1, 0, 1; ``counts``: rows that show each; ``apart``: the same of known non-matches."""
        self.open = np.arange(len(patterns) + (0 if apart is None else len(apart[0]))) < len(patterns)
        if apart is not None:
            patterns, counts = np.concatenate((patterns, apart[0])), np.concatenate((counts, apart[1]))
        self._em(patterns, counts, np.where(self.open, 1 / (1 + np.exp(-FIRST_GUESS * patterns.sum(axis=1))), 0.0))
        while (pair := self._dependent(patterns, counts)) is not None:
            a, b = pair
            self.factors[a] += self.factors.pop(b)
            self._em(patterns, counts, self.fitted)
        return self

    def _cells(self, patterns: np.ndarray, factor: list[int]) -> np.ndarray:
        out = np.zeros(len(patterns), dtype=np.int64)
        for j in factor:
            out = out * 3 + patterns[:, j].astype(np.int64) + 1
        return out

    def _tables(self, patterns: np.ndarray, counts: np.ndarray, post: np.ndarray) -> None:
        self.prior = float(np.clip((post * counts).sum() / max(counts.sum(), 1), 1e-3, 1 - 1e-3))
        self.tables = []
        for factor in self.factors:
            cells, size = self._cells(patterns, factor), 3 ** len(factor)
            yes, no = (self._smoothed(np.bincount(cells, weights=counts * w, minlength=size), len(factor)) for w in (post, 1 - post))
            self.tables.append(self._ratios(yes / yes.sum(), no / no.sum(), len(factor)))

    @staticmethod
    def _smoothed(votes: np.ndarray, width: int) -> np.ndarray:
        """Votes on each combination and pseudo-votes; those of a joined factor lie as if its functions were independent."""
        if width == 1:
            return votes + PRIOR / votes.size
        cube, alike = votes.reshape((3,) * width), np.ones((3,) * width)
        for j in range(width):
            alone = cube.sum(axis=tuple(k for k in range(width) if k != j)) + PRIOR / 3
            alike = alike * (alone / alone.sum()).reshape([3 if k == j else 1 for k in range(width)])
        return votes + JOINED * alike.ravel()

    @staticmethod
    def _ratios(yes: np.ndarray, no: np.ndarray, width: int) -> np.ndarray:
        """Log likelihood ratio of each combination, with abstaining functions summed out."""
        yes, no = yes.reshape((3,) * width), no.reshape((3,) * width)
        out = np.zeros((3,) * width)
        for cell in np.ndindex(*out.shape):
            seen = tuple(slice(None) if v == 1 else v for v in cell)
            if any(v != 1 for v in cell):
                out[cell] = np.log(yes[seen].sum()) - np.log(no[seen].sum())
        return out.ravel()

    def _em(self, patterns: np.ndarray, counts: np.ndarray, post: np.ndarray) -> None:
        for _ in range(ROUNDS):
            self._tables(patterns, counts, post)
            new = np.where(self.open, self.posterior(patterns), 0.0)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        self.fitted = post

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        score = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for factor, table in zip(self.factors, self.tables, strict=True):
            score += table[self._cells(patterns, factor)]
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))

    def _dependent(self, patterns: np.ndarray, counts: np.ndarray) -> tuple[int, int] | None:
        """The two factors whose votes are most correlated within the classes, if they are."""
        best, pair = CORRELATED, None
        for a in range(len(self.factors)):
            for b in range(a + 1, len(self.factors)):
                if len(self.factors[a]) + len(self.factors[b]) > FACTOR:
                    continue
                r = max(self._within(patterns, counts, i, j) for i in self.factors[a] for j in self.factors[b])
                if r > best:
                    best, pair = r, (a, b)
        return pair

    def _within(self, patterns: np.ndarray, counts: np.ndarray, i: int, j: int) -> float:
        total = 0.0
        for post in (self.fitted, 1 - self.fitted):
            w = counts * post
            if w.sum() < 1:
                continue
            x, y = (patterns[:, k] - np.average(patterns[:, k], weights=w) for k in (i, j))
            spread = np.sqrt(np.average(x * x, weights=w) * np.average(y * y, weights=w))
            if spread > 1e-9:
                total += w.sum() / counts.sum() * abs(np.average(x * y, weights=w) / spread)
        return total
