"""Symmetric-delete lookups of bounded, weighted Damerau-Levenshtein distance.

Every word of a vocabulary is filed under all strings that up to ``edits``
deletions leave; a query looks up its own deletions, so only words within the
bound are ever compared.  Candidates rank by weighted distance, then by how
often the reference occurs, then by spelling.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations


def allowed_edits(length: int) -> int:
    """Edits that a word of this length may carry: short words must be exact."""
    return 0 if length < 3 else 1 if length < 8 else 2


def deletions(word: str, edits: int) -> set[str]:
    """All strings that at most ``edits`` deletions leave of ``word``."""
    out = set()
    for n in range(min(edits, len(word)) + 1):
        for drop in combinations(range(len(word)), n):
            out.add("".join(ch for i, ch in enumerate(word) if i not in drop))
    return out


def weighted_distance(a: str, b: str) -> float:
    """Restricted Damerau-Levenshtein: a swap or a doubled letter costs 0.6, a
    first letter that differs 1.2, any other edit 1."""
    rows: list[list[float]] = [[float(j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            first = 1.2 if i == 1 and j == 1 else 1.0
            delete = 0.6 if i > 1 and a[i - 2] == x else 1.0
            insert = 0.6 if j > 1 and b[j - 2] == y else 1.0
            best = min(rows[i - 1][j] + delete, row[j - 1] + insert, rows[i - 1][j - 1] + (0.0 if x == y else first))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[i - 2][j - 2] + 0.6)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


class Dictionary:
    """A vocabulary that finds the closest words within the allowed edits."""

    def __init__(self, words: dict[str, int], exact: set[str] = frozenset()):
        """``words`` maps each word to its reference frequency; those in ``exact`` allow no edit."""
        self.words = dict(words)
        self.index: dict[str, set[str]] = defaultdict(set)
        for word in self.words:
            for form in deletions(word, 0 if word in exact else allowed_edits(len(word))):
                self.index[form].add(word)
        self.exact = exact
        self.longest = max(map(len, self.words), default=0)

    def near(self, query: str) -> list[tuple[str, float]]:
        """All words within the bound with their weighted distance, best first."""
        if len(query) > self.longest + 2:  # no word is within two edits
            return []
        found = set()
        for form in deletions(query, allowed_edits(len(query) + 1)):
            found |= self.index.get(form, set())
        open_ = found - self.exact | ({query} & self.words.keys())
        ranked = sorted((d, -self.words[w], w) for w in open_ if (d := weighted_distance(query, w)) <= allowed_edits(max(len(w), len(query))))
        return [(w, d) for d, _, w in ranked]

    def closest(self, query: str) -> tuple[str, float] | None:
        """The best word and its weighted distance, or None."""
        return (query, 0.0) if query in self.words else next(iter(self.near(query)), None)
