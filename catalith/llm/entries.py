"""Whole entries of a canonical list, ranked for a freely typed value.

A list entry has one or more forms (its names and ids).  A value is aligned with a
form word by word: words within the bounded weighted Damerau-Levenshtein distance,
found through the symmetric-delete dictionary, numbers exactly.  Every word that
tells entries apart must be there on both sides; which words don't (fillers, as
"license" in a list of licences) is learned from the list itself.  Candidates rank
by their weighted distance, then by how often the reference occurs.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from catalith.llm.spelling import Dictionary

#: Length up to which a word must be spelled exactly.
EXACT = 4
#: What a filler costs that only one side has.
FILLER_COST = 0.01

_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*|[+=><]")


def number(text: str) -> str:
    """A version or count without trailing zeros."""
    return re.sub(r"(?<=\d)(?:\.0+)+$", "", ".".join(str(int(x)) for x in text.split(".")))


def words(text: str) -> list[str]:
    """Lower-case words, numbers and signs of a value."""
    return [number(t) if t[0].isdigit() else t for t in _TOKEN.findall(text.lower())]


def learned_fillers(forms: list[tuple[str, frozenset[str]]]) -> set[str]:
    """Words that go with several names and without which no entry's words lie within another entry's."""
    holders: dict[str, set[int]] = defaultdict(set)
    for i, (_, form) in enumerate(forms):
        for w in form:
            holders[w].add(i)
    spread = Counter({w: len({forms[i][0] for i in h}) for w, h in holders.items() if w[0].isalpha()})
    fillers: set[str] = set()
    for w, n in spread.most_common():
        if n < 2:
            break
        if len({frozenset(x for x in forms[i][1] if x != w and x[0].isalpha()) for i in holders[w]}) < 2:
            continue  # it always stands beside the same words: a name, not a filler
        for i in holders[w]:
            entry, rest = forms[i][0], forms[i][1] - fillers - {w}
            rare = min(rest, key=lambda x: len(holders[x]), default=None)
            if rare is None or any(forms[j][0] != entry and rest <= forms[j][1] for j in holders[rare]):
                break
        else:
            fillers.add(w)
    return fillers


class Entries:
    """A canonical list that ranks its entries for a value."""

    def __init__(self, forms: list[tuple[str, str]], frequency: dict[str, int]):
        """``forms``: (entry, one of its forms); ``frequency``: how often each entry occurs in the reference."""
        cut = sorted({(e, frozenset(words(f))) for e, f in forms if words(f)}, key=lambda x: (x[0], sorted(x[1])))
        self.frequency = frequency
        self.fillers = learned_fillers(cut)
        self.forms = [(e, f - self.fillers, f & self.fillers) for e, f in cut if f - self.fillers]
        self.holders: dict[str, list[int]] = defaultdict(list)
        weight: Counter[str] = Counter()
        for i, (e, form, extra) in enumerate(self.forms):
            for w in form:
                self.holders[w].append(i)
            for w in form | extra:
                if w[0].isalpha():
                    weight[w] += 1 + frequency.get(e, 0)
        self.dictionary = Dictionary(dict(weight), exact={w for w in weight if len(w) <= EXACT})

    def rank(self, value: str) -> list[tuple[float, str]]:
        """(distance, entry) of the entries that the value spells out, best first; each once."""
        said: list[dict[str, float]] = []
        spare = 0
        for t in set(words(value)):
            near = {t: 0.0} if not t[0].isalpha() else dict(self.dictionary.near(t))
            if near and min(near.items(), key=lambda x: x[1])[0] in self.fillers:
                spare += 1
                continue
            if not near:
                return []
            said.append(near)
        if not said:
            return []
        rare = min(said, key=lambda near: sum(len(self.holders.get(w, ())) for w in near))
        best: dict[str, float] = {}
        for i in {i for w in rare for i in self.holders.get(w, ())}:
            entry, form, extra = self.forms[i]
            if len(form) != len(said):
                continue
            left, cost = set(form), FILLER_COST * abs(spare - len(extra))
            for near in sorted(said, key=len):
                fit = min(((d, w) for w, d in near.items() if w in left), default=None)
                if fit is None:
                    break
                cost += fit[0]
                left.discard(fit[1])
            if not left and cost < best.get(entry, float("inf")):
                best[entry] = cost
        return sorted(((d, e) for e, d in best.items()), key=lambda x: (x[0], -self.frequency.get(x[1], 0), x[1]))
