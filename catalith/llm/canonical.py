"""Freely typed values mapped to the entries of a canonical list.

The list (a few dozen to some thousand entries, checked before it is broadcast)
becomes a symmetric-delete dictionary of its words.  A value is aligned with whole
list entries word by word within a bounded weighted Damerau-Levenshtein distance,
and the candidates rank by distance and reference frequency (``entries``).  That
serves any list.  For licences, a value that spells no whole entry is cut into the
names that it joins, and what it says about version and choice ("v2+", "two
clause", "or any newer") picks the entry; names and words go through the same
dictionary.  The lookup runs where the rows are: no shuffle, and each task
remembers what it resolved.

Defined cases: null and blank entries and literal ids of the list are no cases;
a value that names none, or leaves the version or a choice open that the list
distinguishes, gives one row with an empty id; an entry that joins two names
gives a row for each that is named; a repeated name counts once; an entry may
be of any length.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm.entries import Entries
from catalith.llm.spelling import Dictionary, weighted_distance
from catalith.util import broadcast_if_small, table

#: Rows a canonical list may have to be broadcast as a dictionary.
LIST_ROWS = 20_000
#: Distinct values that a task remembers.
REMEMBERED = 200_000

# Words around a name that don't change what it names, and words that choose a variant.
FILLERS = "license licence licenses licensed licensing public version pl the of under and or a v clause clauses files all see copying md txt html file any gnu"
SHORT_FILLERS = ("pl", "of", "or")
LATER = "later newer above"
ONLY = "only exactly"
NUMBERS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6"}
SEPARATORS = {"/", "|", "&", ";", ",", "or", "and"}

_WRAP = re.compile(r"\s*(?:\(see [^)]*\)|\[[^\]]*\]|- all files|[;.,])\s*$")
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*|>=|[+=/|&;,]")


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _forms(eid: str, name: str | None, short: str | None, family: str) -> set[str]:
    """Id and name of a licence, also with the short name instead of the family's."""
    plain = {eid, name or eid}
    return plain | {re.sub(re.escape(family), short, f, flags=re.I) for f in plain if short} | {re.sub(re.escape(short), family, f) for f in plain if short}


def _number(text: str) -> tuple[int, ...]:
    parts = [int(x) for x in text.split(".")]
    while len(parts) > 1 and parts[-1] == 0:
        parts.pop()
    return tuple(parts)


class Resolver:
    """Finds the licences that a typed value names."""

    def __init__(self, entries: list[tuple[str, str, str, str]], frequency: dict[str, int]):
        """``entries``: id, full name, short name, family."""
        entries = [e for e in entries if e[3]]
        self.ids = {e[0] for e in entries}
        self.entries = Entries([(eid, form) for eid, name, short, family in entries for form in _forms(eid, name, short, family)], frequency)
        self.names: dict[str, str] = {}
        weight: dict[str, int] = {}
        self.by_family: dict[str, list[tuple[str, tuple[int, ...] | None, str]]] = {}
        for eid, name, short, family in entries:
            fam = family.lower()
            for word in {fam, (short or "").lower()} - {""}:
                self.names[word] = fam
                weight[word] = weight.get(word, 0) + frequency.get(eid, 0) + 1
            words = _tokens(eid)
            number = next((_number(w) for w in words if w[0].isdigit()), None)
            variant = "later" if "later" in words else "only" if "only" in words else ""
            self.by_family.setdefault(fam, []).append((eid, number, variant))
        listed = [w for _, name, _, _ in entries for w in _tokens(name or "")]
        plain = {w: 1 + listed.count(w) for w in f"{FILLERS} {LATER} {ONLY} no".split()} | {w: 1 + listed.count(w) for w in NUMBERS}
        shorts = {w for w in self.names if len(w) <= 4}
        self.dictionary = Dictionary(plain | weight, exact=shorts | {w for w in plain if len(w) <= 2})

    def _words(self, text: str) -> list[tuple[str, str]]:
        """(kind, value) of each token; kind: name, number, word, sign or unknown."""
        raw, out = _tokens(text), []
        for i, t in enumerate(raw):
            following = raw[i + 1] if i + 1 < len(raw) else ""
            if t[0].isdigit():
                out.append(("number", t))
            elif not t[0].isalpha():
                out.append(("sign", t))
            else:
                if len(t) > 1 and t.endswith("v") and following[:1].isdigit() and t not in self.dictionary.words:
                    t = t[:-1]
                hit = self.dictionary.closest(t)
                if hit and hit[0] in self.names:
                    out.append(("name", self.names[hit[0]]))
                elif hit and hit[0] in NUMBERS:
                    out.append(("number", NUMBERS[hit[0]]))
                elif hit:
                    out.append(("word", hit[0]))
                elif len(t) == 1:
                    out.append(("word", t))
                elif len(t) <= 3 and (near := self.dictionary.closest(following)) and near[0] in LATER.split():
                    out.append(("word", "or"))
                elif len(t) <= 3 and (short := min((weighted_distance(t, w), w) for w in SHORT_FILLERS))[0] <= 1:
                    out.append(("word", short[1]))
                else:
                    out.append(("unknown", t))
        return out

    def _one(self, words: list[tuple[str, str]]) -> str:
        """The entry that one name with its version and variant means, or ''."""
        names = {v for k, v in words if k == "name"}
        if len(names) != 1 or any(k == "unknown" for k, _ in words):
            return ""
        numbers = {_number(v) for k, v in words if k == "number"}
        said = [v for k, v in words if k in ("word", "sign")]
        negated = "no" in said
        later = any(w in LATER.split() or w in ("+", ">=") for w in said) and not negated
        only = negated or any(w in ONLY.split() or w == "=" for w in said)
        options = self.by_family[names.pop()]
        if len(numbers) > 1:
            return ""
        if numbers:
            number = numbers.pop()
            same = [o for o in options if o[1] == number]
            if not same and len(number) == 1:
                majors = [o for o in options if o[1] and o[1][0] == number[0]]
                same = majors if len({o[1] for o in majors}) == 1 else []
            options = same
        if len(options) > 1:
            options = [o for o in options if o[2] == ("later" if later else "only")] if later != only else []
        elif options and options[0][2] and (later or only) and options[0][2] != ("later" if later else "only"):
            options = []
        return options[0][0] if len(options) == 1 else ""

    def resolve(self, value: str) -> tuple[str, ...]:
        """Ids that the value names, sorted; ('',) if none is named."""
        text = re.sub(r"\s+", " ", value.replace("\u200b", " ")).strip()
        before = None
        while before != text:
            before, text = text, _WRAP.sub("", text).strip()
        text = re.sub(r"^[a-z]+://\S*/([^/\s]+?)(?:\.[a-z]{2,5})?/?(?=\s|$)", r"\1", text, flags=re.I)
        text = re.sub(r"(?<=\s)[a-z]+://\S*/([^/\s]+?)(?:\.[a-z]{2,5})?/?(?=\s|$)", r"\1", text, flags=re.I)
        text = re.sub(r"\blicenseref[:-]", "", text, flags=re.I)
        whole = self.entries.rank(text)
        if whole:
            return (whole[0][1],)
        words = self._words(text)
        at = [i for i, (k, _) in enumerate(words) if k == "name"]
        if not at:
            return ("",)
        cuts = [0]
        for left, right in zip(at, at[1:], strict=False):
            choices = [i for i in range(left + 1, right) if words[i][1] in SEPARATORS and words[i][0] in ("word", "sign") and not self._variant_follows(words, i, right)]
            if not choices:
                return ("",)
            cuts.append(choices[-1])
        found = {self._one([w for w in words[a:b] if w[1] not in ("/", "|", "&", ";", ",")]) for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True)}
        return tuple(sorted(found - {""})) or ("",)

    @staticmethod
    def _variant_follows(words: list[tuple[str, str]], i: int, end: int) -> bool:
        """Whether 'or' at i starts 'or later', 'or any newer version' and the like."""
        near = [v for _, v in words[i + 1 : min(end, i + 3)]]
        return bool(near) and (near[0] in LATER.split() or near[0] == "any")


class Plain:
    """Finds the entry of a list without a grammar of its own: cities, brands, job titles."""

    def __init__(self, entries: list[tuple[str, ...]], frequency: dict[str, int]):
        """``entries``: id and further names."""
        self.entries = Entries([(e[0], form) for e in entries for form in e if form], frequency)

    def resolve(self, value: str) -> tuple[str, ...]:
        """The id of the best entry; ('',) if the value spells none."""
        return tuple(e for _, e in self.entries.rank(value)[:1]) or ("",)


def _reference(spark: SparkSession, entries: DataFrame, values: DataFrame, value: str) -> tuple[list[tuple], dict[str, int]]:
    """The list on the driver, refused beyond LIST_ROWS, and how often each id occurs literally."""
    rows = entries.limit(LIST_ROWS + 1).collect()
    if len(rows) > LIST_ROWS:
        raise ValueError(f"a canonical list of more than {LIST_ROWS} entries can't be a broadcast dictionary")
    ids = entries.select(F.col(entries.columns[0]).alias("__id")).distinct()
    counts = values.join(broadcast_if_small(ids), F.col(value) == F.col("__id")).groupBy("__id").count().collect()
    return [tuple(r) for r in rows if r[0]], {r["__id"]: r["count"] for r in counts}


def map_to_list(values: DataFrame, keys: list[str], value: str, entries: DataFrame, resolver: type = Resolver, out: str = "license_id") -> DataFrame:
    """(keys, value, out): one row for each list entry a value names, '' for a miss.

    ``entries`` has four columns for licences (id, name, short name, family; rows
    without id or family are left out), and an id and any other names for ``Plain``.
    """
    spark = values.sparkSession
    listed, frequency = _reference(spark, entries, values, value)
    known = spark.sparkContext.broadcast((listed, frequency))
    ids = entries.select(F.col(entries.columns[0]).alias("__id")).where("__id IS NOT NULL").distinct()
    cases = values.where(F.col(value).isNotNull() & (F.regexp_replace(F.col(value), r"[\s\p{Z}\u200b]+", "") != ""))
    cases = cases.join(broadcast_if_small(ids, LIST_ROWS), F.col(value) == F.col("__id"), "left_anti").select(*keys, value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, seen = resolver(*known.value), OrderedDict()
        for pdf in batches:
            codes, unique = pd.factorize(pdf[value])
            found = []
            for v in unique:
                if v not in seen:
                    seen[v] = names.resolve(v)
                    if len(seen) > REMEMBERED:
                        seen.popitem(last=False)
                found.append(list(seen[v]))
            yield pdf.assign(**{out: [found[c] for c in codes]}).explode(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema.fields) + f", `{out}` string"
    return cases.mapInPandas(run, schema)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "package_versions").where("licenses IS NOT NULL")
    return rows.select("release_id", F.posexplode("licenses").alias("entry_pos", "entry"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(release_id, entry_pos, license_id) of every typed licence entry."""
    listed = table(spark, sf_dir, "license_list").select("license_id", "license_name", "short_name", "family")
    return map_to_list(_entries(spark, sf_dir), ["release_id", "entry_pos"], "entry", listed).select("release_id", "entry_pos", "license_id")


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, occurrences) of the entries that name no list entry."""
    listed = table(spark, sf_dir, "license_list").select("license_id", "license_name", "short_name", "family")
    mapped = map_to_list(_entries(spark, sf_dir), ["release_id", "entry_pos"], "entry", listed)
    return mapped.where("license_id = ''").groupBy(F.trim("entry").alias("entry")).agg(F.count("*").alias("occurrences"))
