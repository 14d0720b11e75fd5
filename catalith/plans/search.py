"""Record search: every query term must begin some term in some selected field."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.text import index_terms, query_terms, squeeze
from catalith.operators import termindex

#: Results that a search returns at most, unless the request says otherwise.
RESULTS = 1_000


@dataclass
class SearchRequest:
    """What to look for; an empty query browses."""

    query: str = ""
    fields: list[str] = field(default_factory=list)
    after: str | None = None
    before: str | None = None
    relevance: float | None = None
    values: dict[str, list[str]] = field(default_factory=dict)
    limit: int | None = RESULTS

    def __post_init__(self) -> None:
        if self.after and self.before and self.after > self.before:
            self.before = self.after


def parse_query(text: str, key: str, known: list[str]) -> tuple[str, list[str]]:
    """The free text of a query, and the known values of its ``key:value`` tokens."""
    found = [v for v in re.findall(rf"(?:^|\s){re.escape(key)}:(\S+)", text) if v.lower() in known]
    rest = re.sub(rf"(?:^|\s){re.escape(key)}:(\S+)", lambda m: "" if m.group(1).lower() in known else m.group(0), text)
    return " ".join(rest.split()), list(dict.fromkeys(v.lower() for v in found))


def prefix_match(fields: dict[str, list[str]], request: SearchRequest) -> Column:
    """Whether a record answers all terms of the query in the selected fields."""
    chosen = request.fields or list(fields)
    terms = index_terms(*[F.col(c) for f in chosen for c in fields[f]])
    words = query_terms(request.query)
    return reduce(lambda a, q: a & F.exists(terms, lambda t: t.startswith(q)), words, F.lit(True))


def substring_match(columns: list[str], query: str) -> Column:
    """Whether the joined columns contain every word of the query."""
    text = squeeze(F.concat_ws(" ", *columns))
    return reduce(lambda a, q: a & text.contains(q), query.lower().split(), F.lit(True))


def filtered(records: DataFrame, request: SearchRequest, time: str, relevance: str | None = None) -> DataFrame:
    """Date window (the last day counts in full), relevance and value filters; all reach the scan."""
    if request.after:
        records = records.where(F.col(time) >= F.lit(request.after).cast("timestamp"))
    if request.before:
        records = records.where(F.col(time) < F.date_add(F.lit(request.before).cast("date"), 1).cast("timestamp"))
    if request.relevance is not None and relevance:
        records = records.where(F.col(relevance).isNull() | (F.col(relevance) >= request.relevance))
    for column, allowed in request.values.items():
        records = records.where(F.col(column).isin(allowed))
    return records


def search(records: DataFrame, fields: dict[str, list[str]], request: SearchRequest, key: str, time: str, relevance: str | None = None) -> DataFrame:
    """Matching records, newest first."""
    found = filtered(records, request, time, relevance).where(prefix_match(fields, request))
    ordered = found.orderBy(F.col(time).desc_nulls_last(), key)
    return ordered if request.limit is None else ordered.limit(request.limit)


def search_indexed(records: DataFrame, index: DataFrame, fields: dict[str, list[str]], request: SearchRequest, key: str, time: str, chunk: Column) -> DataFrame:
    """The same result through the term index: only chunks that can match are searched."""
    numbers = [i for i, f in enumerate(fields) if not request.fields or f in request.fields]
    words = query_terms(request.query)
    if not words:
        return search(records, fields, request, key, time)
    chunks = termindex.candidates(index, words, numbers)
    pruned = records.withColumn("__chunk", chunk).join(chunks, F.col("__chunk") == F.col("chunk"), "left_semi").drop("__chunk")
    return search(pruned, fields, request, key, time)
