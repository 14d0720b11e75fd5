"""An inverted index from terms to chunks of records, with prefix pruning.

The index is a table (term, field, chunk); range-partitioned by term it is
pruned by row-group minima and maxima like a lexicon's segments.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions.text import MIN_TERM, index_terms


def postings(records: DataFrame, fields: dict[str, list[str]], chunk: Column) -> DataFrame:
    """(term, field, chunk), distinct; ``fields`` maps a field to the columns it covers."""
    def of_field(number: int, columns: list[str]) -> Column:
        return F.transform(index_terms(*[F.col(c) for c in columns]), lambda t: F.struct(t.alias("term"), F.lit(number).alias("field")))

    arrays = [of_field(i, cols) for i, cols in enumerate(fields.values())]
    return records.select(chunk.alias("chunk"), F.explode(F.concat(*arrays)).alias("p")).select("p.term", "p.field", "chunk").distinct()


def term_ranges(index: DataFrame) -> DataFrame:
    """Per term: chunks, first and last chunk, and a bit mask of its fields."""
    return index.groupBy("term").agg(F.count_distinct("chunk").alias("chunks"), F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"), F.bit_or(F.pow(F.lit(2), F.col("field")).cast("int")).alias("fields"))


def segments(index: DataFrame) -> DataFrame:
    """Zones of the lexicon by the first characters of its terms: terms, first and last."""
    return index.select("term").distinct().groupBy(F.substring("term", 1, MIN_TERM).alias("zone")).agg(F.count("*").alias("terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


def candidates(index: DataFrame, query: list[str], fields: list[int] | None = None) -> DataFrame:
    """Chunks that may hold a record for every query term: union over matched terms, intersection over the query."""
    hit = index if fields is None else index.where(F.col("field").isin(fields))
    flags = [F.max(F.col("term").startswith(q)).alias(f"q{i}") for i, q in enumerate(query)]
    any_ = F.lit(False)
    every = F.lit(True)
    for i, q in enumerate(query):
        any_ = any_ | ((F.col("term") >= q) & F.col("term").startswith(q))
        every = every & F.col(f"q{i}")
    return hit.where(any_).groupBy("chunk").agg(*flags).where(every).select("chunk")


def front_coding(index: DataFrame) -> DataFrame:
    """(term, shared): characters that each term shares with the one before it in its zone."""
    terms = index.select("term").distinct()
    window = Window.partitionBy(F.substring("term", 1, MIN_TERM)).orderBy("term")
    before = terms.withColumn("before", F.lag("term").over(window))
    shorter = F.least(F.length("term"), F.length("before"))
    same = F.size(F.filter(F.sequence(F.lit(1), shorter), lambda i: F.substring(F.col("term"), F.lit(1), i) == F.substring(F.col("before"), F.lit(1), i)))
    return before.select("term", F.when(F.col("before").isNull(), 0).otherwise(same).alias("shared"))


def chunk_deltas(index: DataFrame) -> DataFrame:
    """(term, chunk, delta): the distance to the term's chunk before."""
    pairs = index.select("term", "chunk").distinct()
    return pairs.withColumn("delta", F.col("chunk") - F.coalesce(F.lag("chunk").over(Window.partitionBy("term").orderBy("chunk")), F.lit(0)))


def write_varint(value: int) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, position behind it)."""
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def encode_segment(rows: list[tuple[str, dict[int, list[int]]]], chunks: int) -> str:
    """A segment of sorted terms as base64url: shared prefix, suffix and, per set of
    fields with equal chunks, a mask and the smaller of the chunk list and its complement as deltas."""
    out, before = bytearray(), b""
    for term, by_field in rows:
        raw = term.encode()
        shared = 0
        while shared < min(len(raw), len(before)) and raw[shared] == before[shared]:
            shared += 1
        out += write_varint(shared) + write_varint(len(raw) - shared) + raw[shared:]
        before = raw
        groups: dict[tuple[int, ...], int] = {}
        for field, held in by_field.items():
            groups[tuple(sorted(held))] = groups.get(tuple(sorted(held)), 0) | 1 << field
        out += write_varint(len(groups))
        for held, mask in sorted(groups.items()):
            flip = chunks - len(held) < len(held)
            inside = set(held)
            rest = tuple(c for c in range(chunks) if c not in inside) if flip else ()
            listed = rest if flip else held
            out += write_varint(mask << 1 | flip) + write_varint(len(listed))
            last = 0
            for c in listed:
                out += write_varint(c - last)
                last = c
    return base64.urlsafe_b64encode(bytes(out)).rstrip(b"=").decode()


def decode_segment(data: str, chunks: int) -> list[tuple[str, dict[int, list[int]]]]:
    """The inverse of ``encode_segment``."""
    raw = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
    at, before, out = 0, b"", []
    while at < len(raw):
        shared, at = read_varint(raw, at)
        size, at = read_varint(raw, at)
        before, at = before[:shared] + raw[at : at + size], at + size
        groups, at = read_varint(raw, at)
        fields: dict[int, list[int]] = {}
        for _ in range(groups):
            head, at = read_varint(raw, at)
            count, at = read_varint(raw, at)
            listed, last = [], 0
            for _ in range(count):
                step, at = read_varint(raw, at)
                last += step
                listed.append(last)
            without = set(listed)
            held = [c for c in range(chunks) if c not in without] if head & 1 else listed
            mask = head >> 1
            for f in range(mask.bit_length()):
                if mask >> f & 1:
                    fields[f] = held
        out.append((before.decode(), dict(sorted(fields.items()))))
    return out


def encoded_segments(index: DataFrame, chunks: int) -> DataFrame:
    """(zone, terms, data): every zone of the lexicon as one encoded segment."""
    zone = F.substring("term", 1, MIN_TERM).alias("zone")
    listed = index.groupBy(zone, "term", "field").agg(F.array_sort(F.collect_set("chunk")).alias("held"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, dict[int, list[int]]] = {}
        for r in pdf.sort_values(["term", "field"]).itertuples(index=False):
            rows.setdefault(r.term, {})[int(r.field)] = [int(c) for c in r.held]
        return pd.DataFrame({"zone": [pdf["zone"].iloc[0]], "terms": [len(rows)], "data": [encode_segment(sorted(rows.items()), chunks)]})

    return listed.groupBy("zone").applyInPandas(run, "zone string, terms long, data string")


def decoded_postings(segments: DataFrame, chunks: int) -> DataFrame:
    """(term, field, chunk) of encoded segments (data)."""

    def run(batches):
        for pdf in batches:
            rows = [(term, f, c) for data in pdf["data"] for term, fields in decode_segment(data, chunks) for f, held in fields.items() for c in held]
            yield pd.DataFrame(rows, columns=["term", "field", "chunk"])

    return segments.select("data").mapInPandas(run, "term string, field int, chunk long")
