"""Items of varying length packed into containers of fixed capacity.

Minimum bin slack: a container takes the largest item that remains, then the
multiset of remaining lengths that fills its room best.  A bitset subset-sum
table (one big integer per length, counts by binary splitting) finds the fullest
sum; it is extended over the remaining lengths window by window until a window
fills the room exactly or the lengths are used up, and the counts are read back
from its layers.

Only ids and sizes move.  Each source is cut into blocks of about
``BLOCK_ITEMS`` items by a hash of the id, so a source of any size is spread
over tasks; the containers that blocks leave open (more than ``OPEN_SHARE``
unused) are emptied and packed again together in a second pass.

Defined cases: a document longer than the capacity is split into full pieces and
a rest, and no other is split; an empty or null text has size 0 and joins a
container without using room; null sources form a source of their own; equal
sizes go by id; a missing token count is taken from the text; sources without
documents give no containers; capacities that are null or below 1 are left out.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.util import Scratch, broadcast_if_small, table

#: Items that one task packs, about.
BLOCK_ITEMS = 20_000
#: Distinct lengths added to the subset-sum table at a time.
WINDOW = 48
#: Unused share from which a container of the first pass is packed again.
OPEN_SHARE = 0.002
#: Capacities that one call may hold (they are listed on the driver).
CAPACITIES = 1_000

TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]"


def count_tokens(text: Column) -> Column:
    """Matches of the public pattern for words and punctuation; a mark counts by itself.

    Unicode letters, numbers and the underscore are word characters; each run of
    other characters that aren't blank is one token, as in ``[^\\w\\s]+``.
    """
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN + "+"), 0))


def fill(room: int, counts: dict[int, int], order: list[int]) -> dict[int, int]:
    """How many of each length to take so that their sum comes closest to ``room``.

    ``order`` lists the lengths with a positive count, longest first.
    """
    if room <= 0 or not order:
        return {}
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    usable = [n for n in order if n <= room]
    for start in range(0, len(usable), WINDOW):
        for length in usable[start : start + WINDOW]:
            layers.append((length, reach))
            left, step = min(counts[length], room // length), 1
            while left > 0:
                take = min(step, left)
                reach |= (reach << (take * length)) & mask
                left -= take
                step *= 2
            if reach >> room:
                break
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        k = 0
        while not (before >> total) & 1:
            k, total = k + 1, total - length
        if k:
            taken[length] = k
    return taken


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container number of each item; every size is at most the capacity."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(sizes):
        by_length[n].append(i)
    weightless = by_length.pop(0, [])
    counts = {n: len(v) for n, v in by_length.items()}
    order, where, number = sorted(counts, reverse=True), [0] * len(sizes), 0
    while order:
        seed = order[0]
        counts[seed] -= 1
        where[by_length[seed].pop()] = number
        if not counts[seed]:
            order.pop(0)
        for length, k in fill(capacity - seed, counts, order).items():
            counts[length] -= k
            for _ in range(k):
                where[by_length[length].pop()] = number
            if not counts[length]:
                order.remove(length)
        number += 1
    for i in weightless:
        where[i] = 0
    return where


def _pack_groups(items: DataFrame, stage: str) -> DataFrame:
    """Packs each (container_name, source, block); the number is unique with its block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"], ascending=False, kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iloc[0])
        pdf["number"] = pack(pdf["n_tokens"].tolist(), capacity)
        used = pdf.groupby("number")["n_tokens"].transform("sum")
        pdf["unused"] = (capacity - used).astype("int64")
        return pdf

    schema = items.schema.simpleString()[7:-1] + ",number:bigint,unused:bigint"
    out = items.groupBy("container_name", "source", "block").applyInPandas(run, schema.replace(":", " ").replace(",", ", "))
    return out.withColumn("stage", F.lit(stage))


def _blocks(items: DataFrame, by: list[str]) -> DataFrame:
    sizes = items.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(BLOCK_ITEMS))).cast("int").alias("__blocks")).select(*[F.col(c).alias(f"__{c}") for c in by], "__blocks")
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    joined = items.join(broadcast_if_small(sizes), match).drop(*[f"__{c}" for c in by])
    return joined.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("__blocks")).cast("int")).drop("__blocks")


def _no_containers(docs: DataFrame) -> DataFrame:
    """No containers at all."""
    return docs.sparkSession.createDataFrame([], "container_name string, source string, container_id string, doc_id long, piece_no int, start_token long, n_tokens long, unused long")


def pack_documents(docs: DataFrame, containers: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """The container of every document or piece, for each source and capacity.

    Columns: container_name, source, container_id, doc_id, piece_no,
    start_token, n_tokens, unused (room left in that container).
    """
    scratch = Scratch(docs.sparkSession, "packing")
    listed = containers.where("capacity >= 1 AND container_name IS NOT NULL").limit(CAPACITIES + 1).collect()
    if len(listed) > CAPACITIES:
        raise ValueError(f"more than {CAPACITIES} capacities")
    size = F.coalesce(F.col(n_tokens).cast("long"), count_tokens(F.col(text)).cast("long"))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    sized = scratch.keep(sized, "sized")
    if not listed:
        return _no_containers(docs)
    kinds = F.array(*[F.struct(F.lit(c["container_name"]).alias("container_name"), F.lit(int(c["capacity"])).cast("long").alias("capacity")) for c in listed])
    wide = sized.select("doc_id", "source", "size", F.explode(kinds).alias("k")).select("doc_id", "source", "size", "k.*")
    pieces = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("size") / F.col("capacity")) - 1))
    cut = wide.select("container_name", "capacity", "source", "doc_id", "size", F.explode(pieces.cast("array<int>")).alias("piece_no"))
    start = F.col("piece_no").cast("long") * F.col("capacity")
    cut = cut.select("container_name", "capacity", "source", "doc_id", "piece_no", start.alias("start_token"), F.least("capacity", F.col("size") - start).alias("n_tokens"))
    first = scratch.keep(_pack_groups(_blocks(cut, ["container_name", "source"]), "a"), "first")
    is_open = F.col("unused") > F.col("capacity") * OPEN_SHARE
    again = _pack_groups(_blocks(first.where(is_open).drop("block", "number", "unused", "stage"), ["container_name", "source"]), "b")
    done = first.where(~is_open).unionByName(again)
    name = F.concat_ws("/", "container_name", F.coalesce("source", F.lit("∅")), F.concat(F.col("stage"), F.col("block"), F.lit("-"), F.col("number")))
    return done.select("container_name", "source", name.alias("container_id"), "doc_id", "piece_no", "start_token", "n_tokens", "unused")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_tokens")
    return pack_documents(docs, table(spark, sf_dir, "containers"))


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container_name, source, documents, tokens, overfull, mixed): what the containers of each source hold.

    Every document and token must be there once, no container over its capacity, and
    none with documents of two sources.
    """
    packed = p7_packed(spark, sf_dir)
    capacity = table(spark, sf_dir, "containers").where("container_name IS NOT NULL").select("container_name", F.col("capacity").cast("long").alias("capacity"))
    each = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("used"), F.min("source").alias("source"), F.count_distinct("source").alias("sources"))
    each = each.join(broadcast_if_small(capacity), "container_name").groupBy("container_name", "source").agg(F.sum((F.col("used") > F.col("capacity")).cast("long")).alias("overfull"), F.sum((F.col("sources") > 1).cast("long")).alias("mixed"))
    held = packed.groupBy("container_name", F.col("source").alias("__s")).agg(F.count_distinct("doc_id").alias("documents"), F.sum("n_tokens").alias("tokens"))
    both = held.join(each.withColumnRenamed("container_name", "__c"), (F.col("container_name") == F.col("__c")) & F.col("__s").eqNullSafe(F.col("source")))
    return both.select("container_name", "source", "documents", "tokens", "overfull", "mixed")
