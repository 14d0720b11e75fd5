"""A published collection: chunks of operations, bundles, a routing lexicon and what a reader must load.

Containers are filled greedily in order: as many items as fit, at least one.  That
is sequential, but each block of ``BLOCK`` items can tell beforehand how it would
leave the container that it finds open, for every place at which that one may end;
the driver follows these answers block by block (it holds one at a time), and the
blocks then number their items in parallel.  Only positions and sizes take part.

Defined cases: an item larger than the limit has a container of its own; empty
tables have none; a record without id or an id that comes twice is an error.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions.ids import digest
from catalith.functions.text import MIN_TERM
from catalith.operators import changelog, merge
from catalith.operators import publish as published
from catalith.operators.termindex import read_varint, write_varint
from catalith.util import Scratch

# Format, bytes of a data chunk and its least, of a route segment and of a bundle.
FORMAT, CHUNK_BYTES, LEAST_CHUNK_BYTES, ROUTE_BYTES, BUNDLE_BYTES = 8, 131_072, 16_384, 8_192, 32_768
#: Items whose sizes one task looks at.
BLOCK = 500_000

_OPEN, _CLOSE = '{"operations":[', "]}\n"


def normalised(records: DataFrame, key: str = "id") -> DataFrame:
    """Records with a text id and without their search text; a missing or repeated id is an error."""
    named = F.col(key).cast("string")
    rows = records.drop("search").withColumn(key, F.when(F.coalesce(named, F.lit("")) != "", named).otherwise(F.raise_error("a record has no id").cast("string")))
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return rows


def json_line(value: Column) -> Column:
    """Compact JSON without null fields, and a line feed."""
    return F.concat(F.to_json(value), F.lit("\n"))


def _followed(sizes: np.ndarray, surcharge: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(upto, next start, size left open, containers begun) if a container begins at each item."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    n = len(sizes)
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + limit - surcharge, side="right") - 1, np.arange(n) + 1)
    left, begun = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        if ends[i] >= n:
            left[i] = upto[n] - upto[i] + surcharge[i]
        else:
            left[i], begun[i] = left[ends[i]], begun[ends[i]] + 1
    return upto, ends, left, begun


def next_fit(items: DataFrame, limit: int, first: int = 0) -> DataFrame:
    """(position, container) of items (position, size, surcharge); positions are 0, 1, 2 ...

    A container holds at most ``limit``; its first item counts ``surcharge`` more.
    Numbers begin at ``first``.
    """
    blocks = items.select("position", "size", "surcharge", F.floor(F.col("position") / BLOCK).alias("block"))
    columns = ["position", "size", "surcharge"]

    def answers(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        upto, _, left, begun = _followed(pdf["size"].to_numpy(np.int64), pdf["surcharge"].to_numpy(np.int64), limit)
        near = int(np.searchsorted(upto[:-1], limit, side="right"))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "total": [int(upto[-1])], "upto": [upto[:near].tolist()], "left": [left[:near].tolist()], "begun": [begun[:near].tolist()]})

    told = blocks.groupBy("block").applyInPandas(answers, "block long, total long, upto array<long>, left array<long>, begun array<long>")
    used, number, entries = None, first - 1, []
    for row in told.orderBy("block").toLocalIterator():
        entries.append((row["block"], -1 if used is None else used, number))
        if used is not None and used + row["total"] <= limit:
            used += row["total"]
            continue
        # the open container ends before the first item that doesn't fit
        at = 0 if used is None else max(0, int(np.searchsorted(row["upto"], limit - used, side="right")) - 1)
        used, number = row["left"][at], number + row["begun"][at]
    if not entries:
        return items.select("position", F.lit(0).alias("container")).limit(0)
    known = items.sparkSession.createDataFrame(entries, "block long, used long, number long")

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        sizes, surcharge = pdf["size"].to_numpy(np.int64), pdf["surcharge"].to_numpy(np.int64)
        upto, ends, _, _ = _followed(sizes, surcharge, limit)
        used, number, n = int(pdf["used"].iloc[0]), int(pdf["number"].iloc[0]), len(pdf)
        at = 0 if used < 0 else max(0, int(np.searchsorted(upto, limit - used, side="right")) - 1)
        out = np.full(n, number, dtype=np.int64)
        while at < n:
            number += 1
            out[at : ends[at]] = number
            at = int(ends[at])
        return pd.DataFrame({"position": pdf["position"].to_numpy(), "container": out.astype(np.int32)})

    return blocks.select(*columns, "block").join(F.broadcast(known), "block").groupBy("block").applyInPandas(numbered, "position long, container int")


def append(before: DataFrame | None, pending: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The log (position, chunk, operation as JSON text, published) with pending operations (same without chunk).

    The last chunk is opened again and filled with what follows; the others stay as
    they are.  Positions of ``pending`` follow those of the log.
    """
    if chunk_bytes < LEAST_CHUNK_BYTES:
        raise ValueError(f"a chunk takes at least {LEAST_CHUNK_BYTES} bytes")
    columns = ["position", "operation", "published"]
    if before is None:
        sealed, open_, first, start = None, pending.select(*columns), 0, 0
    else:
        last = before.agg(F.max("chunk").alias("chunk"), F.count("*").alias("n")).first()
        if last["chunk"] is None or pending.isEmpty():
            return before if pending.isEmpty() else append(None, pending, chunk_bytes)
        first = last["chunk"]
        sealed = before.where(F.col("chunk") < first)
        reopened = before.where(F.col("chunk") == first).select(*columns)
        start = last["n"] - reopened.count()
        open_ = reopened.unionByName(pending.select(*columns))
    frame = len(_OPEN) + len(_CLOSE) - 1  # as many commas as operations, less one
    sized = open_.select((F.col("position") - start).alias("position"), (F.octet_length("operation") + 1).cast("long").alias("size"), F.lit(0).cast("long").alias("surcharge"))
    placed = next_fit(sized, chunk_bytes - frame, first).select((F.col("position") + start).alias("position"), F.col("container").alias("chunk"))
    done = open_.join(placed, "position").select("position", "chunk", "operation", "published")
    return done if sealed is None else sealed.select("position", "chunk", "operation", "published").unionByName(done)


def chunk_texts(log: DataFrame) -> DataFrame:
    """Per chunk its descriptor and text: id, revision, file, bytes, operations, start, times of publication, sealed.

    A chunk is bounded by its limit, so its text fits a row.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "operation"))), lambda x: x["operation"]), ",")
    chunks = log.groupBy("chunk").agg(
        F.concat(F.lit(_OPEN), joined, F.lit(_CLOSE)).alias("text"), F.count("*").alias("operations"), F.min("position").alias("start"),
        F.coalesce(F.min("published"), F.lit("")).alias("min_published"), F.coalesce(F.max("published"), F.lit("")).alias("max_published"))
    last = log.agg(F.max("chunk").alias("__last"))
    named = chunks.crossJoin(F.broadcast(last)).withColumn("revision", digest(F.col("text")))  # one row
    return named.select(
        F.format_string("data-%05d", "chunk").alias("id"), "chunk", "revision", F.concat(F.lit("chunk-"), "revision", F.lit(".json")).alias("file"), F.octet_length("text").alias("bytes"),
        "operations", "start", "min_published", "max_published", (F.col("chunk") < F.col("__last")).alias("sealed"), "text")


def visiting_order(chunks: DataFrame) -> DataFrame:
    """(id, place): the order in which a reader visits chunks, the latest publication first; in log order if none is known."""
    dated = F.max(F.when(F.col("max_published") != "", 1)).over(Window.partitionBy())
    rows = chunks.select("id", "chunk", "max_published").withColumn("dated", dated)  # one row a chunk
    newest = Window.orderBy(F.when(F.col("dated") == 1, F.col("max_published")).desc_nulls_last(), F.when(F.col("dated") == 1, -F.col("chunk")).otherwise(F.col("chunk")))
    return rows.select("id", (F.row_number().over(newest) - 1).alias("place"))


def bundles(payloads: DataFrame, target: int = BUNDLE_BYTES) -> DataFrame:
    """(id, bundle, file): payloads (position, id, text) put into files of at most ``target`` bytes."""
    frame = len(f'{{"version":{FORMAT},"chunks":{{}}}}\n') - 1
    entry = F.concat(F.lit('"'), "id", F.lit('":'), F.rtrim(F.regexp_replace("text", r"\n$", "")))
    sized = payloads.select("position", F.octet_length(entry).cast("long").alias("n"))
    placed = next_fit(sized.select("position", (F.col("n") + 1).alias("size"), F.lit(0).cast("long").alias("surcharge")), target - frame)
    rows = payloads.select("position", "id", entry.alias("entry")).join(placed, "position")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"]), ",")
    files = rows.groupBy("container").agg(F.concat(F.lit(f'{{"version":{FORMAT},"chunks":{{'), joined, F.lit("}}\n")).alias("text"))
    named = files.select("container", "text", F.concat(F.lit("payload-"), digest(F.col("text"), 24), F.lit(".json")).alias("file"))
    return rows.join(named, "container").select("id", F.col("container").alias("bundle"), "file", "text")


def logical_payloads(descriptors: DataFrame, files: DataFrame) -> DataFrame:
    """(id, payload): what descriptors (id, file) name in files (file, text): a whole file, or an entry of its ``chunks``.

    A file that is missing, or that lacks the id, is an error.
    """
    held = descriptors.join(files.select(F.col("file").alias("__file"), "text"), F.col("file") == F.col("__file"), "left")
    bundled = F.get_json_object("text", "$.chunks").isNotNull()
    entry = F.try_element_at(F.from_json(F.get_json_object("text", "$.chunks"), "map<string,string>"), F.col("id"))
    found = F.when(bundled, entry).otherwise(F.regexp_replace("text", r"\n$", ""))
    missing = F.raise_error(F.concat(F.lit("no payload of "), "id", F.lit(" in "), "file")).cast("string")
    return held.select("id", F.when(found.isNotNull(), found).otherwise(missing).alias("payload"))


def posting_bytes(by_field: dict[int, list[int]], chunks: int) -> bytes:
    """The chunks of a term: per distinct list a mask of its fields, and the smaller of list and complement as steps."""
    masks: dict[tuple[bool, tuple[int, ...]], int] = {}
    for field, held in by_field.items():
        flip = chunks - len(held) < len(held)
        inside = set(held)
        listed = tuple(c for c in range(chunks) if c not in inside) if flip else tuple(sorted(held))
        masks[flip, listed] = masks.get((flip, listed), 0) | 1 << field
    out = bytearray()
    for (flip, listed), mask in sorted(masks.items()):
        out += write_varint(mask << 1 | flip)
        for before, c in zip((-1, *listed), listed, strict=False):
            out += write_varint(c - before if before >= 0 else c + 1)
            # a step of 0 ends the list, so the first is counted from 1 and later ones are at least 1
        out.append(0)
    return bytes(out)


def routes(index: DataFrame, chunks: int, target: int = ROUTE_BYTES) -> DataFrame:
    """(route, id, first, last, terms, revision, text): the lexicon in segments of at most ``target`` bytes.

    Terms of one zone (their first characters) are halved until a part fits, and
    neighbouring parts are put together again while they fit.  The sizes follow
    from each term's own bytes and the characters that it shares with the one
    before, so the lexicon itself never meets in one task.
    """
    scratch = Scratch(index.sparkSession, "routes")
    room = (target - len('{"data":""}\n')) * 3 // 4  # base64

    def coded(batches):
        for pdf in batches:
            blobs = [posting_bytes({int(f): [int(c) for c in held] for f, held in zip(fs, hs, strict=True)}, chunks) for fs, hs in zip(pdf["fields"], pdf["held"], strict=True)]
            yield pd.DataFrame({"term": pdf["term"], "blob": blobs})

    lists = index.groupBy("term", "field").agg(F.array_sort(F.collect_set("chunk")).alias("held")).groupBy("term").agg(F.collect_list("field").alias("fields"), F.collect_list("held").alias("held"))
    terms = scratch.keep(lists.mapInPandas(coded, "term string, blob binary"), "terms")
    placed = changelog.positions(terms, ["term"]).drop("offset")
    before = placed.select((F.col("position") + 1).alias("position"), F.col("term").alias("before"))

    def sized(batches):
        varint = lambda n: max(1, (int(n).bit_length() + 6) // 7)
        for pdf in batches:
            full, less = [], []
            for term, last, blob in zip(pdf["term"], pdf["before"], pdf["blob"], strict=True):
                raw, old = term.encode(), (last or "").encode()
                shared = next((i for i, (a, b) in enumerate(zip(raw, old, strict=False)) if a != b), min(len(raw), len(old)))
                tail = varint(len(blob)) + len(blob)
                full.append(1 + varint(len(raw)) + len(raw) + tail)
                less.append(varint(shared) + varint(len(raw) - shared) + len(raw) - shared + tail)
            yield pd.DataFrame({"position": pdf["position"], "term": pdf["term"], "blob": pdf["blob"], "full": full, "size": less})

    schema = "position long, term string, blob binary, full long, size long"
    rows = scratch.keep(placed.join(before, "position", "left").mapInPandas(sized, schema), "sized")

    def halved(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        upto, extra = np.concatenate(([0], np.cumsum(pdf["size"].to_numpy(np.int64)))), (pdf["full"] - pdf["size"]).to_numpy(np.int64)
        begins, todo = [], [(0, len(pdf))]
        while todo:
            a, b = todo.pop()
            if upto[b] - upto[a] + extra[a] <= room or b - a == 1:
                begins.append(a)
            else:
                todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        begins = np.array(sorted(begins))
        ends = np.append(begins[1:], len(pdf))
        at = pdf["position"].to_numpy()
        return pd.DataFrame({"start": at[begins], "terms": ends - begins, "size": upto[ends] - upto[begins], "surcharge": extra[begins]})

    zones = rows.select("position", "size", "full", F.substring("term", 1, MIN_TERM).alias("zone"))
    parts = zones.groupBy("zone").applyInPandas(halved, "start long, terms long, size long, surcharge long")
    parts = scratch.keep(changelog.positions(parts, ["start"]).drop("offset"), "parts")
    joined = next_fit(parts.select("position", "size", "surcharge"), room)
    segments = parts.join(joined, "position").select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("terms") - 1)).alias("position"), F.col("container").alias("route"))

    def written(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        out, old = bytearray(), b""
        for term, blob in zip(pdf["term"], pdf["blob"], strict=True):
            raw = term.encode()
            shared = next((i for i, (a, b) in enumerate(zip(raw, old, strict=False)) if a != b), min(len(raw), len(old)))
            out += write_varint(shared) + write_varint(len(raw) - shared) + raw[shared:] + write_varint(len(blob)) + blob
            old = raw
        data = base64.urlsafe_b64encode(bytes(out)).decode().rstrip("=")
        return pd.DataFrame({"route": [pdf["route"].iloc[0]], "first": [pdf["term"].iloc[0]], "last": [pdf["term"].iloc[-1]], "terms": [len(pdf)], "text": [f'{{"data":"{data}"}}\n']})

    done = rows.join(segments, "position").groupBy("route").applyInPandas(written, "route int, first string, last string, terms long, text string")
    return done.select("route", F.format_string("route-%05d", "route").alias("id"), "first", "last", "terms", digest(F.col("text"), 24).alias("revision"), "text")


def next_manifest(before: dict | None, changed: bool, compact: bool) -> dict:
    """Version, epoch and revision after an update: compaction opens an epoch and begins the log anew, any change is a revision."""
    old = before if before and before.get("version") == FORMAT else {}
    epoch = old.get("epoch", 1) + (1 if compact and old.get("epoch") else 0)
    revision = 0 if compact else old.get("revision", 0)
    return {"version": FORMAT, "epoch": epoch, "revision": revision + bool(changed)}


def update(before: DataFrame | None, records: DataFrame, manifest: dict | None = None, key: str = "id", compact: bool = False, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, dict]:
    """(log, manifest) after ``records`` have become the collection's state.

    ``before`` is the log so far (position, chunk, operation, published); changed
    records follow by publication and id, deletions by id.  A compacted log holds
    the records alone.
    """
    desired = normalised(records, key)
    published = F.coalesce(F.col("published").cast("string"), F.lit("")) if "published" in desired.columns else F.lit("")
    wanted = desired.select(F.col(key).alias("id"), F.to_json(F.struct(*desired.columns)).alias("operation"), published.alias("published"))
    old = None if compact else before
    if old is None:
        up = wanted.withColumn("gone", F.lit(False))
    else:
        state = current(old)
        gone = merge.deleted(state, wanted, "id")
        up = wanted.join(state.select(F.col("id").alias("__id"), F.col("operation").alias("__op")), F.col("id") == F.col("__id"), "left").where(~F.col("operation").eqNullSafe(F.col("__op"))).drop("__id", "__op")
        down = gone.select("id", F.to_json(F.struct(F.col("id"), F.lit(True).alias("_deleted"))).alias("operation"), F.lit(None).cast("string").alias("published"), F.lit(True).alias("gone"))
        up = up.withColumn("gone", F.lit(False)).unionByName(down)
    pending = changelog.positions(up.withColumn("published_first", F.coalesce("published", F.lit(""))), ["gone", "published_first", "id"])
    start = 0 if old is None else old.count()
    pending = pending.select((F.col("position") + start).alias("position"), "operation", F.nullif("published", F.lit("")).alias("published"))
    changed = not pending.isEmpty()
    return append(old, pending, chunk_bytes), next_manifest(manifest, changed, compact)


def current(log: DataFrame) -> DataFrame:
    """(id, operation, chunk): the collection's records, and the chunk that holds each."""
    read = log.select(F.get_json_object("operation", "$.id").alias("id"), "position", "chunk", "operation", F.coalesce(F.get_json_object("operation", "$._deleted") == "true", F.lit(False)).alias("_deleted"))
    return changelog.replay(read, "id").select("id", "operation", "chunk")


def to_load(chunks: DataFrame, held: DataFrame, epoch: int, held_epoch: int | None, required: DataFrame | None = None) -> DataFrame:
    """(id, action): what a reader does before it shows a revision: load, keep or delete chunks.

    ``chunks`` and ``held`` have id and revision.  Another epoch invalidates all that
    is held; a chunk is loaded if its revision differs; all ``required`` chunks must
    be listed.
    """
    if required is not None:
        unknown = required.select("id").join(chunks.select("id"), "id", "left_anti").first()
        if unknown is not None:
            raise ValueError(f"unknown chunk: {unknown['id']}")
        chunks = chunks.join(required.select("id").distinct(), "id", "left_semi")
    mine = held.select(F.col("id").alias("__id"), F.col("revision").alias("__revision"))
    stale = F.lit(held_epoch is not None and held_epoch != epoch)
    both = chunks.select("id", "revision").join(mine, F.col("id") == F.col("__id"), "full")
    action = F.when(F.col("id").isNull(), "delete").when(~stale & F.col("revision").eqNullSafe(F.col("__revision")), "keep").otherwise("load")
    return both.select(F.coalesce("id", "__id").alias("id"), action.alias("action"))


def change_key(descriptors: DataFrame, number: str = "bucket") -> DataFrame:
    """(key): numbers and revisions of all buckets in one text, which differs if any bucket does."""
    return descriptors.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, "revision"))), lambda b: F.concat(b[number].cast("string"), F.lit(":"), b["revision"])), "|").alias("key"))


def overlapping(segments: DataFrame, prefix: str) -> DataFrame:
    """Segments (first, last) that may hold a term with the prefix."""
    return segments.where((F.col("last") >= prefix) & ((F.col("first") <= prefix) | F.col("first").startswith(prefix)))


def obsolete(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file): files of the last publication that the new one lacks."""
    return before.select("file").join(after.select("file"), "file", "left_anti")


def publish(spark: SparkSession, path: str, log: DataFrame, manifest: dict) -> bool:
    """Writes a collection (log and manifest) as a new version if it differs; whether it did."""
    rows = log.select("position", "chunk", "operation", "published").withColumns({f"m_{k}": F.lit(v) for k, v in manifest.items()})
    return published.update(spark, rows, path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict | None]:
    """(log, manifest) of a published collection; nothing if there is none or it has another format."""
    rows = published.current(spark, path)
    head = rows.select("m_version", "m_epoch", "m_revision").first() if rows is not None else None
    if head is None or head["m_version"] != FORMAT:
        return None, None
    return rows.drop("m_version", "m_epoch", "m_revision"), {k: head[f"m_{k}"] for k in ("version", "epoch", "revision")}


def terms_of(segments: DataFrame) -> DataFrame:
    """(term): the terms of routing segments (text)."""

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                data = json.loads(text)["data"]
                raw, at, term = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)), 0, b""
                while at < len(raw):
                    shared, at = read_varint(raw, at)
                    size, at = read_varint(raw, at)
                    term, at = term[:shared] + raw[at : at + size], at + size
                    n, at = read_varint(raw, at)
                    at += n
                    out.append(term.decode())
            yield pd.DataFrame({"term": out}, dtype=object)

    return segments.select("text").mapInPandas(run, "term string")
