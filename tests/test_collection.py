import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from catalith.operators import collection
from catalith.operators.termindex import read_varint


def greedy(sizes, surcharge, limit):
    out, used, number = [], None, -1
    for n, x in zip(sizes, surcharge, strict=True):
        if used is None or used + n > limit:
            number, used = number + 1, n + x
        else:
            used += n
        out.append(number)
    return out


@pytest.mark.parametrize("block", [500_000, 7, 1])
def test_next_fit(spark, monkeypatch, block):
    monkeypatch.setattr(collection, "BLOCK", block)
    rnd = random.Random(block)
    sizes = [rnd.choice([1, 3, 9, 20, 60, 150]) for _ in range(80)]
    surcharge = [rnd.randrange(4) for _ in sizes]
    items = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(zip(sizes, surcharge, strict=True))], "position long, size long, surcharge long")
    got = [r["container"] for r in collection.next_fit(items, 100).orderBy("position").collect()]
    assert got == greedy(sizes, surcharge, 100)
    assert collection.next_fit(items.limit(0), 100).count() == 0


def records(spark, n, words=40, skip=(), change=()):
    rows = [(f"r{i:03d}", f"title {i}" + ("!" if i in change else ""), " ".join(f"word{i}x{k}" for k in range(words)), f"2024-01-{i % 28 + 1:02d}") for i in range(n) if i not in skip]
    return spark.createDataFrame(rows, "id string, title string, description string, published string")


def test_append_and_replay(spark):
    log, manifest = collection.update(None, records(spark, 80, 60), chunk_bytes=16_384)
    chunks = collection.chunk_texts(log).orderBy("chunk").collect()
    assert len(chunks) > 2 and all(c["bytes"] <= 16_384 for c in chunks) and [c["sealed"] for c in chunks] == [True] * (len(chunks) - 1) + [False]
    assert all(len(json.loads(c["text"])["operations"]) == c["operations"] for c in chunks) and manifest == {"version": 8, "epoch": 1, "revision": 1}
    again, same = collection.update(log, records(spark, 80, 60), manifest, chunk_bytes=16_384)
    assert same == manifest and again.count() == 80
    after, newer = collection.update(log, records(spark, 81, 60, skip={5}, change={7}), manifest, chunk_bytes=16_384)
    ops = [json.loads(r["operation"]) for r in after.where("position >= 80").orderBy("position").collect()]
    assert newer["revision"] == 2 and sorted(o["id"] for o in ops) == ["r005", "r007", "r080"] and ops[-1] == {"id": "r005", "_deleted": True}
    state = {r["id"]: json.loads(r["operation"])["title"] for r in collection.current(after).collect()}
    assert len(state) == 80 and "r005" not in state and state["r007"] == "title 7!"
    kept = {r["revision"] for r in collection.chunk_texts(after).where("sealed").collect()}
    assert {c["revision"] for c in chunks if c["sealed"]} <= kept  # only the last chunk was opened again
    whole = after.orderBy("position").collect()
    assert [r["chunk"] for r in whole] == greedy([len(r["operation"].encode()) + 1 for r in whole], [0] * len(whole), 16_384 - 17)
    compacted, fresh = collection.update(after, records(spark, 10), newer, compact=True)
    assert fresh == {"version": 8, "epoch": 2, "revision": 1} and compacted.count() == 10
    with pytest.raises(ValueError, match="at least"):
        collection.append(None, log.drop("chunk"), 100)
    with pytest.raises(ValueError, match="not unique"):
        collection.normalised(records(spark, 2).union(records(spark, 1)))
    with pytest.raises(Exception, match="no id"):
        collection.normalised(records(spark, 1).withColumn("id", F.lit(""))).collect()


def decoded(text):
    data = json.loads(text)["data"]
    raw = base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
    at, term, out = 0, b"", []
    while at < len(raw):
        shared, at = read_varint(raw, at)
        size, at = read_varint(raw, at)
        term, at = term[:shared] + raw[at : at + size], at + size
        n, at = read_varint(raw, at)
        out.append((term.decode(), raw[at : at + n]))
        at += n
    return out


def test_routes(spark):
    rnd = random.Random(2)
    index = [(f"cterm{i:04d}", rnd.randrange(3), rnd.randrange(50)) for i in range(2500)] + [(w, 0, c) for w in ("ab", "über", "zz") for c in range(50)]
    frame = spark.createDataFrame(index, "term string, field int, chunk long").distinct()
    out = collection.routes(frame, 50).orderBy("route").collect()
    terms = [t for r in out for t, _ in decoded(r["text"])]
    assert terms == sorted({t for t, _, _ in index}, key=lambda t: t.encode()) and len(out) > 3
    assert all(len(r["text"].encode()) <= 8192 for r in out) and [r["first"] for r in out] == [decoded(r["text"])[0][0] for r in out]
    assert dict(p for r in out for p in decoded(r["text"]))["ab"] == bytes([3, 0])  # all chunks: an empty complement


def test_bundles_and_reading(spark):
    payloads = spark.createDataFrame([(i, f"route-{i:05d}", json.dumps({"data": "x" * (i % 7 * 40)}) + "\n") for i in range(40)], "position long, id string, text string")
    placed = collection.bundles(payloads, 1024)
    files = placed.select("file", "text").distinct()
    assert all(len(r["text"].encode()) <= 1024 for r in files.collect()) and 3 < files.count() < 20
    read = {r["id"]: json.loads(r["payload"]) for r in collection.logical_payloads(placed.select("id", "file"), files).collect()}
    assert read["route-00006"] == {"data": "x" * 240} and len(read) == 40
    with pytest.raises(Exception, match="no payload"):
        collection.logical_payloads(placed.select("id", "file"), files.limit(1)).collect()


def test_what_to_load(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "id string, revision string")
    chunks, held = make(("a", "1"), ("b", "2")), make(("a", "1"), ("b", "1"), ("c", "1"))
    actions = lambda *a, **k: {r["id"]: r["action"] for r in collection.to_load(chunks, held, *a, **k).collect()}
    assert actions(1, 1) == {"a": "keep", "b": "load", "c": "delete"} and actions(2, 1) == {"a": "load", "b": "load", "c": "delete"}
    with pytest.raises(ValueError, match="unknown chunk"):
        actions(1, 1, required=make(("x", "1")))
    order = spark.createDataFrame([("a", 0, "2024"), ("b", 1, ""), ("c", 2, "2025")], "id string, chunk int, max_published string")
    assert [r["id"] for r in collection.visiting_order(order).orderBy("place").collect()] == ["c", "a", "b"]
    assert [r["id"] for r in collection.visiting_order(order.withColumn("max_published", F.lit(""))).orderBy("place").collect()] == ["a", "b", "c"]
    keys = spark.createDataFrame([(2, "y"), (1, "x")], "bucket int, revision string")
    assert collection.change_key(keys).first()["key"] == "1:x|2:y"
