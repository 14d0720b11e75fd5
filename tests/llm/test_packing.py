import random
from collections import defaultdict
from itertools import combinations

from catalith.llm import packing
from pyspark.sql import functions as F


def test_fill_is_the_best_sum():
    rnd = random.Random(2)
    for _ in range(60):
        items = [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 9))]
        room = rnd.randrange(1, 70)
        counts = defaultdict(int)
        for n in items:
            counts[n] += 1
        taken = packing.fill(room, counts, sorted(counts, reverse=True))
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room)
        assert sum(n * k for n, k in taken.items()) == best and all(k <= counts[n] for n, k in taken.items())
    assert packing.fill(0, {3: 1}, [3]) == {} and packing.fill(5, {}, []) == {}


def test_pack_holds_every_item_once():
    rnd = random.Random(4)
    sizes = [rnd.randrange(0, 101) for _ in range(500)]
    where = packing.pack(sizes, 100)
    used = defaultdict(int)
    for n, c in zip(sizes, where, strict=True):
        used[c] += n
    assert max(used.values()) <= 100 and len(used) <= sum(sizes) / 100 * 1.1 + 1
    assert packing.pack([], 10) == [] and packing.pack([0, 0], 10) == [0, 0]


def test_documents(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 40)
    rnd = random.Random(6)
    data = [(i, "word " * n, "a" if i % 3 else None, None if i % 2 else n, "x") for i, n in enumerate(rnd.randrange(0, 60) for _ in range(300))]
    data += [(1000, "w, " * 60, "a", None, "x"), (1001, None, "b", None, "x"), (1002, "", "b", None, "x")]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string, n_tokens int, capacity string")
    kinds = spark.createDataFrame([("s", 50), ("l", 1000), ("none", 0), (None, 5)], "container_name string, capacity int")
    out = packing.pack_documents(frame, kinds)
    assert {r["container_name"] for r in out.select("container_name").distinct().collect()} == {"s", "l"}
    per = out.groupBy("container_name", "source", "container_id").agg(F.sum("n_tokens").alias("used"), F.min("unused").alias("u"), F.max("unused").alias("v"))
    for r in per.collect():
        cap = {"s": 50, "l": 1000}[r["container_name"]]
        assert r["used"] + r["u"] == cap and r["u"] == r["v"]
    sizes = {d[0]: (len(d[1].split()) if d[0] != 1000 else 120) if d[1] else 0 for d in data}
    total = {(r["container_name"], r["doc_id"]): (r["t"], r["k"], r["p"]) for r in out.groupBy("container_name", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.max("piece_no").alias("p")).collect()}
    for (kind, doc), (t, k, p) in total.items():
        cap = {"s": 50, "l": 1000}[kind]
        assert t == sizes[doc] and k == p + 1 == max(1, -(-sizes[doc] // cap))
    assert len(total) == 2 * len(data)
    assert packing.pack_documents(frame.limit(0), kinds).count() == 0


def test_token_count(spark):
    import re

    texts = ["Hello, world!! a_b c-d 3.14", "Größe naïve 日本語 ¡hola! ²", " \t\n\xa0", "", "…—“x”", "a\x1cb c"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["n"] for r in frame.select(packing.count_tokens(F.col("t")).alias("n")).collect()] == [len(re.findall(r"\w+|[^\w\s]+", t)) for t in texts]
