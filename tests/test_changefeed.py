import random

from catalith.operators.changefeed import apply_changes
from catalith.streaming.feeds import apply_stream, compact_changes, latest_counts, read_state, read_stream

SCHEMA = "op_id long, c string, id string, revision long, _deleted boolean, a string, b string"


def brute(ops):
    """Column-wise last writer wins, one operation after another in order of revision."""
    first = {}
    for op in sorted(ops):
        if op[1] is not None and op[2] is not None and op[3] is not None:
            first.setdefault(op[1:4], op)
    state = {}
    for op in sorted(first.values(), key=lambda o: o[3]):
        key = op[1:3]
        if op[4]:
            state.pop(key, None)
        else:
            old = state.get(key, (None, None, None))
            state[key] = (op[3], op[5] if op[5] is not None else old[1], op[6] if op[6] is not None else old[2])
    return sorted((*k, *v) for k, v in state.items())


def made(seed, n=400):
    rnd = random.Random(seed)
    ops, used = [], set()
    for i in range(n):
        key = ("x" if rnd.random() < 0.7 else "y", f"r{rnd.randrange(25)}")
        gone = rnd.random() < 0.2
        revision = rnd.randrange(200)
        if (key, revision) in used:  # a revision is repeated with equal content only
            continue
        used.add((key, revision))
        ops.append((i, *key, revision, True if gone else rnd.choice([False, None]), None if gone or rnd.random() < 0.3 else f"a{i}", None if gone else f"b{i}"))
    ops += [(n + i, *op[1:]) for i, op in enumerate(ops[:40])] + [(9999, None, "r1", 3, False, "q", "q"), (9998, "x", "r1", None, False, "q", "q")]
    rnd.shuffle(ops)
    return ops


def test_brute_force(spark, rows):
    for seed in range(3):
        ops = made(seed)
        out = apply_changes(spark.createDataFrame(ops, SCHEMA), ["c", "id"], ["a", "b"])
        assert rows(out.select("c", "id", "revision", "a", "b")) == sorted(brute(ops), key=repr)


def test_edges(spark, rows):
    make = lambda ops: spark.createDataFrame(ops, SCHEMA)
    assert apply_changes(make([]), ["c", "id"], ["a"]).count() == 0
    assert rows(apply_changes(make([(1, "x", "i", 5, True, None, None), (2, "x", "i", 4, False, "late", None)]), ["c", "id"], ["a"])) == []
    assert rows(apply_changes(make([(1, "x", "i", 5, True, None, None), (2, "x", "i", 6, None, "new", None)]), ["c", "id"], ["a", "b"])) == [("x", "i", 6, "new", None)]
    assert rows(apply_changes(make([(2, "x", "i", 5, False, "second", None), (1, "x", "i", 5, False, "first", None)]), ["c", "id"], ["a"])) == [("x", "i", 5, "first")]
    extra = make([(1, "x", "i", 5, False, "v" * 100_000, None)]).selectExpr("*", "1 AS __deleted_at")
    assert apply_changes(extra, ["c", "id"], ["a"]).count() == 1


def test_stream_gives_the_batch_result(spark, rows, tmp_path):
    ops = made(7)
    frame = spark.createDataFrame(ops, SCHEMA)
    for i in range(3):
        frame.where(f"op_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_stream(spark, str(tmp_path / "in"), frame.schema, files=1)
    apply_stream(spark, stream, str(tmp_path / "state"), str(tmp_path / "cp"), ["c", "id"], ["a", "b"]).awaitTermination()
    out = read_state(spark, str(tmp_path / "state"), ["c", "id"], ["a", "b"])
    assert rows(out.select("c", "id", "revision", "a", "b")) == sorted(brute(ops), key=repr)
    small = compact_changes(frame.where("c IS NOT NULL AND revision IS NOT NULL"), ["c", "id"], ["a", "b"])
    assert rows(apply_changes(small, ["c", "id"], ["a", "b"])) == rows(apply_changes(frame, ["c", "id"], ["a", "b"]))


def test_windowed_counts(spark, tmp_path):
    events = spark.createDataFrame([("2026-01-01 00:10:00", "a"), ("2026-01-01 00:20:00", "a"), ("2026-01-01 03:00:00", "b")], "ts string, k string").selectExpr("cast(ts AS timestamp) AS ts", "k")
    events.write.parquet(str(tmp_path / "in"))
    out = latest_counts(read_stream(spark, str(tmp_path / "in"), events.schema), "ts", "k")
    q = out.writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["k"], r["rows"]) for r in spark.sql("SELECT k, rows FROM counts").collect()] == [("a", 2)]
