from catalith.llm.truncation import closings, find_truncated, spikes

SENTENCE = "The quick parser reads every wide literal before the cache is moved. "


def docs():
    out, n = [], 0

    def add(text, source, cut):
        nonlocal n
        out.append((n, text, source, cut))
        n += 1

    for i in range(40):
        whole = f"Item {i} says: " + SENTENCE * (3 + i % 5) + f"It ends at {i}."
        add(whole, "free", False)
        add((whole * 3)[: 200] if (whole * 3)[:200][-1] not in ".! " else (whole * 3)[:199] + "x", "limited", True)
        add("é" + (f"Été {i} " + "où ça va bien là " * 30)[:105], "bytes", False if i % 2 else False)
    out[:] = [d for d in out if d[2] != "bytes"]
    for i in range(20):
        add(f"Note {i}.", "limited", False)
        text = f"Où {i} " + "ça là " * 60
        raw = text.encode()[:256].decode(errors="ignore")
        add(raw if len(raw.encode()) == 256 else raw[:-1] + "x" * (256 - len(raw[:-1].encode())), "bytes", True)
    for tail, cut in [
        ("- one item\n- other item", False), ("https://x.example/a", False), ("#tag #other", False), ("```\ncode\n```", False), ("`call(args...)`", False), ("Have fun :)", False), ("-- the crew", False),
        ("(slides follow)", False), ("Nothing changes for new contributors who", True), ("The quick parser rea", True), ("It goes on…", True), ("It goes on [...]", True), ("It goes on...", True), ("The pars&quo", True), ("The pars<a hre", True),
        ("All done.</p>", False), ("Is it so?", False), ("He said “no.”", False),
    ]:
        add(SENTENCE + "\n\n" + tail, "mixed", cut)
    for i in range(8):
        add(f"{SENTENCE}{i}.\n\nHappy building", "mixed", False)
    add(None, "mixed", False)
    add("  \n ", None, False)
    add("Null sources are judg", None, True)
    add(SENTENCE * 4000 + "and then it", "mixed", True)
    return out


def test_found(spark):
    data = docs()
    frame = spark.createDataFrame([(i, t, s, 1) for i, t, s, _ in data], "doc_id long, text string, source string, chars int")
    got = {r["doc_id"] for r in find_truncated(frame).collect()}
    expected = {i for i, _, _, c in data if c}
    assert got == expected, [d[1:] for d in data if (d[0] in got) != (d[0] in expected)][:5]
    assert {(r["source"], r["unit"], r["n"]) for r in spikes(frame, "source", "text").collect()} >= {("limited", "chars", 200), ("bytes", "bytes", 256)}
    assert "happy building" in {r["m"] for r in closings(frame, "text").collect()}
    assert find_truncated(frame.limit(0)).count() == 0


def test_limit_bands(spark):
    """A source that cuts behind words ends in a band of lengths; one that doesn't cut has none."""
    rows = []
    for i in range(120):
        text = " ".join(f"word{'xyzuvw'[(i * k) % 6] * ((i + k) % 7)}" for k in range(80))
        rows.append((i, text[:300].rsplit(" ", 1)[0] if i % 3 else text[: 60 + i], "behind words"))
        rows.append((1000 + i, text[: 150 + (i * 37) % 400] + ".", "free"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = spikes(docs, "source", "text").where("unit = 'chars'").collect()
    assert {r["source"] for r in found} == {"behind words"} and max(r["n"] for r in found) <= 300 and min(r["n"] for r in found) > 280
    reasons = {r["doc_id"]: r["reason"] for r in find_truncated(docs).collect()}
    assert sum(reasons.get(i) in ("limit", "spike") for i in range(120) if i % 3) == 80 and not any(i >= 1000 for i in reasons)
