import random

from catalith.llm import leakage

RND = random.Random(9)
WORDS = ["".join(RND.choice("abcdefghijklmnop") for _ in range(RND.randrange(3, 9))) for _ in range(400)]


def passage(n=80, seed=0):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


ITEMS = [(i, ("Answer the following question in one short line. " if i % 2 else "") + passage(seed=i)) for i in range(12)]


def noise(n, seed):
    rnd = random.Random(1000 + seed)
    return " ".join("".join(rnd.choice("qrstuvwxyz") for _ in range(6)) for _ in range(n))


def cut(i, a, b):
    return " ".join(leakage._FIRST.sub("", ITEMS[i][1], count=1).split()[a:b] if i % 2 else ITEMS[i][1].split()[a:b])


def altered(text, every):
    return " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(text.split()))


def docs():
    whole = cut(3, 0, 80)
    quarter = cut(4, 10, 28)
    return [
        (1, noise(50, 1) + "\n\n" + whole + "\n\n" + noise(50, 2), {3}),
        (2, noise(30, 3) + " " + whole.upper().replace(" ", "\n> "), {3}),
        (3, "<p>" + altered(whole, 10).replace(" ", "&nbsp;", 3) + "</p>", {3}),
        (4, noise(200, 4) + cut(5, 20, 50), {5}),
        (5, cut(6, 0, 20) + "\n\n" + noise(30, 5) + "\n\n" + cut(6, 20, 40), {6}),
        (6, noise(100, 6) + " " + quarter, set()),
        (7, "Answer the following question in one short line. " + noise(60, 7), set()),
        (8, "", set()), (9, None, set()), (10, noise(3000, 8) + cut(7, 5, 60) + noise(3000, 9) + cut(8, 0, 70), {7, 8}),
        (11, noise(50, 1) + "\n\n" + whole + "\n\n" + noise(50, 2), {3}), (12, "short", set()),
    ]


def test_found(spark):
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in docs()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, (90, None), (91, ""), (92, "tiny")], "item_id long, passage string")
    got: dict[int, set] = {}
    for r in leakage.find_leaks(frame, "doc_id", "text", items, "item_id", "passage").collect():
        got.setdefault(r["doc_id"], set()).add(r["item_id"])
    assert got == {i: s for i, _, s in docs() if s}
    assert leakage.find_leaks(frame, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0
    assert leakage.find_leaks(frame.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0


def test_blocks_and_steps_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 1500)
    monkeypatch.setattr(leakage, "STEP", 500)
    monkeypatch.setattr(leakage, "EXPANDED", 40)
    test_found(spark)


def test_edits():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(4)
    text = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 9)))
    for _ in range(3000):
        a, b, k = text(), text(), rnd.randrange(0, 9)
        assert leakage.edits_within(a, b, k) == (full(a, b) if full(a, b) <= k else None)
    assert leakage.longest_chain([(0, 9, 0, 50), (10, 19, 300, 350), (25, 30, 10, 20)]) == 20 and leakage.longest_chain([]) == 0


def typos(text, rate, seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice("xyz") if c != " " and rnd.random() < rate else c for c in text)


def test_recall_and_precision():
    """Altered passages are found up to an edit in twenty characters, three tenths are, and less isn't."""
    items = [(i, leakage.fold(passage(seed=500 + i))) for i in range(60)]
    index = leakage.Index(items)

    def recall(change):
        docs = [noise(40, i) + " " + change(p, i) + " " + noise(40, 90 + i) for i, (_, p) in enumerate(items)]
        return sum((i, i) in {r[:2] for r in leakage.scan(index, list(range(60)), docs)} for i in range(60)) / 60

    assert recall(lambda p, i: p) == 1.0
    assert recall(lambda p, i: altered(p, 10)) == 1.0 and recall(lambda p, i: altered(p, 5)) == 1.0
    assert recall(lambda p, i: typos(p, 0.03, i)) == 1.0 and recall(lambda p, i: typos(p, 0.05, i)) >= 0.95
    assert recall(lambda p, i: " ".join(p.split()[i % 50 : i % 50 + 24])) == 1.0  # exactly three tenths
    assert recall(lambda p, i: " ".join(p.split()[i % 50 : i % 50 + 22])) == 0.0


def test_long_text_against_brute_force():
    """Every window of a long text that holds enough of a passage word by word is found, and no other text is."""
    items = [(i, leakage.fold(passage(60, seed=700 + i))) for i in range(8)]
    index = leakage.Index(items)
    rnd = random.Random(5)
    for n in range(40):
        k, size = rnd.randrange(8), rnd.randrange(10, 30)
        at = rnd.randrange(0, 60 - size)
        text = noise(400, n) + " " + " ".join(items[k][1].split()[at : at + size]) + " " + noise(400, n + 1)
        assert {r[1] for r in leakage.scan(index, [0], [text])} == ({k} if size >= 18 else set())


def test_quotations_in_many_or_distant_parts(spark):
    long = passage(200, seed=77)
    words = long.split()
    parts = " ".join(noise(30, 20 + k) + " " + " ".join(words[8 * k : 8 * k + 8]) for k in range(8))
    distant = " ".join(words[:40]) + " " + noise(600, 40) + " " + " ".join(words[40:80])
    little = " ".join(words[:40]) + " " + noise(600, 41)
    frame = spark.createDataFrame([(1, parts), (2, distant), (3, little)], "doc_id long, text string")
    items = spark.createDataFrame([(5, long)], "item_id long, passage string")
    got = leakage.find_leaks(frame, "doc_id", "text", items, "item_id", "passage").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 5), (2, 5)}
