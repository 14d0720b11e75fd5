import random

import pytest
from pyspark.sql import functions as F

from catalith.llm import groups


def brute(links, never):
    """Links in order, one after another."""
    parent, members = {}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    foes = [{a, b} for a, b in never if a != b]
    for _, a, b in sorted((-(w if w is not None else -1.0), min(a, b), max(a, b)) for a, b, w in links if a and b and a != b):
        x, y = find(a), find(b)
        if x == y:
            continue
        both = members.setdefault(x, {x}), members.setdefault(y, {y})
        if any(len(f & both[0]) == 1 and len(f & both[1]) == 1 for f in foes):
            continue
        parent[y] = x
        members[x] |= members.pop(y)
    return sorted((m, min(g)) for g in members.values() if len(g) > 1 for m in g)


def run(spark, links, never):
    frame = spark.createDataFrame(links, "a string, b string, w double")
    rules = spark.createDataFrame(never, "left_id string, right_id string") if never is not None else None
    return sorted(map(tuple, groups.consolidate(frame, "a", "b", [-F.coalesce("w", F.lit(-1.0))], rules).collect()))


def made(seed, shape):
    rnd = random.Random(seed)
    if shape == "path":
        links = [(f"v{i:03d}", f"v{i + 1:03d}", rnd.random()) for i in range(120)]
    elif shape == "cycle":
        links = [(f"v{i:02d}", f"v{(i + 1) % 40:02d}", round(rnd.random(), 1)) for i in range(40)]
    elif shape == "star":
        links = [("hub", f"v{i:02d}", rnd.random()) for i in range(60)]
    elif shape == "dense":  # two components whose ids are mostly in forbidden pairs
        links = [(f"{c}{rnd.randrange(9)}", f"{c}{rnd.randrange(9)}", round(rnd.random(), 2)) for c in "ab" for _ in range(30)]
        return links, [(f"{c}{i}", f"{c}{j}") for c in "ab" for i, j in ((0, 1), (2, 3), (4, 5), (6, 7), (8, 0))] + [("a1", "b1")]
    else:
        links = [(f"v{rnd.randrange(50):02d}", f"v{rnd.randrange(50):02d}", round(rnd.random(), 1)) for _ in range(70)]
    names = sorted({x for a, b, _ in links for x in (a, b)})
    never = [(rnd.choice(names), rnd.choice(names)) for _ in range(6)] + [("absent", names[0])]
    return links, never


@pytest.mark.parametrize("shape, bound, most", [("path", 500_000, 0), ("cycle", 500_000, 0), ("star", 500_000, 0), ("random", 500_000, 0), ("random", 3, 5_000_000), ("random", 3, 3), ("dense", 3, 5_000_000), ("dense", 3, 3)])
def test_against_brute_force(spark, monkeypatch, shape, bound, most):
    monkeypatch.setattr(groups, "REPLAY_LINKS", bound)
    monkeypatch.setattr(groups, "COMPONENT_LINKS", most)
    links, never = made(11, shape)
    assert run(spark, links, never) == brute(links, never)


def test_hub(spark):
    """A vertex with most links, among forbidden pairs and not."""
    rnd = random.Random(3)
    links = [("hub", f"v{i:03d}", round(rnd.random(), 2)) for i in range(150)] + [(f"v{rnd.randrange(150):03d}", f"v{rnd.randrange(150):03d}", round(rnd.random(), 2)) for _ in range(60)]
    for never in ([], [("hub", "v007"), ("v001", "v002"), ("v003", "v009")]):
        assert run(spark, links, never) == brute(links, never)


def test_numbers_need_no_names(spark):
    links = spark.createDataFrame([(5, 9), (9, 7), (7, 5), (1, 2), (3, 3)], "a long, b long")
    assert sorted(map(tuple, groups.consolidate(links, "a", "b", []).collect())) == [(1, 1), (2, 1), (5, 5), (7, 5), (9, 5)]


def test_edges(spark):
    assert run(spark, [], []) == []
    assert run(spark, [("a", "a", 1.0), (None, "b", 1.0), ("", "c", 1.0)], []) == []
    assert run(spark, [("a", "b", None), ("b", "a", 1.0), ("a", "b", 1.0)], None) == [("a", "a"), ("b", "a")]
    assert run(spark, [("a", "b", 0.5), ("b", "c", 0.9)], [("a", "c")]) == [("b", "b"), ("c", "b")]
    assert run(spark, [("a", "b", 0.5), ("b", "c", 0.5)], [("c", "a"), ("c", "a"), ("b", "b")]) == [("a", "a"), ("b", "a")]
