import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalith.llm.survivors import RELEASE_FIELDS, release_key, shortened, survivors, usable_address, usable_licences, usable_text

SCHEMA = "release_id long, package_id string, release_version string, channel string, summary string, description string, licenses array<string>, homepage string, trust int, fetched_at timestamp"
AT = dt.datetime(2026, 1, 1)


def row(rid, summary=None, description=None, licenses=None, homepage=None, trust=1, at=AT, pid="a:x", version="1.0", channel=None):
    return (rid, pid, version, channel, summary, description, licenses, homepage, trust, at)


def chosen(spark, data, **kw):
    frame = spark.createDataFrame(data, SCHEMA)
    return sorted(map(tuple, survivors(frame, release_key(), "release_id", RELEASE_FIELDS, F.coalesce("trust", F.lit(0)), "fetched_at").collect()))


def test_field_by_field(spark):
    data = [
        row(1, "short text", None, ["tbd", ""], "https://", 9),
        row(2, "short text, whole", "whole words here", ["MIT"], "x.example", 1, version=" V1.0 ", pid=" A:X"),
        row(3, "other", "whole wo…", [None], "https://localhost/", 5, AT + dt.timedelta(1)),
        row(4, "other", "whole words", None, "n/a", 5, None),
    ]
    assert chosen(spark, data) == [(1, "description", 2), (1, "homepage", 2), (1, "licenses", 2), (1, "summary", 3)]


def test_ties_nulls_and_groups(spark):
    assert chosen(spark, [row(1, "a b c"), row(2, "a b c")]) == [(1, "summary", 2)]
    assert chosen(spark, [row(1, "a b c", trust=None, at=None), row(2, "other", trust=None)]) == [(1, "summary", 2)]
    assert chosen(spark, [row(1, "a"), row(2, "b", channel="beta"), row(3, "c", pid="z")]) == []
    assert chosen(spark, [row(1, "a", channel="beta"), row(2, "b", channel="beta")]) == [(1, "summary", 2)]
    assert chosen(spark, []) == [] and chosen(spark, [row(1), row(2)]) == []
    assert chosen(spark, [row(1, "x" * 200_000 + "y", trust=1), row(2, "x" * 200_000, trust=5)]) == [(1, "summary", 1)]
    assert chosen(spark, [row(1, "a", pid=None), row(2, "b", pid=None), row(3, "a", version=None), row(4, "b", version=None)]) == []


@pytest.mark.parametrize("value, expected", [("fine", True), ("", False), ("  ", False), ("​", False), ("TODO", False), ("&nbsp;", False), ("…", False), (None, False), ("Description goes here", False)])
def test_usable_text(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(usable_text(F.col("v")).alias("u")).first()["u"] is expected


@pytest.mark.parametrize("value, expected", [("https://x.example/a", True), ("x.example", True), ("HTTP://X.EXAMPLE", True), ("https://", False), ("#", False), ("about:blank", False), ("https://localhost/", False), ("https://homepage.invalid/", False), ("none", False), (None, False)])
def test_usable_address(spark, value, expected):
    assert spark.createDataFrame([(value,)], "v string").select(usable_address(F.col("v")).alias("u")).first()["u"] is expected


def test_usable_licences(spark):
    frame = spark.createDataFrame([(["MIT"],), (["tbd", None, " "],), ([],), (None,)], "v array<string>")
    assert [r["u"] for r in frame.select(usable_licences(F.col("v")).alias("u")).collect()] == [True, False, False, False]


def test_shortened_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    data = sorted({(rnd.randrange(3), "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9)))) for _ in range(300)})
    frame = spark.createDataFrame(data, "g int, t string").repartition(7)
    got = {(r["g"], r["t"]): r["shortened"] for r in shortened(frame, ["g"], "t").collect()}
    assert got == {(g, t): any(h == g and u != t and u.startswith(t) for h, u in data) for g, t in data}
