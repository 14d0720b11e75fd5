import json

import pytest
from pyspark.sql import functions as F

from catalith.operators import publish
from catalith.sources import datasets, web

PAGE = "<html><head><title>Blog — About C++</title><meta name='keywords' content='a, b, a'><link rel='icon' href='/i.png'></head><body><header><img src='/x.png'></header><img class='site-logo' src='img/l.png'><p class='tagline'>Fast &amp; <b>small</b></p></body></html>"


def test_pages(spark):
    rows = web.pages(spark.createDataFrame([("s", "https://x.org/a/", PAGE), ("t", "https://y.org", "<title>T | second</title><link rel='icon' href='/i.png'>"), ("u", "https://z.org", "")], "source string, url string, document string")).orderBy("source").collect()
    assert [tuple(r) for r in rows] == [("s", "https://x.org/a/", "Fast & small", ["a", "b"], "https://x.org/a/img/l.png"), ("t", "https://y.org", "second", [], "https://y.org/i.png"), ("u", "https://z.org", "", [], "")]


def test_channels(spark):
    meta = {"description": " d ", "keywords": 'c++ "two words"', "vanityChannelUrl": "https://v.org/@x/", "avatar": {"thumbnails": [{"url": "s", "width": 100}, {"url": "l", "width": 800}]}}
    rows = web.channels(spark.createDataFrame([("a", 'x {"channelMetadataRenderer": ' + json.dumps(meta) + ', "rest": 1}'), ("b", "nothing")], "source string, document string")).collect()
    assert [tuple(r) for r in rows] == [("a", "https://v.org/@x/", "d", ["c++", "two words"], "l", "https://v.org/@x/about")]


def test_communities_and_books(spark):
    invite = json.dumps({"guild": {"id": "9", "description": " d ", "icon": "i"}, "approximate_member_count": 5})
    docs = [("d", "discord", "u", invite), ("s", "stackoverflow", "u", json.dumps({"items": [{"excerpt": "e"}]})), ("w", "web", "https://x.org/", "<meta property='og:description' content='o'><meta property='og:image' content='/b.png'>")]
    rows = {r["source"]: tuple(r)[1:] for r in web.communities(spark.createDataFrame(docs, "source string, kind string, url string, document string")).collect()}
    assert rows == {"d": ("d", "https://cdn.discordapp.com/icons/9/i.png?size=512", "", 5), "s": ("e", "", "", None), "w": ("o", "", "https://x.org/b.png", None)}
    page = '<shreddit-subreddit-header subreddit-id="t5_x" description="a &amp;amp; b" weekly-active-users="9" icon-url=""><i style="url(https://styles.redditmedia.com/t5_y/styles/communityIcon_0.png)"><i style="url(https://styles.redditmedia.com/t5_x/styles/communityIcon_1.png?a&amp;b);">'
    forum = spark.createDataFrame([("r", "reddit", "u", page)], "source string, kind string, url string, document string")
    assert [tuple(r) for r in web.communities(forum).collect()] == [("r", "a &amp; b", "https://styles.redditmedia.com/t5_x/styles/communityIcon_1.png?a&b", "", None)]
    assert web.forums(forum).first()["weekly_visitors"] == "9"
    with pytest.raises(Exception, match="no community in page"):
        web.forums(forum.withColumn("document", F.lit("<p>"))).collect()
    with pytest.raises(Exception, match="unknown community"):
        web.communities(spark.createDataFrame([("x", "other", "u", "")], "source string, kind string, url string, document string")).collect()
    edition = json.dumps({"title": "Big Book: small words", "authors": [{"name": "A"}], "subjects": [], "identifiers": {}, "publishers": [{"name": "P"}, {"name": "Q"}]})
    work = json.dumps({"docs": [{"key": "k", "author_name": ["A", "B"], "subject": ["C++", "c++"], "ratings_average": 4.56789, "ratings_count": 3}]})
    make = lambda d: spark.createDataFrame([("9780306406157", d), ("0", "{")], "isbn string, document string")
    (row,) = [r for r in web.books(make(edition), make(work)).collect() if r["title"]]
    assert (row["title"], row["subtitle"], row["authors"], row["isbn_10"], row["publisher"], row["subjects"], row["rating"]) == ("Big Book", "small words", ["A", "B"], "0306406152", "P, Q", ["C++"], 4.568)


def test_publish(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert publish.update(spark, one, path, check=True) and publish.versions(spark, path) == []
    assert publish.update(spark, one, path) and not publish.update(spark, one.orderBy(F.desc("k")), path)
    assert publish.update(spark, one.union(one), path) and publish.current(spark, path).count() == 4
    assert publish.update(spark, one.limit(0), path) and publish.versions(spark, path) == [2, 3]
    used = spark.createDataFrame([("u1", 0), ("u2", 1), ("u1", 2)], "url string, position int")
    first = publish.provenance(None, used, "c")
    again = publish.provenance(first, used.where("url = 'u1'").unionByName(spark.createDataFrame([("u3", 9)], "url string, position int")), "c")
    assert [r["url"] for r in again.orderBy("position").collect()] == ["u1", "u2", "u3"]


def test_corrections(spark):
    packages = spark.createDataFrame([("a", "old", ["x"]), ("b", "kept", None)], "id string, homepage string, licenses array<string>")
    steps = [("a", 0, "homepage", "replace", "new"), ("a", 1, "licenses", "add", "y"), ("a", 2, "licenses", "add", "x"), ("b", 3, "homepage", "remove", None), ("zz", 4, "homepage", "replace", "?")]
    out = publish.correct(packages, spark.createDataFrame(steps, "package string, position int, field string, operation string, value string"), "id", ["homepage"], ["licenses"])
    assert sorted(map(tuple, out.collect())) == [("a", "new", ["x", "y"]), ("b", None, None)]


def test_datasets(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("items:\n- {id: a, hidden: false}\n- {id: b, hidden: true}\n")
    schema = "id string, hidden boolean"
    rows = datasets.read_yaml(spark, str(tmp_path / "a.yaml"), schema, "items")
    assert datasets.read_yaml(spark, str(tmp_path / "none.yaml"), schema).count() == 0
    assert [r["id"] for r in datasets.union_unique([rows, rows.limit(0)], "id").collect()] == ["a"]
    with pytest.raises(ValueError, match="not unique"):
        datasets.union_unique([rows, rows], "id")
    (tmp_path / "s.toml").write_text("[catalith]\nthreshold = 0.9\noutput = 'out'\n")
    assert datasets.load_settings(str(tmp_path / "s.toml")).output == str(tmp_path / "out")
    (tmp_path / "bad.toml").write_text("[catalith]\nnope = 1\n")
    with pytest.raises(ValueError, match="unknown settings"):
        datasets.load_settings(str(tmp_path / "bad.toml"))
