import datetime

import pytest
from pyspark.sql import functions as F

from catalith.functions import names, presentation
from catalith.operators import calendar, collection, jobs, kvstore, publish, resolve, summaries
from catalith.sources import datasets, instances, registries

PACKAGE = "package_id string, registry string, summary string, description string, licenses array<string>, homepage string, repository_url string, documentation_url string, topics array<string>"


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("v")).first()["v"]


def test_summaries(spark):
    packages = spark.createDataFrame([
        ("conan:z", "conan", "Short **one**", "long", ["Zlib"], "https://z.org", None, None, ["b", "a"]), ("vcpkg:z", "vcpkg", "", "# Head\n\nText", [], "https://longer.org/z", "r", "", ["a", "c"]),
        ("spack:y", "spack", None, None, None, "", None, None, None),
    ], PACKAGE)
    entities = spark.createDataFrame([("z", "Z", ["zed"], ["vcpkg:z", "conan:z"]), ("y", "y", [], ["spack:y"]), ("gone", "gone", [], ["bazel:gone"])], "id string, name string, aliases array<string>, packages array<string>")
    rows = {r["id"]: r for r in summaries.summaries(entities, packages).collect()}
    z = rows["z"]
    assert (z["title"], z["content"], z["content_source"], z["topics"], z["managers"]) == ("Z", "Short one", "conan:z", ["a", "c", "b"], ["vcpkg", "conan"])
    assert (z["homepage"], z["homepage_source"], z["licenses"], z["repository_url_source"], z["documentation_url"]) == ("https://longer.org/z", "vcpkg:z", ["Zlib"], "vcpkg:z", None)
    assert (rows["y"]["title"], rows["y"]["content"], rows["y"]["managers"], rows["gone"]["managers"]) == (None, None, ["spack"], ["bazel"])
    wish = spark.createDataFrame([("z", "summary", "vcpkg:z"), ("z", "homepage", "conan:z"), ("y", "homepage", "spack:y"), ("z", "licenses", "absent")], "entity_id string, field string, source string")
    z = {r["id"]: r for r in summaries.summaries(entities, packages, wish).collect()}["z"]
    assert (z["content"], z["homepage"], z["licenses"]) == ("Head Text", "https://z.org", ["Zlib"])
    assert summaries.summaries(entities.limit(0), packages).count() == 0
    assert {r["package_id"]: r["description"] for r in summaries.detail_excerpts(packages).collect()}["conan:z"] == "long"
    assert [r["name"] for r in summaries.listed(spark.createDataFrame([("b",), ("A",), ("a",)], "name string")).collect()] == ["A", "a", "b"]
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.9)], "left string, right string, confidence double")
    assert [r["right"] for r in summaries.by_confidence(pairs).collect()] == ["c", "b"]


def test_release_delta(spark):
    schema = "package_id string, release_id string, summary string, licenses array<string>"
    releases = spark.createDataFrame([("p", "1", "old", ["MIT"]), ("p", "2", "old", ["MIT"]), ("p", "3", "new", ["Zlib"]), ("p", "4", None, None), ("p", "5", "new", ["MIT"]), ("q", "1", "x", None)], schema)
    packages = spark.createDataFrame([("p", "new", ["MIT"])], "package_id string, summary string, licenses array<string>")
    own, groups = summaries.release_delta(releases, packages, ["summary", "licenses"])
    assert sorted((r["package_id"], r["release_id"], r["shown"]) for r in own.collect()) == [("p", "3", {"licenses": '["Zlib"]'}), ("q", "1", {"summary": "x"})]
    assert [(r["releases"], r["shown"]) for r in groups.collect()] == [(["1", "2"], {"summary": "old"})]


def test_normalise_package(spark):
    art = "array<struct<kind:string,url:string,checksums:array<string>>>"
    rows = spark.createDataFrame([
        ("vcpkg", "1", None, ["u"], ["s"]), ("meson", "1", [("k", "u", None)], ["u", "w", "w "], ["s"]), ("hunter", "1-hunter-2", [("k", "u", None), ("k", "v", None)], [], ["s"]), ("conan", "1", None, None, ["s"]), ("conan", "2", None, None, None),
    ], f"registry string, version string, artifacts {art}, source_urls array<string>, checksums array<string>")
    got = [(r["upstream_version"], r["packaging_revision"], [tuple(a) for a in r["artifacts"]]) for r in summaries.normalise_package(rows).collect()]
    assert got == [
        (None, None, [("upstream_source", "u", ["s"])]), (None, None, [("k", "u", None), ("registry_package", "w", None)]), ("1", "hunter-2", [("k", "u", ["s"]), ("k", "v", None)]),
        (None, None, [("upstream_source", None, ["s"])]), (None, None, []),
    ]


def test_labels_and_merge(spark):
    labels = spark.createDataFrame([("posts", "a", "0.25"), ("posts", "b", "1"), ("videos", "c", "7")], "collection string, item_id string, relevance string")
    assert sorted(map(tuple, jobs.checked_labels(labels, "posts").collect())) == [("a", 0.25), ("b", 1.0)]
    for wrong in ("true", "1.5", "x", None, "-0.1", "nan"):
        with pytest.raises(Exception, match="between 0 and 1"):
            jobs.checked_labels(spark.createDataFrame([("posts", "a", wrong)], "collection string, item_id string, relevance string"), "posts").collect()
    schema = "post_id string, source_id string, source_title string, title string, url string, published timestamp, description string, tags array<string>, cpp_relevance double"
    at = lambda d: datetime.datetime(2024, 1, d)
    cache = spark.createDataFrame([("a", "s", "S", "old a", "u", at(1), "d", [" Release "], 0.0), ("b", "s", "S", "b", "u", at(3), "d", None, None)], schema)
    fresh = spark.createDataFrame([("a", "s", "S", "new a", "u", at(2), "d", ["release"], None), ("h", "hid", "H", "h", "u", at(9), "d", None, None)], schema)
    sources = spark.createDataFrame([("s", False), ("hid", True)], "source_id string, hidden boolean")
    exclusions = spark.createDataFrame([("s", "RELEASE")], "source_id string, tag string")
    overrides = spark.createDataFrame([("b", {"title": "better b", "tags": '["x"]'}, None)], "post_id string, values map<string,string>, hidden boolean")
    rows, records = jobs.refresh_posts(cache, fresh, sources, exclusions, overrides=overrides)
    assert [(r["post_id"], r["title"], r["cpp_relevance"], r["hidden"]) for r in rows.orderBy("post_id").collect()] == [("a", "new a", 0.0, True), ("b", "better b", None, False)]
    assert [r["id"] for r in records.collect()] == ["b"] and records.first()["tags"] == ["x"]
    again, _ = jobs.refresh_posts(rows, fresh.limit(0), sources, exclusions)
    assert again.count() == 2
    with pytest.raises(ValueError, match="no correction of url"):
        jobs.merged(cache, fresh, jobs.POSTS, overrides=spark.createDataFrame([("b", {"url": "x"}, None)], "post_id string, values map<string,string>, hidden boolean"))
    assert [r["post_id"] for r in jobs.pruned(cache, jobs.POSTS, "2024-01-02").collect()] == ["b"] and jobs.pruned(cache, jobs.POSTS, keep=0).count() == 0
    for bad in ({}, {"keep": -1}):
        with pytest.raises(ValueError):
            jobs.pruned(cache, jobs.POSTS, **bad)


def test_videos(spark):
    schema = "video_id string, channel_id string, title string, url string, published timestamp, thumbnail_url string, description string, tags array<string>, cpp_relevance double, hidden boolean"
    at = lambda d: datetime.datetime(2024, 1, d)
    cache = spark.createDataFrame([("v1", "c1", "one", "u", at(1), "t", "d", [], None, False), ("v2", "gone", "two", "u", at(2), "t", "d", ["x"], None, None)], schema)
    fresh = spark.createDataFrame([("v3", "c1", "three", "u", at(3), "t", "d", ["x"], 0.5, None)], schema)
    channels = spark.createDataFrame([("c1", "Channel")], "channel_id string, title string")
    rows, records = jobs.refresh_videos(cache, fresh, channels)
    assert rows.count() == 3 and [(r["id"], r["channel"], r["tags"]) for r in records.collect()] == [("v3", "Channel", ["x"]), ("v1", "Channel", None)]
    places = jobs.corrected_within(rows, spark.createDataFrame([("v1", {"title": "better"}, True)], "video_id string, values map<string,string>, hidden boolean"))
    assert {(r["video_id"], r["title"], r["place"], r["hidden"]) for r in places.where("channel_id = 'c1'").collect()} == {("v3", "three", 0, False), ("v1", "better", 1, True)}
    with pytest.raises(ValueError, match="not unique"):
        jobs.video_records(rows, channels.union(channels))
    saved = spark.createDataFrame([("conan", "a"), ("vcpkg", "b")], "registry string, id string")
    assert sorted(map(tuple, jobs.with_saved(spark.createDataFrame([("conan", "new")], "registry string, id string"), saved, ["conan"]).collect())) == [("conan", "new"), ("vcpkg", "b")]
    with pytest.raises(ValueError, match="unknown registries"):
        jobs.with_saved(saved, saved, ["nix"])


def test_presentation(spark):
    assert one(spark, presentation.site_url(F.col("r"), F.col("n")), r="vcpkg", n="a b+") == "https://vcpkg.io/en/package/a%20b%2B" and one(spark, presentation.site_url(F.col("r"), F.col("n")), r="x", n="a") == ""
    assert one(spark, presentation.consumer_snippet(F.col("r"), F.col("n"), F.col("v")), r="bazel", n="z", v="") == 'bazel_dep(name = "z")'
    assert one(spark, presentation.licence_url(F.col("t")), t="MIT OR Zlib") == "" and one(spark, presentation.licence_url(F.col("t")), t="MIT").endswith("/MIT.html")
    tokens = one(spark, presentation.licence_tokens(F.col("t")), t="(MIT OR Apache-2.0) AND Some-Ex")
    assert "".join(t["text"] for t in tokens) == "(MIT OR Apache-2.0) AND Some-Ex" and [t["text"] for t in tokens if t["url"]] == ["MIT", "Apache-2.0", "Some-Ex"]
    assert [tuple(t) for t in one(spark, presentation.licence_tokens(F.col("t")), t="Custom text")] == [("Custom text", "")]
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-2", "1.0.0", "1.0.10", "1.9.0", "1.10.0"]
    frame = spark.createDataFrame([(v,) for v in order], "v string").orderBy(presentation.semver_key(F.col("v")))
    assert [r["v"] for r in frame.collect()] == ["1.0.0-2", *[v for v in order if v != "1.0.0-2"]]
    assert one(spark, presentation.version_less(F.col("a"), F.col("b")), a="1.9.0", b="1.10.0") and not one(spark, presentation.version_less(F.col("a"), F.col("b")), a="v1.9", b="v1.10")
    today = F.lit("2026-11-26").cast("date")
    assert str(one(spark, presentation.month_of(F.col("u"), today), u="/events?month=2025-03&x=1")) == "2025-03-01" and str(one(spark, presentation.month_of(F.col("u"), today), u="?month=2025-13")) == "2026-11-01"
    cards = spark.createDataFrame([("a", ""), ("b", "own"), ("c", None)], "k string, note string")
    meta = spark.createDataFrame([("a", "meta a"), ("b", "meta b")], "k string, note string")
    assert [r["note"] for r in presentation.cards(cards, meta, "k", fallback={"note": "note"}).orderBy("k").collect()] == ["meta a", "own", None]
    assert presentation.cards(cards, meta, "k", required=True).count() == 2
    items = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), (None, 9, "w")], "k string, t int, v string")
    latest = {r["k"]: [i["v"] for i in r["latest"]] for r in presentation.latest_of(cards, items, "k", "t", 2).collect()}
    assert latest == {"a": ["y", "z"], "b": [], "c": []}
    first, again = (presentation.shuffled(cards, s, "k").collect() for s in (1, 1))
    assert first == again and presentation.page_of(cards, [F.col("k")], 2, 1, 1).first()["k"] == "c"


def test_instances(spark):
    schema = "name string, place int, platform string, description string, homepage string, kind string, urls array<string>, licenses array<string>, dependencies array<string>, components array<string>"
    rows = spark.createDataFrame([("z", 1, "linux", None, "h2", "lib", ["b"], ["MIT"], None, None), ("z", 0, "", "d", "h1", None, ["a", ""], None, ["q", "p"], None)], schema)
    r = instances.united(rows).first()
    assert tuple(r) == ("z", "d", "h1", "lib", ["a", "b"], ["MIT"], ["p", "q"], [], ["default", "linux"])
    digest = "AB" * 32
    versions = spark.createDataFrame([("z", ["1.10.0", "1.9.0", "dev"], ["https://x/$(version)/$(version_nodot)", "plain"], {"1.9.0": [digest, "abc"]}), ("z", ["1.9.0"], ["plain"], {"1.9.0": [digest.lower()]})], "name string, versions array<string>, urls array<string>, hashes map<string,array<string>>")
    listed = instances.in_version_order(instances.united_versions(versions)).first()["versions"]
    assert [v["version"] for v in listed] == ["1.9.0", "1.10.0", "dev"] and listed[0]["source_urls"] == ["https://x/1.9.0/190", "plain"] and listed[0]["checksums"] == ["sha256:" + digest.lower()]


def test_amalgamate(spark):
    def package(pid, name, **more):
        row = {"id": pid, "registry": pid.split(":")[0], "name": name, "repository": "", "homepage": "", "source_urls": [], "checksums": [], "authors": [], "maintainers": [], "licenses": ["MIT"], "description": "", "package_type": None, "versions": [], "repositories": []}
        return tuple((row | more).values())

    frame = spark.createDataFrame([package("a:z", "z"), package("b:z", "Z", licenses=["Zlib", "MIT"]), package("c:libz", "libz", repositories=["r"]), package("d:other", "zed", repositories=["r"]), package("a:far", "far"), package("b:far2", "far2")], resolve.PACKAGE)
    groups = spark.createDataFrame([(0, ["a:far", "b:far2"], "faraway", "Far", ["afar"])], "ord int, packages array<string>, id string, name string, aliases array<string>")
    previous = spark.createDataFrame([("old-z", ["a:z", "gone:x"])], "entity_id string, members array<string>")
    made, matches = resolve.amalgamate(frame, groups, previous=previous)
    rows = {r["id"]: r for r in made.collect()}
    assert rows["faraway"]["aliases"] == ["afar", "far", "far2"] and rows["faraway"]["name"] == "Far"
    assert rows["old-z"]["packages"][:2] == ["a:z", "b:z"] and rows["old-z"]["licenses"] == ["MIT", "Zlib"]
    said = {(r["left"], r["right"]): r["decision"] for r in matches.collect()}
    assert said["a:far", "b:far2"] == "manual_merge" and said["a:z", "b:z"] == "merge"
    apart, _ = resolve.amalgamate(frame, never=spark.createDataFrame([("a:z", "b:z")], "left string, right string"))
    assert len([r for r in apart.collect() if set(r["packages"]) & {"a:z", "b:z"}]) == 2


def test_small_parts(spark, tmp_path):
    schema = "package_id string, place int, version string, upstream_version string, packaging_revision string, channel string, x string"
    rows = spark.createDataFrame([("p", 1, "1", "", "2", "", "old"), ("p", 2, "1", "1", "2", "beta", "b"), ("p", 3, "1", "", "2", "", "new"), ("p", 4, "1-r3", "1", "3", "", "own")], schema)
    assert {k: v["x"] for k, v in summaries.version_map(rows, ["x"]).first()["versions"].items()} == {"1#2": "new", "1#2@beta": "b", "1-r3": "own"}
    order = names.version_order(F.col("v"), F.lit(""), F.lit("1.2"))
    assert [r["v"] for r in spark.createDataFrame([("1.10",), ("1.2#1",), ("1.9",)], "v string").orderBy(*order).collect()] == ["1.2#1", "1.10", "1.9"]
    for text, expected in (('{"type":"t","value":" a &amp; b "}', "a & b"), ('"x "', "x"), ("plain", "plain"), (None, "")):
        assert one(spark, names.text_or_value(F.col("t")), t=text) == expected
    found = spark.createDataFrame([("z", ["a:z", "b:z"]), ("y", ["a:y"])], "id string, packages array<string>")
    assert sorted(map(tuple, summaries.totals(found).collect())) == [("", 2), ("a", 2), ("b", 1)]
    assert publish.exit_status(True, True) == 1 and publish.exit_status(True, False) == 0
    books = spark.createDataFrame([("978-0-306-40615-7", False), ("bad", True)], "isbn string, hidden boolean")
    assert [r["isbn"] for r in datasets.isbns(books).collect()] == ["9780306406157"]
    with pytest.raises(Exception, match="not an ISBN"):
        datasets.isbns(books.withColumn("hidden", F.lit(False))).collect()
    log, manifest = collection.update(None, spark.createDataFrame([("a", "t")], "id string, title string"))
    path = str(tmp_path / "c")
    assert collection.read(spark, path) == (None, None) and collection.publish(spark, path, log, manifest) and not collection.publish(spark, path, log, manifest)
    again, head = collection.read(spark, path)
    assert head == manifest and [r["id"] for r in collection.current(again).collect()] == ["a"]
    files = lambda *f: spark.createDataFrame([(x,) for x in f], "file string")
    assert [r["file"] for r in collection.obsolete(files("a", "b"), files("b", "c")).collect()] == ["a"]
    store = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    revisions = lambda df: {r["revision"] for r in kvstore.manifest(df, "id", 1).collect()}
    assert revisions(store) == revisions(store.orderBy(F.desc("id"))) != revisions(store.withColumn("v", F.lit(3)))
    events = spark.createDataFrame([(1, "2025-01-05"), (2, "2025-02-03")], "k int, s string").select("k", F.to_date("s").alias("s"), F.lit(None).cast("date").alias("e"))
    text, following = calendar.status(events, "s", "e", "2025-01", F.lit(False), ["k"])
    assert text == "1 event" and following.first()["k"] == 2
    at = lambda d: datetime.datetime(2024, 1, d)
    cache = spark.createDataFrame([("x", "s", "u", "t", at(1), ["News"], None), ("y", "s", "w", "t", at(2), [], None)], "post_id string, source_id string, url string, title string, published timestamp, tags array<string>, hidden boolean")
    tags = spark.createDataFrame([("s", "news")], "source_id string, tag string")
    assert {r["post_id"]: r["hidden"] for r in jobs.maintain(cache, jobs.POSTS, "clean", tags).collect()} == {"x": True, "y": False}
    assert [r["post_id"] for r in jobs.maintain(cache, jobs.POSTS, "prune", keep=1).collect()] == ["y"]
    with pytest.raises(ValueError, match="unknown command"):
        jobs.maintain(cache, jobs.POSTS, "drop")
    assert len(jobs.normal_posts(cache).first()["post_id"]) == 16
    day = spark.createDataFrame([("2024-01-02",)], "p string").select(F.to_date("p").alias("published"))
    assert jobs.normal_videos(day).first()["published"] == at(2)
    files = spark.createDataFrame([("subprojects/z.wrap", "[wrap-file]\ndirectory = z-1\nsource_url = https://x/z.tgz\n")], "path string, text string")
    with pytest.raises(ValueError, match="no package"):
        registries.parse_named(files, "meson", "q")
