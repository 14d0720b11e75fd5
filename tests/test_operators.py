import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalith.operators import calendar, changelog, entities, kvstore, merge, resolve, termindex
from catalith.plans.search import SearchRequest, parse_query, search, search_indexed, substring_match


def test_upsert_keeps_history(spark, rows):
    frame = spark.createDataFrame([("a", 1, "old", 0.4), ("a", 2, "new", None), ("b", 3, "only", None), (None, 4, "x", 1.0), ("a", 2, "new", None)], "id string, n int, t string, r double")
    assert rows(merge.upsert(frame, "id", ["n"], ["r"], "place")) == [("a", 2, "new", 0.4, 1), ("b", 3, "only", None, 3)]
    assert merge.upsert(frame.limit(0), "id", ["n"], ["r"]).count() == 0
    assert [r["c"] for r in merge.carry_forward(frame.where("id = 'a'"), "id", ["n"], "r", "c").orderBy("n").collect()] == [0.4, 0.4, 0.4]
    assert rows(merge.top_n(frame.where("id IS NOT NULL"), "id", [F.desc("n"), F.asc("t")], 1).select("id", "n")) == [("a", 2), ("b", 3)]


def test_labels_overrides_and_hiding(spark, rows):
    frame = spark.createDataFrame([("a", 0.1, "x", ["Poetry", " News "]), ("b", None, "y", None)], "id string, r double, s string, tags array<string>")
    assert rows(merge.label(frame.select("id", "r"), spark.createDataFrame([("b", 0.9)], "id string, label double"), "id", "r")) == [("a", 0.1), ("b", 0.9)]
    with pytest.raises(Exception, match="between 0 and 1"):
        merge.label(frame.select("id", "r"), spark.createDataFrame([("b", 1.9)], "id string, label double"), "id", "r").collect()
    over = spark.createDataFrame([("a", {"s": ""}, True)], "id string, values map<string,string>, hidden boolean")
    assert rows(merge.override(frame.select("id", "s"), over, "id", ["s"])) == [("a", "", True), ("b", "y", False)]
    assert rows(merge.unknown_overrides(frame, spark.createDataFrame([("zz",), ("a",)], "id string"), "id")) == [("zz",)]
    excluded = spark.createDataFrame([("x", " poetry ")], "s string, tag string")
    assert rows(merge.hide_by_tag(frame, excluded, "s", "tags").select("id", "hidden")) == [("a", True), ("b", False)]
    assert rows(merge.relevant(frame, "r").select("id")) == [("b",)]


def test_log_replays_to_the_next_state(spark, rows):
    before = spark.createDataFrame([(f"k{i}", f"t{i}") for i in range(30)], "key string, title string")
    after = spark.createDataFrame([(f"k{i}", f"t{i}" if i % 3 else f"u{i}") for i in range(5, 40)], "key string, title string")
    ops = changelog.operations(before, after, "key", ["title"])
    assert ops.where("_deleted").count() == 5 and rows(ops.select(F.min("position"), F.max("position")))[0][0] == 0
    first = changelog.positions(before.withColumn("_deleted", F.lit(False)), ["key"])
    log = first.withColumn("b", F.lit(0)).unionByName(ops.withColumn("b", F.lit(1))).withColumn("position", F.struct("b", "position")).drop("b", "offset")
    assert rows(changelog.replay(log, "key")) == rows(after)
    chunks = changelog.descriptors(changelog.chunked(ops, ["position"], F.lit(10).cast("long"), 100), "title", F.lit(10), F.lit(True))
    assert rows(chunks.agg(F.sum("operations")))[0][0] == ops.count() and chunks.where("NOT sealed").count() == 1
    assert changelog.operations(after, after, "key", ["title"]).count() == 0


def test_index_and_search_agree(spark, rows):
    frame = spark.createDataFrame([(i, f"alpha{i % 7} beta{i % 5} common c", None if i == 3 else f"2026-01-{i % 28 + 1:02d}") for i in range(60)], "id long, text string, day string").withColumn("day", F.to_timestamp("day"))
    fields = {"content": ["text"]}
    chunk = F.floor(F.col("id") / 4)
    index = termindex.postings(frame, fields, chunk)
    assert index.where("term = 'c'").count() == 0
    for request in (SearchRequest("alpha3 beta1"), SearchRequest("com"), SearchRequest("nothing"), SearchRequest("alpha1", after="2026-01-05", before="2026-01-20")):
        direct = search(frame, fields, request, "id", "day")
        assert [r["id"] for r in search_indexed(frame, index, fields, request, "id", "day", chunk).collect()] == [r["id"] for r in direct.collect()]
    assert search(frame, fields, SearchRequest(limit=5), "id", "day").count() == 5
    assert frame.where(substring_match(["text"], "pha3 BETA1")).count() == frame.where("text LIKE '%alpha3%' AND text LIKE '%beta1%'").count()
    assert parse_query("png manager:Conan manager:none", "manager", ["conan"]) == ("png manager:none", ["conan"])
    for zone in termindex.encoded_segments(index, 15).collect():
        for term, held in termindex.decode_segment(zone["data"], 15):
            assert held == {0: sorted(r["chunk"] for r in index.where(F.col("term") == term).collect())}


def test_varints():
    for n in (0, 1, 127, 128, 300, 2**40):
        assert termindex.read_varint(termindex.write_varint(n), 0)[0] == n


def test_store(spark, tmp_path):
    frame = spark.createDataFrame([(f"id{i}", i) for i in range(50)], "id string, v int")
    kvstore.write(frame, "id", 16, str(tmp_path / "kv"))
    assert [tuple(r) for r in kvstore.lookup(spark, str(tmp_path / "kv"), "id", "id7", 16).collect()] == [("id7", 7)]
    assert kvstore.lookup(spark, str(tmp_path / "kv"), "id", "absent", 16).count() == 0
    with pytest.raises(ValueError, match="not unique"):
        kvstore.write(frame.union(frame), "id", 16, str(tmp_path / "kv2"))


def package(pid, name, **more):
    base = dict.fromkeys(("repository", "homepage", "description", "package_type")) | dict.fromkeys(("source_urls", "checksums", "authors", "maintainers", "licenses", "versions", "repositories"), [])
    row = {"id": pid, "registry": pid.split(":")[0], "name": name, **base, **more}
    return tuple(row[c.split(" ")[0]] for c in resolve.PACKAGE.split(", "))


@pytest.mark.parametrize("left, right, expected", [
    ({"name": "foo"}, {"name": "foo"}, 0.95),
    ({"name": "foo", "licenses": ["mit"]}, {"name": "foo", "licenses": ["bsd"]}, 0.836),
    ({"name": "foo", "repositories": ["r"], "repository": "r"}, {"name": "bar", "repositories": ["r"], "repository": "r"}, 1.0),
    ({"name": "foo", "checksums": ["c"]}, {"name": "bar", "checksums": ["c"]}, 1.0),
    ({"name": "libfoo", "authors": ["a"]}, {"name": "foo", "authors": ["A "]}, 0.6),
    ({"name": "foo", "authors": ["a"]}, {"name": "bar", "authors": ["a"]}, 0.462),
])
def test_scores(spark, left, right, expected):
    frame = spark.createDataFrame([package("x:1", **left), package("y:1", **right)], resolve.PACKAGE)
    pairs = resolve.block_pairs(frame)
    assert pairs.count() == 1
    got = resolve.score_pairs(pairs, frame).first()["confidence"]
    assert got == expected


def test_sources_of_packages_are_compared(spark, rows, tmp_path):
    from catalith.plans import core_queries

    digest = "ab" * 32
    schema = "package_id string, package_name string, release_version string, licenses array<string>, repository_url string, homepage string, summary string, artifacts array<struct<kind:string,url:string,checksums:array<string>>>"
    release = lambda pid, *artifacts: (pid, pid.split(":")[1], "1", None, None, None, None, list(artifacts) or None)
    data = [
        release("conan:one", ("upstream_source", " https://s.example/one.tgz ", None)), release("vcpkg:uno", ("upstream_source", "https://s.example/one.tgz", None)),
        release("conan:two", ("upstream_source", None, [f"SHA256={digest.upper()}", None])), release("vcpkg:duo", ("upstream_source", None, [f"sha256:{digest}"])),
        release("conan:three", ("patch", "https://s.example/p.diff", ["cd" * 32])), release("vcpkg:tres", ("patch", "https://s.example/p.diff", ["cd" * 32])), release("spack:none"),
    ]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "package_versions.parquet"))
    assert rows(core_queries.QUERIES["text_similarity"](spark, str(tmp_path)).select("left", "right", "confidence")) == [("conan:one", "vcpkg:uno", 1.0), ("conan:two", "vcpkg:duo", 1.0)]
    roots = dict(rows(core_queries._entities(spark, str(tmp_path))[1]))
    assert roots["vcpkg:uno"] == "conan:one" and roots["vcpkg:duo"] == "conan:two" and roots["vcpkg:tres"] == "vcpkg:tres"
    assert len({r[1] for r in rows(core_queries.QUERIES["entity_ids"](spark, str(tmp_path)))}) == 5


def test_constrained_merge(spark, rows):
    frame = spark.createDataFrame([package("a:x", "x"), package("b:x", "x"), package("c:x", "x"), package("a:y", "y"), package("d:z", "z")], resolve.PACKAGE)
    match = lambda *m: spark.createDataFrame(m, "left string, right string, confidence double, priority int")
    roots, decisions = resolve.constrained_merge(frame, match(("a:x", "b:x", 0.95, 7), ("b:x", "c:x", 0.9, 7), ("a:y", "b:x", 0.99, 1), ("c:x", "d:z", 0.5, 7)))
    assert rows(roots) == [("a:x", "a:x"), ("a:y", "a:y"), ("b:x", "a:x"), ("c:x", "a:x"), ("d:z", "d:z")]
    assert ("a:y", "b:x", "conflict") in rows(decisions)
    never = spark.createDataFrame([("a:x", "c:x")], "left string, right string")
    roots, _ = resolve.constrained_merge(frame, match(("a:x", "b:x", 0.95, 7), ("b:x", "c:x", 0.9, 7)), forbidden=never)
    assert dict(rows(roots))["c:x"] == "c:x"
    forced = spark.createDataFrame([("a:x", "a:y", 0)], "left string, right string, ord int")
    roots, decisions = resolve.constrained_merge(frame, match(("a:x", "b:x", 0.95, 7)), forced=forced)
    assert dict(rows(roots))["a:y"] == "a:x" and ("a:x", "a:y", "manual_merge") in rows(decisions)


def test_manual_groups(spark, rows):
    frame = spark.createDataFrame([package("a:x", "x"), package("b:x", "x"), package("c:x", "x"), package("a:y", "y")], resolve.PACKAGE)
    make = lambda *g: spark.createDataFrame(list(g), "ord int, packages array<string>, optional array<string>, id string, name string")
    forced, members = resolve.manual_groups(make((0, ["a:x", "a:y"], ["q:absent", "c:x"], "mine", "Mine"), (1, ["b:x", "a:x"], None, None, None)), frame)
    assert [tuple(r)[:2] for r in forced.orderBy("ord").collect()] == [("a:x", "a:y"), ("a:y", "c:x"), ("b:x", "a:x")] and forced.first()["evidence"][0]["weight"] == 1.0
    assert {r["id"]: r["curated_id"] for r in members.collect()} == {"a:x": "mine", "a:y": "mine", "c:x": "mine", "b:x": None}
    for bad, match in ((make((0, ["z:z", "a:x"], None, None, None)), "unknown packages: z:z"), (make((0, [], ["z:z"], None, None)), "needs a package")):
        with pytest.raises(ValueError, match=match):
            resolve.manual_groups(bad, frame)
    matches = spark.createDataFrame([("a:x", "b:x", 0.95, 7), ("b:x", "c:x", 0.9, 7)], "left string, right string, confidence double, priority int")
    roots, decisions = resolve.constrained_merge(frame, matches, protected=spark.createDataFrame([("a:x",)], "id string"))
    assert dict(rows(roots)) == {"a:x": "a:x", "b:x": "b:x", "c:x": "b:x", "a:y": "a:y"} and ("a:x", "b:x", "none") in rows(decisions)


def test_curated_ids(spark, rows):
    groups = spark.createDataFrame([("r1", "Foo", ["a:1"]), ("r2", "foo", ["c:9"]), ("r3", "Bar", ["d:1"])], "root string, name string, members array<string>")
    curated = lambda *c: spark.createDataFrame(list(c), "root string, curated_id string")
    before = spark.createDataFrame([("kept", ["d:1"])], "entity_id string, members array<string>")
    assert dict(rows(resolve.entity_ids(groups, before, curated(("r1", "foo"), ("r2", None)))))["r1"] == "foo"
    assert dict(rows(resolve.entity_ids(groups, before, curated(("r1", "foo"))))) == {"r1": "foo", "r2": dict(rows(resolve.entity_ids(groups, before, curated(("r1", "foo")))))["r2"], "r3": "kept"}
    assert dict(rows(resolve.entity_ids(groups, before, curated(("r3", "mine")))))["r3"] == "mine"
    for bad in (curated(("r1", "kept")), curated(("r1", "x"), ("r2", "x"))):
        with pytest.raises(ValueError, match="not unique"):
            resolve.entity_ids(groups, before, bad)


def test_entity_ids(spark, rows):
    groups = spark.createDataFrame([("r1", "Foo", ["a:1", "b:1"]), ("r2", "foo", ["c:9"]), ("r3", "Bar", ["d:1"])], "root string, name string, members array<string>")
    before = spark.createDataFrame([("kept", ["b:1", "a:1"]), ("lost", ["a:1"])], "entity_id string, members array<string>")
    assert dict(rows(resolve.entity_ids(groups, before))) == {"r1": "kept", "r2": "foo", "r3": "bar"}
    fresh = dict(rows(resolve.entity_ids(groups)))
    assert fresh["r3"] == "bar" and fresh["r1"].startswith("foo-") and fresh["r1"] != fresh["r2"]


def test_entities(spark, rows):
    frame = spark.createDataFrame([("e", "conan", "Foo", "", "long text", 1), ("e", "vcpkg", "foo", "s", "d", 2), ("e", "xmake", "foo", None, None, 3)], "g string, registry string, name string, summary string, description string, id int")
    assert rows(entities.most_common_name(frame, "g", "name")) == [("e", "foo")] and rows(entities.other_names(frame, "g", "name")) == [("e", "Foo")]
    assert rows(entities.best_summary(frame, "g", "registry", "summary", "description", "id")) == [("e", "s")]
    assert rows(entities.best_field(frame, "g", "registry", "description", "id")) == [("e", "d", 2)]


def test_calendar(spark, rows):
    events = spark.createDataFrame([("long", "2025-01-30", "2025-02-02"), ("one", "2025-02-03", None), ("back", "2025-02-05", "2025-02-01")], "t string, s string, e string").select("t", F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    days = calendar.by_day(events, "s", "e", "2025-02")
    assert rows(days.groupBy("t").count()) == [("long", 4), ("one", 1)]
    assert calendar.grid(spark, "2025-02").count() == 42 and str(calendar.grid(spark, "2025-02").orderBy("day").first()["day"]) == "2025-01-27"
    assert rows(calendar.next_after(events, "s", F.to_date(F.lit("2025-01-31")), F.lit(False), ["t"]).select("t")) == [("one",)]


def test_calendar_feed_holds_suppliers(spark, small):
    from catalith.plans import source_queries
    from catalith.util import table

    feeds = {r["nation"]: r["document"] for r in source_queries.calendar_feed(spark, small).collect()}
    suppliers = table(spark, small, "supplier").join(table(spark, small, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).collect()
    assert set(feeds) == {r["n_name"] for r in suppliers} and sum(d.count("BEGIN:VEVENT") for d in feeds.values()) == len(suppliers)
    assert all(f"SUMMARY:{r['s_name']}\r\n" in feeds[r["n_name"]] for r in suppliers)


def scoring_packages(spark):
    """Three hundred packages of one page, and pairs on it that only one other signal joins."""
    page = {"homepage": "homepage.invalid"}
    data = [package(f"{'abc'[i % 3]}:n{i}", f"n{i}", **page, licenses=["mit"], versions=["1"], maintainers=["m"], description="the same text") for i in range(300)]
    data += [
        package("a:repo", "one", **page, repository="f/1", repositories=["f/1", "f/9"]), package("b:repo", "two", **page, repository="f/2", repositories=["f/2", "f/9"]),
        package("a:lib", "lib", **page), package("b:dash", "-", **page), package("a:none", None, **page), package("b:none", None, **page),
        package("a:url", "three", source_urls=["https://s/X"]), package("b:url", "four", source_urls=["https://s/X"]), package("c:url", "five", source_urls=["https://s/x "]),
        package("a:sum", "six", checksums=["c"], authors=["A"]), package("b:sum", "seven", checksums=["c"]), package("b:author", "eight", authors=["A"], licenses=["mit"]),
        package("a:far", "nine", repository="f/3", repositories=["f/3", "f/8"]), package("b:far", "ten", repository="f/4", repositories=["f/4", "f/8"]),
    ]
    return spark.createDataFrame(data, resolve.PACKAGE)


@pytest.mark.parametrize("texts", [False, True])
def test_candidates_give_the_scores_of_all_pairs(spark, rows, texts):
    """A page of many packages adds no pairs to those that are scored, and no match is lost by that."""
    frame = scoring_packages(spark)
    candidates = resolve.candidate_pairs(frame)
    assert candidates.count() < 20 < 20_000 < resolve.block_pairs(frame).count()
    assert candidates.join(resolve.block_pairs(frame), ["left", "right"], "left_anti").isEmpty()
    found = rows(resolve.score_pairs(candidates, frame, texts))
    assert found == rows(resolve.score_pairs(resolve.block_pairs(frame), frame, texts))
    assert {r[:2] for r in found} >= {("a:repo", "b:repo"), ("a:lib", "b:dash"), ("a:url", "b:url"), ("a:sum", "b:sum"), ("a:sum", "b:author")}


def test_signals_besides_the_candidates_stay_below_the_floor():
    strong = {"same upstream repository", "same distributed source URL", "same distributed source checksum", "same exact name", "same normalized spelling", "library-prefix alias", "shared author"}
    miss = 1 - resolve.SIMILAR_WEIGHT
    for signal, weight in resolve.WEIGHTS.items():
        miss *= 1 - max(0, weight) if signal not in strong else 1
    assert (1 - miss) * (1 + resolve.WEIGHTS["substantially different names"]) < resolve.FLOOR - 0.001


def test_scoring_queries_pair_no_page(spark, tmp_path, monkeypatch):
    """The queries score no pairs that only share a page."""
    from catalith.plans import core_queries

    scored = []
    real = resolve.score_pairs
    monkeypatch.setattr(resolve, "score_pairs", lambda pairs, *more: scored.append(pairs.count()) or real(pairs, *more))
    monkeypatch.setattr(core_queries, "_packages", lambda *_: scoring_packages(spark))
    for name in ("pair_score", "merge_priority", "text_similarity", "constrained_clusters", "entity_ids"):
        core_queries.QUERIES[name](spark, str(tmp_path))
    assert len(scored) == 5 and max(scored) < 20


def on_one_page(spark, small, tmp_path):
    """The folder of a package_versions in which all packages name one page."""
    from catalith.util import table

    table(spark, small, "package_versions").withColumn("homepage", F.lit("https://homepage.invalid/")).write.parquet(f"{tmp_path}/package_versions.parquet")
    return str(tmp_path)


def test_merge_priority_of_one_page(spark, rows, small, tmp_path, monkeypatch):
    """A page that all packages name makes no pairs to shuffle, and the rows are those of the SQL."""
    from catalith.plans import core_queries

    scored, real = [], resolve.score_pairs
    monkeypatch.setattr(resolve, "score_pairs", lambda pairs, *more: scored.append(pairs.count()) or real(pairs, *more))
    path = on_one_page(spark, small, tmp_path)
    found = rows(core_queries.QUERIES["merge_priority"](spark, path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW package_versions AS SELECT * FROM '{path}/package_versions.parquet/*.parquet'")
    assert found and found == sorted(con.execute(core_queries.ORACLES["merge_priority"]).fetchall(), key=repr)
    assert len(found) <= scored[0] < 2 * len(found) < core_queries.block_pairs(spark, path).count() / 10


def test_text_similarity_of_one_page(spark, rows, small, tmp_path, monkeypatch):
    """A page that all packages name makes no pairs whose texts are compared, and no match is lost by that."""
    from catalith.plans import core_queries

    scored, real = [], resolve.score_pairs
    path = on_one_page(spark, small, tmp_path)
    monkeypatch.setattr(resolve, "score_pairs", lambda pairs, *more: scored.append(pairs.count()) or real(pairs, *more))
    found = rows(core_queries.QUERIES["text_similarity"](spark, path))
    monkeypatch.setattr(resolve, "candidate_pairs", resolve.block_pairs, raising=False)
    assert found and any(r[3] for r in found) and found == rows(core_queries.QUERIES["text_similarity"](spark, path))
    assert len(found) <= scored[0] < 2 * len(found) < scored[1] / 10


def shuffle_files(spark):
    """The shuffle files that the session has on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def frees_pairs(spark, name, path):
    """Whether a query, before its rows are asked for, has made its pairs and holds no shuffle files of them."""
    from catalith.plans import core_queries

    had = shuffle_files(spark)
    plan = core_queries.QUERIES[name](spark, path)._jdf.queryExecution().optimizedPlan().toString()
    ends = time.time() + 10
    while (left := shuffle_files(spark) - had) and time.time() < ends:
        time.sleep(0.2)
    return "Generate" not in plan and "authors" not in plan.replace("shared author", "") and not left


def test_merge_priority_frees_its_pairs(spark, small):
    """The shuffles that make the pairs aren't on disk beside those that score them, and no shuffle carries columns that are always empty."""
    assert frees_pairs(spark, "merge_priority", small)


def test_text_similarity_frees_its_pairs(spark, small):
    """The shuffles that make the pairs aren't on disk beside those that bring their texts together."""
    assert frees_pairs(spark, "text_similarity", small)


def test_texts_are_compared_once(monkeypatch):
    """Texts that are equal or come again aren't compared again, and the ratios are the plain ones."""
    real, made = resolve.SequenceMatcher, []
    monkeypatch.setattr(resolve, "SequenceMatcher", lambda *a: made.append(a[1:]) or real(*a))
    long = "fast parser of feeds, " * 30  # from 200 characters on, frequent ones are left out
    pairs = [("Fast parser", "a FAST parser"), ("fast PARSER", "a fast parser"), ("a fast parser", "fast parser"), (long, long.upper()), (long, long + "x"), ("x", None), ("", "x"), ("x", "X")] * 2
    found = resolve.text_ratio.func(*[pd.Series(side, dtype=object) for side in zip(*pairs, strict=True)])
    plain = [real(None, a.casefold(), b.casefold()).ratio() if a and b else None for a, b in pairs]
    assert [None if pd.isna(r) else r for r in found] == plain and len(made) == 3


def test_components_are_replayed_together(spark, rows, monkeypatch):
    """However many components one task replays, each gives the same groups and decisions."""
    data = [package(f"{r}:p{i}", f"p{i}") for i in range(40) for r in "abc"]
    frame = spark.createDataFrame(data, resolve.PACKAGE)
    links = [m for i in range(40) for m in ((f"a:p{i}", f"b:p{i}", 0.95, 7), (f"b:p{i}", f"c:p{i}", 0.9, 7), (f"a:p{i}", f"a:p{i ^ 1}", 0.85, 1))]
    matches = spark.createDataFrame(links, "left string, right string, confidence double, priority int")
    never = spark.createDataFrame([(f"a:p{i}", f"c:p{i}") for i in range(0, 40, 4)], "left string, right string")
    together = [rows(f) for f in resolve.constrained_merge(frame, matches, forbidden=never)]
    monkeypatch.setattr(resolve, "REPLAYED", 1)
    assert together == [rows(f) for f in resolve.constrained_merge(frame, matches, forbidden=never)]
    assert dict(together[0])["c:p0"] == "c:p0" and dict(together[0])["c:p1"] == "a:p1" and ("a:p0", "a:p1", "conflict") in together[1]
