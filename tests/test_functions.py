import pytest
from pyspark.sql import functions as F

from catalith.functions import ids, names, prose
from catalith.functions import text as tx


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("v")).first()["v"]


def test_terms(spark):
    assert one(spark, tx.terms(F.lit("C++20 is here: c++20 foo-bar.h #tag")), x="") == ["c++20", "is", "here", "foo-bar.h", "#tag"]
    assert one(spark, tx.index_terms(F.lit("C is ok")), x="") == ["is", "ok"]
    assert tx.query_terms("Foo f foo BAR") == ["foo", "bar"]
    assert one(spark, tx.folded(F.lit("Straße ﬁ"))) == "strasse fi"


@pytest.mark.parametrize("text, limit, expected", [("short", 10, "short"), ("one two three four", 9, "one two…"), ("one, two three", 8, "one, two…"), ("x" * 30, 10, "x" * 11 + "…"), ("ab " + "x" * 30, 10, "ab xxxxxxx…")])
def test_truncate(spark, text, limit, expected):
    assert one(spark, tx.truncate(F.col("t"), limit), t=text) == expected
    assert prose.cut_behind_word(text, limit) == expected


def test_prose(spark):
    plain = prose.prose("One <b> paragraph")
    assert plain == ("One <b> paragraph", "One &lt;b&gt; paragraph", "One &lt;b&gt; paragraph", "plain", False)
    several = prose.prose("# Head\n\n[![x](y)](z)\n\n- a\n- **b**\n  more\n\n\n\n1. one\n\n> said\n\n```\n a < *b*\n\n```\nlast `code` [x](javascript:y) [z](https://z.org)\0")
    assert several.body_html.split("\n", 3)[:3] == ["<h1>Head</h1>", "<ul><li>a</li><li><strong>b</strong> more</li></ul>", "<ol><li>one</li></ol>"]
    assert several.body_html.endswith('<pre><code> a &lt; *b*\n</code></pre>\n<p>last <code>code</code> <a href="#">x</a> <a href="https://z.org">z</a></p>')
    assert several.detected_format == "markdown" and several.summary_text == "Head a b more one said a < *b* last code x z"
    assert prose.prose("First.\nline\n\nSecond.").body_html == "<p>First.<br>line</p><p>Second.</p>"
    cut = prose.prose("a\n\nb\n\nc", block_limit=2)
    assert cut.truncated and cut.body_html == "<p>a</p><p>b</p>" and prose.prose(None) == ("", "", "", "plain", False)
    assert len(prose.prose("word " * 100).summary_text) <= 161 and len(prose.prose("word " * 100, body_limit=40).body_html) < 80
    assert prose.prose("<script>alert(1)</script> **safe**").body_html == "&lt;script&gt;alert(1)&lt;/script&gt; <strong>safe</strong>"
    short = prose.excerpt("<h1>Package</h1><p>Useful &amp; <b>good</b>.</p><p>Unneeded.</p>")
    assert short.body_html == "<p>Package</p><p>Useful &amp; good.</p>" and short.truncated and prose.excerpt(None).body_html == ""
    assert prose.excerpt("<p>" + "x" * 9 + "</p>", body_limit=4) == ("xxxx", "xxxx", "xxxx", "plain", True)
    frame = spark.createDataFrame([("*a* `b`",), (None,)], "t string").select(prose.rendered(F.col("t")).alias("r"), prose.excerpted(F.col("t")).alias("e"))
    assert [(r["r"]["summary_text"], r["e"]["summary_text"]) for r in frame.collect()] == [("a b", "*a* `b`"), ("", "")]


def test_entities(spark):
    for text, expected in (("a &amp; b&lt;&#233;&#x1F600;&nope; &apos; & c;", "a & b<é😀&nope; ' & c;"), ("plain", "plain"), ("&#0;&amp", "&#0;&amp"), ("", ""), (None, None)):
        assert one(spark, tx.entities_decoded(F.col("t")), t=text) == expected


def test_addresses(spark):
    for base, value, full in (("https://x.org/a/b", "../i.png?x=1", "https://x.org/i.png?x=1"), ("https://x.org/a/", "i.png", "https://x.org/a/i.png"), ("https://x.org", "//c.org/i", "https://c.org/i"), ("https://x.org/a", "/", ""), ("https://x.org", "data:x", "data:x"), ("", "i.png", "i.png"), (None, "i.png", "i.png"), ("https://x.org/a", None, ""), ("https://x.org/a/b/c", "./d/../e", "https://x.org/a/b/e")):
        assert one(spark, names.image_url("b", "v"), b=base, v=value) == full


def test_ids(spark):
    assert one(spark, ids.fnv1a(F.col("t")), t="") == 0x811C9DC5
    assert one(spark, ids.fnv1a(F.col("t")), t="foobar") == 0xBF9CF968
    assert one(spark, ids.slug(F.col("t")), t="  Foo & Bar! ") == "foo-bar" and one(spark, ids.slug(F.col("t")), t="++") == "package"
    assert len(one(spark, ids.short_id(F.col("a"), F.col("b")), a="s", b="u")) == 16
    with pytest.raises(ValueError):
        ids.bucket(F.lit("x"), 10)


def test_names(spark):
    assert one(spark, names.alias(F.col("t")), t="lib-Foo_Bar.x") == "foobarx"
    assert one(spark, names.host_path(F.col("t")), t="https://WWW.Example.org:80/A/b/?x#y") == "example.org:80/a/b"
    assert one(spark, names.repository_identity(F.col("t")), t="https://github.com/Foo/Bar.git/tree") == "https://github.com/foo/bar"
    assert one(spark, names.repository_identity(F.col("t")), t="https://example.org/a/b") == "" and one(spark, names.repository_identity(F.col("t")), t=None) == ""
    assert one(spark, names.image_url(F.lit("https://x.org/a/"), F.lit("i.png"))) == "https://x.org/a/i.png" and one(spark, names.image_url(F.lit("https://x.org/a"), F.lit("/"))) == ""
    assert one(spark, names.clean_licences(F.array(*[F.lit(v) for v in (" MIT License", "unknown", "MIT", "", "gplv2")]))) == ["MIT", "GPL-2.0-only"]
    assert one(spark, names.sri_checksum(F.lit("sha256-AAEC"))) == "sha256:000102"
    assert one(spark, names.source_checksums(F.create_map(F.lit("sha256"), F.lit("AB"), F.lit("md5"), F.lit("C")))) == ["md5:c", "sha256:ab"]


@pytest.mark.parametrize("registry, version, expected", [("cppget", "1.2.3+4", ("1.2.3", "4")), ("hunter", "v1.0-hunter-2", ("1.0", "hunter-2")), ("hunter", "1.0-hunter", ("1.0", "hunter")), ("vcpkg", "v2.0+1", ("2.0+1", "")), ("vcpkg", "vnext", ("vnext", ""))])
def test_version_identity(spark, registry, version, expected):
    assert tuple(one(spark, names.version_identity(F.lit(registry), F.lit(version)))) == expected


def test_versions_and_books(spark):
    listed = ["1.10.0", "1.9.0", "1.9.0-rc1", "2"]
    frame = spark.createDataFrame([(v,) for v in listed], "v string")
    assert [r["v"] for r in frame.orderBy(names.natural_key(F.col("v"))).collect()] == ["1.9.0", "1.9.0-rc1", "1.10.0", "2"]
    assert one(spark, names.release_id(F.lit("1"), F.lit("2"), F.lit("beta"))) == "1#2@beta" and one(spark, names.release_id(F.lit("1"), F.lit(None), F.lit(""))) == "1"
    for isbn, right in (("978-0-306-40615-7", True), ("9780306406158", False), ("0-306-40615-2", True), ("080442957X", True), ("12", False), (None, False)):
        assert one(spark, names.valid_isbn(F.col("t")), t=isbn) is right
    assert one(spark, names.isbn10(F.lit("9780306406157"))) == "0306406152" and one(spark, names.isbn10(F.lit("9791090636071"))) == ""
    assert tuple(one(spark, names.split_title(F.lit("Clean Code: A Handbook: two"), F.lit("")))) == ("Clean Code", "A Handbook: two")
    assert tuple(one(spark, names.split_title(F.lit("Code: A Handbook"), F.lit("")))) == ("Code: A Handbook", "")
    assert one(spark, names.subjects(F.array(F.lit("C++"), F.lit("c++"), F.lit("open_syllabus_project"), F.lit("x" * 61), F.lit("Go")))) == ["C++", "Go"]
