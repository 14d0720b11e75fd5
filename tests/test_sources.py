import json

import pytest

from catalith.sources import feeds, grammars, registries


def parsed(spark, registry, files):
    return [r.asDict(True) for r in registries.parse(spark.createDataFrame(list(files.items()), "path string, text string"), registry).collect()]


def test_vcpkg(spark):
    port = {"name": "z", "version": "2.3", "description": ["Fast", "zip"], "license": "Zlib", "dependencies": ["cmake", {"name": "host"}], "default-features": ["compat"], "features": {"compat": {"description": "x", "dependencies": ["extra"]}}}
    files = {
        "ports/z/vcpkg.json": json.dumps(port),
        "ports/z/portfile.cmake": 'vcpkg_from_github(REPO z/z REF "v(2)" SHA512 AB)\nvcpkg_download_distfile(URLS https://github.com/other/tool.tgz SHA512 cd)',
        "versions/z-/z.json": json.dumps({"versions": [{"version": "2.3", "port-version": 1}, {"version-date": "2020-01-01"}]}),
        "versions/q-/q.json": "{}",
    }
    (row,) = parsed(spark, "vcpkg", files)
    assert row["repository_url"] == "https://github.com/z/z" and row["summary"] == "Fast zip" and row["dependencies"] == ["cmake", "host", "extra"]
    assert [(v["version"], v["revision"]) for v in row["versions"]] == [("2.3", "1"), ("2020-01-01", None)]
    assert row["versions"][0]["artifacts"] == [{"kind": "upstream_source", "url": "https://github.com/z/z/archive/v(2).tar.gz", "filename": None, "checksums": ["sha512:ab"]}]
    assert row["default_options"] == {"compat": "enabled"} and row["versions"][1]["artifacts"] is None


def test_conan_spack_meson(spark):
    pytest.importorskip("yaml")
    recipe = "class ZConan:\n    name = 'z'\n    license = 'Zlib'\n    homepage = 'https://github.com/z/z'\n    options = {'shared': [True]}\n    default_options = {'shared': False}\n    def requirements(self):\n        self.requires('zlib/1.3')\n        self.tool_requires('cmake/[>=3]')\n"
    files = {"recipes/z/config.yml": "versions:\n  '2.3':\n    folder: all\n", "recipes/z/all/conanfile.py": recipe, "recipes/z/all/conandata.yml": "sources:\n  '2.3':\n    url: https://x.org/z.tgz\n    sha256: ABC\n"}
    (row,) = parsed(spark, "conan", files)
    assert row["dependencies"] == ["zlib", "cmake"] and row["default_options"] == {"shared": "false"} and row["versions"][0]["artifacts"][0]["checksums"] == ["sha256:abc"]
    spack = {f"packages/{n}/package.py": f"class P(Package):\n    '''Doc.'''\n    version('1', sha256='AB', deprecated=True)\n    depends_on('{d}')\n    variant('v', default=True)\n" for n, d in (("_3d_x", "cmake@3:"), ("py_a", "b"), ("c", "py-setuptools@1"))}
    (row,) = parsed(spark, "spack", spack)
    assert (row["name"], row["dependencies"], row["versions"][0]["lifecycle"], row["default_options"]) == ("3d-x", ["cmake"], "deprecated", {"v": "true"})
    meson = {"subprojects/z.wrap": "[wrap-file]\ndirectory = z-2.3\nsource_url = https://github.com/z/z/a.tgz\nsource_hash = AB\n[provide]\ndependency_names = z, zz\n", "releases.json": json.dumps({"z": {"versions": ["2.3-2", "1.0-1"]}})}
    (row,) = parsed(spark, "meson", meson)
    assert row["options"] == ["z", "zz"] and [(v["version"], v["revision"], len(v["artifacts"])) for v in row["versions"]] == [("2.3", "2", 2), ("1.0", "1", 1)]


def test_bazel_cppget_hunter_xmake(spark):
    bazel = {"modules/z/metadata.json": json.dumps({"versions": ["1.0.bcr.2", "9"], "repository": ["github:z/z"], "maintainers": [{"name": "A", "github": "a"}, {"email": "e"}], "yanked_versions": {"1.0.bcr.2": "bad"}}), "modules/z/1.0.bcr.2/source.json": json.dumps({"url": "https://x/z", "integrity": "sha256-AAEC"}), "modules/z/1.0.bcr.2/MODULE.bazel": "DEV = True\nmodule(name='z')\nbazel_dep(name='a', version='1')\nbazel_dep(name='t', dev_dependency=DEV)\n"}
    (row,) = parsed(spark, "bazel", bazel)
    v = row["versions"][0]
    assert (v["version"], v["revision"], v["lifecycle"], v["dependencies"], v["artifacts"][0]["checksums"]) == ("1.0", "2", "yanked", ["a"], ["sha256:000102"])
    assert row["maintainers"] == ["A (@a)", "e"] and row["repository_url"] == "https://github.com/z/z" and len(row["versions"]) == 1
    text = ": 1\nname: z\nversion: 1\nlicense: MIT\ndescription:\\\nlong\ntext\n\\\ndepends: * build2 >= 1\ndepends: {a b} == 2\nlocation: z.tgz\nsha256sum: AB\n:\nname: z\nversion: 2\nsummary: short\\\n more\n".replace("description:\\\n", "description: \\\n")
    (row,) = parsed(spark, "cppget", {"stable/packages.manifest": text, "beta/packages.manifest": ": 1\nname: z\nversion: 2\nurl: https://github.com/z/z\n"})
    assert row["dependencies"] == ["build2", "a", "b"] and [(v["version"], v["channel"]) for v in row["versions"]] == [("1", "stable"), ("2", "stable"), ("2", "beta")] and row["homepage"] == "https://github.com/z/z"
    hunter = {"cmake/projects/Z/hunter.cmake": '#[[ note ]]\nhunter_add_version(PACKAGE_NAME Z VERSION "1\\"0" URL [=[https://github.com/z/z/a]=] SHA1 AB)', "cmake/configs/default.cmake": "hunter_default_version(Z VERSION 1)"}
    (row,) = parsed(spark, "hunter", hunter)
    assert (row["default_version"], row["versions"][0]["version"], row["versions"][0]["artifacts"][0]["checksums"]) == ("1", '1"0', ["sha1:ab"])
    data = {"packages": [{"name": "z", "description": "d", "urls": ["git+https://github.com/z/z.git"], "versions": [{"version": "1", "source_urls": ["https://x/z"], "checksums": ["sha256:a"]}]}], "skipped": ["y"]}
    (row,) = parsed(spark, "xmake", {"export.json": json.dumps(data)})
    assert row["repository_url"] == "https://github.com/z/z" and row["versions"][0]["artifacts"][0]["checksums"] == ["sha256:a"]
    with pytest.raises(ValueError, match="unknown registry"):
        registries.parse(spark.createDataFrame([], "path string, text string"), "nope")
    assert parsed(spark, "vcpkg", {"README": "x"}) == []


def test_grammar_errors():
    assert grammars.recipe_class("class (").attributes == {} and grammars.first_call("vcpkg_from_git(", {"vcpkg_from_git"}) == ("", "")
    for bad in ("x", " a: b", "k: \\\nopen"):
        with pytest.raises(ValueError):
            list(grammars.manifests(bad))
    for bad in ("a(b", "a(b))"):
        with pytest.raises(ValueError):
            list(grammars.cmake_commands(bad))
    assert list(grammars.cmake_commands("if(a (b c)) # (\n")) == [("if", ["a", "(", "b", "c", ")"])]


def test_checkout(spark, tmp_path):
    (tmp_path / "ports/z").mkdir(parents=True)
    (tmp_path / "ports/z/vcpkg.json").write_text('{"name": "z", "version": "1"}')
    assert [r["id"] for r in registries.parse(registries.checkout(spark, str(tmp_path)), "vcpkg").collect()] == ["vcpkg:z"]


RSS = """<rss xmlns:dc='http://purl.org/dc/elements/1.1/' xmlns:a='http://www.w3.org/2005/Atom'><channel>
<item><title>T</title><a:link rel='alternate' href='https://x/1'/><pubDate>d</pubDate><category>A</category><dc:subject>B</dc:subject><category>A</category></item>
<item><title></title><link>https://x/2</link></item></channel></rss>"""
ATOM = """<feed xmlns='http://www.w3.org/2005/Atom' xmlns:m='http://search.yahoo.com/mrss/'><entry><id>i</id><title>T</title><link rel='alternate' href='u'/><published>p</published>
<category term='t' label='L'/><category scheme='http://schemas.google.com/g/2005#kind' term='x'/><content>body</content><m:group><m:keywords>k, L</m:keywords><m:thumbnail url='pic'/></m:group></entry></feed>"""


def test_feeds(spark):
    rows = feeds.read_feeds(spark.createDataFrame([("r", RSS), ("a", ATOM), ("bad", "<x"), ("n", None)], "source string, document string")).orderBy("source").collect()
    assert [(r["source"], r["id"], r["url"], r["tags"], r["description"], r["thumbnail_url"]) for r in rows] == [("a", "i", "u", ["L", "k"], "body", "pic"), ("r", "https://x/1", "https://x/1", ["A", "B"], "", "")]


def test_calendars(spark):
    text = (
        "BEGIN:VEVENT\r\nUID:1\r\nDTSTART;TZID=Europe/Berlin:20260301T190000\r\nDTEND;TZID=Europe/Berlin:20260301T210000\r\nSUMMARY:A\\, b\\nc\\\\n\r\nORGANIZER;CN=\"Me: you\":mailto:x\r\nLOC\r\n ATION:here\r\nEND:VEVENT\r\n"
        "BEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20260110\r\nDTEND;VALUE=DATE:20260112\r\nSUMMARY:days\r\nSTATUS:odd\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:no start\r\nEND:VEVENT\r\n"
        "BEGIN:VEVENT\r\nDTSTART:20260201T230000Z\r\nSUMMARY:utc\r\nEND:VEVENT\r\n"
    )
    rows = feeds.read_calendars(spark.createDataFrame([("s", text, "Europe/Berlin")], "source string, document string, timezone string")).collect()
    assert [(r["title"], str(r["start_date"]), str(r["end_date"]), r["start_time"], r["timezone"]) for r in rows] == [
        ("days", "2026-01-10", "2026-01-11", None, ""), ("utc", "2026-02-02", "2026-02-02", "00:00:00", "Europe/Berlin"), ("A, b\nc\\n", "2026-03-01", "2026-03-01", "19:00:00", "Europe/Berlin")]
    assert rows[2]["organizer"] == "Me: you" and rows[2]["location"] == "here" and rows[0]["status"] == "confirmed"


PAGE = """<html><head><title> A  b </title><meta property="og:title" content="x"><meta name='og:title' content='y'><meta content="d" name="Description">
<link rel="icon" href="/s.png" sizes="16x16"><link rel="icon" href="/l.png" sizes="64x64"><link rel="apple-touch-icon" href="/t.png"></head><script>var data = {"a": {"b": 1}};</script></html>"""


def test_pages(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(PAGE,), ("",)], "p string")
    row = frame.select(feeds.meta_values(F.col("p")).alias("m"), feeds.title(F.col("p")).alias("t"), feeds.favicon(F.col("p")).alias("i"), F.get_json_object(feeds.embedded_json(F.col("p"), "data"), "$.a.b").alias("j")).collect()
    assert (row[0]["m"], row[0]["t"], row[0]["i"], row[0]["j"]) == ({"og:title": "y", "description": "d"}, "A b", "/t.png", "1")
    assert (row[1]["m"], row[1]["t"], row[1]["i"], row[1]["j"]) == ({}, "", "", None)
