import random

import numpy as np
import pytest

from catalith.llm import linkage
from catalith.llm.labelmodel import LabelModel

SCHEMA = "package_id string, registry string, repository_url string, homepage string, artifacts array<struct<kind:string,url:string,checksums:array<string>>>, extra string"
TOPICS = {"mesh", "json"}


def test_names():
    same = {linkage.split_name(n, TOPICS) for n in ("libgoruma", "goruma-cpp", "gorumacxx", "cpp-goruma", "goruma2", "goruma")}
    assert same == {("goruma", "")}
    assert {linkage.split_name(n, TOPICS) for n in ("goruma_mesh", "gorumamesh", "mesh-goruma", "libgoruma.mesh-cpp")} == {("goruma", "mesh")}
    assert linkage.split_name("json", TOPICS) == ("json", "")


def test_addresses(spark):
    forms = ["https://forge.example/O/n.git", "git@forge.example:o/n.git", "git+https://www.forge.example/o/n/tree/main", " ssh://git@forge.example/o/n/#readme", "git://forge.example:9418/o/n/"]
    frame = spark.createDataFrame([(f,) for f in forms], "u string")
    assert {r["a"] for r in frame.select(linkage.address(linkage.F.col("u")).alias("a")).collect()} == {"forge.example/o/n"}


def test_label_model_learns_accuracies():
    rnd = np.random.default_rng(1)
    truth = rnd.random(4000) < 0.4
    votes = np.stack([np.where(rnd.random(4000) < acc, truth, ~truth) * 2 - 1 for acc in (0.95, 0.9, 0.85, 0.6)], axis=1)
    votes[rnd.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(np.column_stack([votes, votes[:, :1]]), axis=0, return_counts=True)  # the last copies the first
    model = LabelModel(5).fit(patterns, counts.astype(float))
    post = model.posterior(np.column_stack([votes, votes[:, :1]]))
    seen = votes[:, :3].any(axis=1)
    assert ((post > 0.5) == truth)[seen].mean() > 0.88
    assert any(set(f) == {0, 4} for f in model.factors)


def source(url, *sums):
    return ("upstream_source", url, list(sums) or None)


def test_pairs(spark, rows):
    digest = "ab" * 32
    data = []
    for i in range(30):  # a body of plain matches and of unrelated packages that share an owner's page
        for reg in ("conan", "vcpkg"):
            data.append((f"{reg}:proj{chr(97 + i % 26)}xyz{i // 26}ka", reg, f"https://forge.example/o{i}/proj{i}", f"https://docs.o{i}.example/proj{i}", [source(f"https://forge.example/o{i}/proj{i}/archive/1.tgz", f"sha256:{i:064x}")], None))
        data.append((f"spack:lonely{chr(97 + i % 26)}uvw{i // 26}mo", "spack", f"https://gitb.example/p{i % 5}/lone{i}", f"https://owner{i % 5}.example/", None, None))
    data += [
        ("conan:zoruta", "conan", None, None, [source(None, f"SHA256={digest}")], "x"), (" VCPKG:libzoruta", "vcpkg", None, "none", [source("https://a.example/z.tgz", digest)], "y"),
        ("spack:zoruta-cpp", "spack", None, None, [source("https://a.example/z.tgz", None)], None), ("bazel:zoruta", "bazel", "https://forge.example/else/zoruta", None, None, None),
        ("conan:kubira-mesh", "conan", "https://forge.example/k/kubira", None, None, None), ("vcpkg:kubira_json", "vcpkg", "git@forge.example:k/kubira.git", None, None, None),
        ("spack:kubirajson", "spack", "https://forge.example/k/kubira", None, None, None), ("bazel:patched", "bazel", None, None, [("patch", "https://p.example/a.diff", [digest])], None),
        (None, "conan", None, None, None, None), ("conan:", "conan", "", "", [], None),
    ]
    data += [(f"hunter:filler{i}-{t}", "hunter", f"https://forge.example/f/fil{i}{t}", None, None, None) for i in range(10) for t in ("mesh", "json")]
    frame = spark.createDataFrame(data, SCHEMA).union(spark.createDataFrame(data[:5], SCHEMA))
    scored, known = linkage.link_packages(frame)
    links = {(r["package_a"], r["package_b"]) for r in linkage._links(scored).collect()}
    assert ("conan:zoruta", "vcpkg:libzoruta") in links and ("spack:zoruta-cpp", "vcpkg:libzoruta") in links and ("spack:kubirajson", "vcpkg:kubira_json") in links
    assert not any("bazel" in a + b for a, b in links) and not any("kubira-mesh" in a + b for a, b in links) and not any("lonely" in a for a, _ in links)
    assert sum(a.startswith("conan:proj") for a, _ in links) == 30
    empty, _ = linkage.link_packages(frame.limit(0))
    assert empty.count() == 0


def grouped(pairs):
    """Components of pairs, as sorted lists."""
    at = {}
    for a, b in pairs:
        x, y = at.setdefault(a, {a}), at.setdefault(b, {b})
        if x is not y:
            x |= y
            for m in y:
                at[m] = x
    return sorted(sorted(g) for g in {id(g): g for g in at.values()}.values())


def mixed(seed):
    """Packages with stems, topics, repositories, pages and sources in random company; one repository, one page and one url are hot."""
    rnd = random.Random(seed)
    data = []
    for i in range(160):
        stem = rnd.choice("bdfgk") + rnd.choice("aeiou") + "ruka" + rnd.choice("mnp") + "a"
        name = stem + rnd.choice(["", "", "-mesh", "_json", "2"])
        repo = rnd.choice([None, "https://forge.example/hot/all", f"https://forge.example/o{rnd.randrange(30)}/p"])
        page = rnd.choice([None, None, "https://family.example/", f"https://docs.o{rnd.randrange(20)}.example/{stem}"])
        sources = rnd.choice([None, [source("https://a.example/hot.tgz")], [source(f"https://a.example/{rnd.randrange(40)}.tgz", f"{rnd.randrange(30) + 1:064x}")]])
        data.append((f"{rnd.choice(['conan', 'vcpkg', 'spack', 'xmake'])}:{name}", "x", repo, page, sources, None))
    data += [(f"hunter:filler{i}-{t}", "hunter", f"https://forge.example/f/fil{i}", None, None, None) for i in range(10) for t in ("mesh", "json")]
    return data


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_representatives_lose_no_connection(spark, seed):
    """Whatever one shared piece links among all pairs is connected through representatives, and nothing else than all pairs connect."""
    rows = spark.createDataFrame(mixed(seed), SCHEMA)
    scratch = linkage.Scratch(spark, "test")
    found, known, scored, model = linkage._linked(rows, scratch)
    held = found.join(known.select("pid", "n"), "pid")
    every = held.select("kind", "key", linkage.F.col("n").alias("a")).join(held.select("kind", "key", linkage.F.col("n").alias("b")), ["kind", "key"]).where("a < b").select("a", "b").distinct()
    brute, _ = linkage.score(linkage.votes_on(every, found, known), model)
    links = lambda df: grouped((r["a"], r["b"]) for r in linkage._links(df).collect())
    votes = linkage.votes_on(every, found, known)
    kinds = [votes.where(f"{k} = 1").select("a", "b", *[linkage.F.lit(int(f == k)).alias(f) if f in linkage._EVIDENCE and f not in ("repository", "page") else linkage.F.when(linkage.F.lit(f != k) & (linkage.F.col(f) == 1), -1).otherwise(linkage.F.col(f)).alias(f) for f in linkage.FUNCTIONS]) for k in linkage._EVIDENCE]
    single = [tuple(r) for one in kinds for r in linkage._links(linkage.score(one, model)[0]).select("a", "b").collect()]
    within = lambda fine, coarse: all(any(set(g) <= set(c) for c in coarse) for g in fine)
    assert within(grouped(single), links(scored)) and within(links(scored), links(brute)) and len(grouped(single)) > 5
    # a representative pair's votes are those that the pair itself has
    own = {(r["a"], r["b"]): r for r in brute.collect()}
    for r in scored.collect():
        full = own[r["a"], r["b"]]
        assert all(r[k] <= full[k] for k in linkage._EVIDENCE) and (r["name"], r["topic"]) == (full["name"], full["topic"])
    assert scored.groupBy("a", "b").count().where("count > 1").isEmpty()


def test_topics_at_any_size(spark):
    """Components of one repository teach topics in the smallest table; unrelated names don't."""
    data = [("conan:zoruta-mesh", "conan", "https://forge.example/z/zoruta", None, None, None), ("conan:zoruta-json", "conan", "https://forge.example/z/zoruta", None, None, None), ("vcpkg:other-name", "vcpkg", "https://forge.example/z/zoruta", None, None, None), ("conan:ab-cpp", "conan", "https://forge.example/z/ab", None, None, None), ("conan:ab", "conan", "https://forge.example/z/ab", None, None, None)]
    found = linkage.evidence(spark.createDataFrame(data, SCHEMA))
    assert linkage.name_parts(found, found.select("pid").distinct()) == {"mesh", "json"}


def test_confidence_of_every_pair(spark, rows, tmp_path):
    digest = "ab" * 32
    data = [(f"{reg}:{'bdfgk'[i % 5]}{'aeiou'[i // 5]}ruka", reg, f"https://forge.example/o{i}/p{i}", None, [source(f"https://a.example/{i}.tgz", f"{i:064x}")], None) for i in range(25) for reg in ("conan", "vcpkg")]
    data += [
        ("conan:zoruta", "conan", None, None, [source(None, digest)], None), ("vcpkg:libzoruta", "vcpkg", None, None, [source("https://a.example/z.tgz", digest)], None),
        ("spack:zoruta-cpp", "spack", None, None, [source("https://a.example/z.tgz")], None),
    ]
    many = [f"{reg}:{name}" for reg, name in zip(("bazel", "conan", "cppget", "hunter", "meson", "spack", "vcpkg", "xmake"), ("bako", "dimu", "fose", "gati", "hune", "jopa", "kelo", "luri"), strict=True)]
    data += [(p, p.split(":")[0], "https://forge.example/shared/all", None, None, None) for p in many]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "package_versions.parquet"))
    scored = {r[:2]: r for r in rows(linkage.p5_confidence(spark, str(tmp_path)))}
    found = set(rows(linkage.p5_found(spark, str(tmp_path))))
    assert ("conan:zoruta", "spack:zoruta-cpp") in found and found == set(scored)
    assert all(0 <= r[3] <= r[2] <= 1 and r[2] >= linkage.CONFIDENT for r in scored.values())
    kept = {(r["package_a"], r["package_b"]): round(r["confidence"], 6) for r in linkage._links(linkage.link_packages(spark.read.parquet(str(tmp_path / "package_versions.parquet")))[0]).collect()}
    assert kept and all(scored[k][2] >= kept[k] for k in scored if k in kept)
