"""Packages of different registries that package one upstream project.

Each package is reduced to hashed pieces of evidence: addresses of repositories,
project pages, and urls and checksums of upstream sources (never of patches or of
the registry's own files).  Within a piece, packages whose votes can't differ form
a class: equal name stem, topic and flags.  Every package is paired with the
representatives of the classes of its stem, and with two representatives, of
different stems, of the classes of other stems.  If one shared piece makes two
packages a link, their pairs with the representatives are links too, since these
have the same votes or more, so a piece that a third of all packages share costs a
few rows a package and loses no connection.  (Two packages that only several weak
pieces together would link are compared if one of them is a representative.)

Matching functions vote on each candidate; a generative label model learns their
accuracies and correlations from the counts of the vote patterns, beside as many
pairs of strangers, and gives each candidate a confidence.  Confident links are consolidated into projects, and the
pairs of different registries within a project are the matches.

Components kept in one repository are told apart by the topic in their names.
Topics are learned: a name part is one if repositories hold packages of one
registry whose names differ in that part only, or if it goes with many others.

Defined cases: null, reserved and placeholder addresses and checksums are no
evidence; a package without evidence matches nothing; repeated rows count once;
rows of one clean package_id are one package, also if its registry is spelled
unevenly (the part before the colon counts).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm.groups import consolidate
from catalith.llm.labelmodel import LabelModel
from catalith.llm.survivors import usable_address
from catalith.util import Scratch, broadcast_if_small, clean_id, table

#: A name part is a topic if it goes with so many others, and with this share of all packages;
#: or if it tells packages apart in this share of the repositories in which names do so.
TOPIC_PARTNERS, TOPIC_SHARE, TOPIC_REPOSITORIES = 8, 0.0005, 0.0005
#: Confidence of a link.
CONFIDENT = 0.5
# Parts of a name that say language or edition and nothing about the project.
LANGUAGE_PARTS = ("cpp", "cxx", "cc", "c", "lib", "library", "2", "3")

FUNCTIONS = ["checksum", "url", "repository", "page", "family", "slug", "name", "topic"]
_EVIDENCE = {"checksum": 1, "url": 2, "repository": 3, "page": 4, "family": 5, "slug": 6}


def address(c: Column) -> Column:
    """Host and path of an address in one spelling: without scheme, user, www, query, view and suffix."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"^(?:scm:)?(?:git\+)?(?:[a-z][a-z0-9+.-]*://)?(?:[^@/\s]+@)?(?:www\.)?", "")
    s = F.regexp_replace(s, r"^([^/:?#\s]+):(?:\d+(?=/|$)/?|/?)", "$1/")
    s = F.regexp_replace(s, r"[?#].*$", "")
    return F.regexp_replace(s, r"(?:/(?:-/)?(?:tree|blob|wiki|issues|releases)(?:/.*)?|\.git|/index\.html?|/)*$", "")


def _checksum(c: Column) -> Column:
    """The digits of a checksum in any notation, '' for none and for placeholders."""
    digits = F.regexp_extract(F.lower(c), r"([0-9a-f]{32,128})", 1)
    return F.when(digits.rlike(r"^(.)\1{24,}"), "").otherwise(digits)


def evidence(rows: DataFrame) -> DataFrame:
    """(pid, kind, key): the distinct hashed pieces of evidence of every package."""
    real = lambda c: F.when(usable_address(c), address(c))
    rows = rows.select(
        clean_id("package_id").alias("pid"), real(F.col("repository_url")).alias("repo"), real(F.col("homepage")).alias("home"),
        F.filter("artifacts", lambda a: F.lower(F.trim(a["kind"])) == "upstream_source").alias("sources"))
    name = F.regexp_replace(F.substring_index("pid", ":", -1), r"[^a-z0-9]+", "")
    rows = rows.where("pid <> ''").withColumns({"name": name, "label": F.regexp_extract("home", r"^(?:docs\.|doc\.|wiki\.)?([^./]+)", 1)})
    sources = rows.select("pid", F.explode("sources").alias("a"))
    sources = sources.select("pid", real(F.col("a.url")).alias("url"), F.transform(F.coalesce("a.checksums", F.array().cast("array<string>")), _checksum).alias("sums"))
    piece = lambda kind, key: F.struct(F.lit(_EVIDENCE[kind]).cast("tinyint").alias("kind"), key.alias("key"))
    segments = lambda c: F.size(F.split(c, "/")) - 1
    slug = lambda c: F.regexp_replace(F.regexp_extract(c, r"^[^/]+/([^/]+(?:/[^/]+)?)$", 1), "/", "-")
    repo, home = F.col("repo"), F.col("home")
    # a page on a host of its own is the project's; one below a shared host is only named like the package
    plain = F.regexp_replace("label", r"[^a-z0-9]+", "")
    own = (F.length(plain) >= 4) & (F.col("name").contains(plain))
    hosted = (F.size(F.split(home, r"\.")) >= 3) & (plain == F.col("name"))
    of_row = F.array(
        piece("repository", F.when(segments(repo) >= 2, repo)), piece("repository", F.when(segments(home) >= 2, home)),
        piece("slug", F.when(segments(repo).between(1, 2), slug(repo))),
        piece("page", F.when((segments(home) == 1) | ((segments(home) == 0) & own & ~hosted), home)),
        piece("family", F.when((segments(home) == 0) & ~own & ~hosted, home)))
    archive = F.regexp_extract(F.col("url"), r"^([^/]+/[^/]+/[^/]+)/(?:-/)?(?:archive|releases|tarball|zipball)/", 1)
    of_source = F.concat(
        F.array(piece("url", F.when(segments(F.col("url")) >= 1, F.col("url"))), piece("repository", F.when(archive != "", archive)), piece("slug", F.when(archive != "", slug(archive)))),
        F.transform("sums", lambda s: piece("checksum", F.when(s != "", s))))
    said = lambda e: e["key"].isNotNull() & (e["key"] != "")
    both = rows.select("pid", F.explode(F.filter(of_row, said)).alias("e")).unionByName(sources.select("pid", F.explode(F.filter(of_source, said)).alias("e")))
    return both.select("pid", F.col("e.kind").alias("kind"), F.xxhash64("e.kind", "e.key").alias("key")).distinct()


def split_name(name: str, topics: set[str]) -> tuple[str, str]:
    """(stem, topic) of a package name: what is left without language parts, and its topic."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name.lower()) if p]
    core = [p for p in parts if p not in LANGUAGE_PARTS] or parts
    found = [p for p in core if p in topics]
    rest = [p for p in core if p not in topics] or core
    topic = found[0] if found and rest != core else ""
    stem = "".join(rest)
    while len(stem) > 6 and stem.startswith("lib"):
        stem = stem[3:]
    stem = re.sub(r"(?<=.{4})(?:cpp|cxx|\d)$", "", stem)
    stem = re.sub(r"^(?:cpp|cxx)(?=.{4})", "", stem)
    if not topic:
        topic = next((stem[n:] for n in range(4, len(stem)) if stem[n:] in topics), "")
        stem = stem[: len(stem) - len(topic)]
    return stem, topic


def _parts(pid: str) -> Column:
    """The distinct parts of a package's name that may be topics."""
    return F.array_distinct(F.filter(F.split(F.substring_index(pid, ":", -1), r"[^a-z0-9]+"), lambda p: (F.length(p) >= 3) & ~p.isin(*LANGUAGE_PARTS)))


def name_parts(found: DataFrame, names: DataFrame) -> set[str]:
    """Topics among the parts of package names.

    Both thresholds are shares, so the result stays bounded at any size.
    """
    parts = names.select("pid", _parts("pid").alias("parts")).where("size(parts) > 1")
    pairs = parts.select(F.explode("parts").alias("part"), "parts").select("part", F.explode("parts").alias("other")).where("part <> other")
    least = max(TOPIC_PARTNERS, int(TOPIC_SHARE * names.count()))
    heard = pairs.distinct().groupBy("part").count().where(F.col("count") >= least).select("part")
    inside = found.where(F.col("kind") == _EVIDENCE["repository"]).select("key", F.substring_index("pid", ":", 1).alias("registry"), _parts("pid").alias("parts")).where("size(parts) > 1")
    inside = inside.select("key", "registry", F.explode("parts").alias("part"), "parts")
    rest = F.array_join(F.array_sort(F.array_remove("parts", F.col("part"))), "-")
    inside = inside.select("key", "registry", rest.alias("rest"), "part").distinct()
    place = ["key", "registry", "rest"]
    several = inside.groupBy(*place).agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select(*place)
    told = inside.join(several, place, "left_semi").groupBy("part").agg(F.count_distinct("key").alias("repositories"))
    told = told.where(F.col("repositories") >= F.greatest(F.lit(1), F.floor(F.lit(TOPIC_REPOSITORIES) * F.lit(several.select("key").distinct().count())))).select("part")
    return {r["part"] for r in heard.unionByName(told).distinct().toLocalIterator()}


def packages(found: DataFrame) -> DataFrame:
    """One row per package with evidence: its number, names and what decides its votes.

    ``topic``: hash of the topic, 0 for none, 1 for a component without topic beside
    others of its stem; ``flags``: 1 for a repository, 2 for a page.
    """
    has = lambda k: F.max(F.col("kind") == _EVIDENCE[k]).cast("int")
    held = found.groupBy("pid").agg((has("repository") + 2 * has("page")).alias("flags"))
    topics = name_parts(found, held)

    @F.pandas_udf("stem string, topic string")
    def split(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_name(n, topics) for n in s], columns=["stem", "topic"])

    known = held.select("pid", "flags", F.substring_index("pid", ":", 1).alias("registry"), split(F.substring_index("pid", ":", -1)).alias("n")).select("pid", "flags", "registry", "n.stem", "n.topic")
    known = Scratch(found.sparkSession, "names").keep(known, "names")
    inside = found.where(F.col("kind") == _EVIDENCE["repository"]).join(known.select("pid", "stem", "topic"), "pid")
    many = inside.where("topic <> ''").groupBy("key", "stem").agg(F.min("topic").alias("low"), F.max("topic").alias("high")).where("low <> high").select("key", "stem")
    unclear = inside.where("topic = ''").join(many, ["key", "stem"], "left_semi").select("pid", F.lit(True).alias("unclear")).distinct()
    topic = F.when(F.col("topic") != "", F.xxhash64("topic")).when(F.col("unclear"), 1).otherwise(0)
    both = known.join(unclear, "pid", "left")
    return both.select(F.monotonically_increasing_id().alias("n"), "pid", "registry", F.when(F.col("stem") != "", F.xxhash64("stem")).alias("stem"), topic.alias("topic"), "flags")


_PLAIN, _UNCLEAR = 0, 1
_FLAGS = range(4)


def _stars(pieces: DataFrame, by: list[str], stems: bool) -> DataFrame:
    """Members of a piece paired with the representatives of its classes.

    A member meets the classes of its own topic and, unless it is unclear, the
    classes without topic; one without topic meets those of all topics.  With
    ``stems`` each class has two representatives, those of the least and the
    greatest stem, and pairs of one stem are left out.
    """
    real = ~F.col("topic").isin(_PLAIN, _UNCLEAR)
    # circle: members of one topic (or the unclear ones), and the members with and without topic together (0)
    circles = F.when(real, F.array(F.col("topic"), F.lit(0).cast("long"))).otherwise(F.array("topic"))
    rows = pieces.withColumn("circle", F.explode(circles))
    side = F.when(F.col("circle") == 0, real.cast("int")).otherwise(2)  # 0 without topic, 1 with, 2 alike
    rows = rows.withColumn("side", side)
    place = [*by, "circle"]
    picks = []
    for s in (0, 1, 2):
        for f in _FLAGS:
            here = (F.col("side") == s) & (F.col("flags") == f)
            if stems:
                picks += [F.min(F.when(here, F.struct("stem", "n"))).alias(f"low_{s}_{f}"), F.max(F.when(here, F.struct("stem", "n"))).alias(f"high_{s}_{f}")]
            else:
                picks.append(F.min(F.when(here, F.col("n"))).alias(f"low_{s}_{f}"))
    heads = rows.groupBy(*place).agg(F.count("*").alias("members"), *picks).where("members > 1").drop("members")

    def met(s: int) -> list[Column]:
        """The representatives of side ``s`` as (n, flags, topic vote, stem)."""
        vote = F.when(F.lit(s) == 2, F.when(F.col("circle") == _UNCLEAR, 0).otherwise(1)).otherwise(0)
        ends = ("low", "high") if stems else ("low",)
        of = lambda e, f: F.col(f"{e}_{s}_{f}")
        n, stem = (lambda c: c["n"]) if stems else (lambda c: c), (lambda c: c["stem"]) if stems else (lambda c: F.col("stem"))
        return [F.when(of(e, f).isNotNull(), F.struct(n(of(e, f)).alias("n"), F.lit(f).alias("flags"), vote.alias("vote"), stem(of(e, f)).alias("stem"))) for e in ends for f in _FLAGS]

    # with topic, the members of other topics aren't met: they vote against each other
    mine = F.when(F.col("side") == 2, F.array(*met(2))).when(F.col("side") == 1, F.array(*met(0))).otherwise(F.array(*met(0), *met(1)))
    pairs = rows.join(heads, place).select("kind", "n", "stem", "flags", F.explode(F.array_distinct(F.array_compact(mine))).alias("r"))
    pairs = pairs.where(F.col("n") != F.col("r.n"))
    if stems:
        pairs = pairs.where(~F.col("stem").eqNullSafe(F.col("r.stem")))
    both = lambda bit: (F.col("flags").bitwiseAND(bit) > 0) & (F.col("r.flags").bitwiseAND(bit) > 0)
    return pairs.select(
        F.least("n", "r.n").alias("a"), F.greatest("n", "r.n").alias("b"), "kind", (both(1).cast("int") + 2 * both(2).cast("int")).alias("both"),
        F.lit(-1 if stems else 1).alias("name"), F.col("r.vote").alias("topic"))


def candidates(found: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, votes): pairs of package numbers that share evidence, also under different stems."""
    facts = known.select("n", "pid", "stem", "topic", "flags")
    shared = found.groupBy("kind", "key").count().where("count > 1").select("kind", "key")
    pieces = found.join(shared, ["kind", "key"], "left_semi").join(facts, "pid").select("kind", "key", "n", "stem", "topic", "flags")
    mixed = pieces.groupBy("kind", "key").agg(F.min("stem").alias("low"), F.max("stem").alias("high")).where("low <> high").select("kind", "key")
    mixed = pieces.join(broadcast_if_small(mixed), ["kind", "key"], "left_semi")
    pairs = _stars(pieces.where("stem IS NOT NULL"), ["kind", "key", "stem"], False).unionByName(_stars(mixed, ["kind", "key"], True))
    votes = [F.max(F.col("kind") == n).cast("int").alias(k) for k, n in _EVIDENCE.items()]
    return _voted(pairs.groupBy("a", "b").agg(*votes, F.max("both").alias("both"), F.max("name").alias("name"), F.max("topic").alias("topic")))


def _voted(shared: DataFrame) -> DataFrame:
    """Pairs a, b and the evidence they share, with the votes of all functions."""
    differ = lambda k, bit: F.when(F.col(k) == 1, 1).when(F.col("both").bitwiseAND(bit) > 0, -1).otherwise(0).alias(k)
    return shared.select("a", "b", "checksum", "url", differ("repository", 1), differ("page", 2), "family", "slug", "name", "topic")


def votes_on(pairs: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """The votes of all functions on given pairs (a, b) of package numbers."""
    side = lambda c: known.select(F.col("n").alias(c), F.struct("stem", "topic", "flags").alias(f"{c}_is"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    real = lambda c: ~c.isin(_PLAIN, _UNCLEAR)
    s, t = F.col("a_is"), F.col("b_is")
    topic = F.when(real(s["topic"]) & real(t["topic"]), F.when(s["topic"] == t["topic"], 1).otherwise(-1)).when((s["topic"] == _UNCLEAR) != (t["topic"] == _UNCLEAR), -1).otherwise(0)
    name = F.when(s["stem"] == t["stem"], 1).otherwise(-1)
    rows = rows.select("a", "b", s["flags"].bitwiseAND(t["flags"]).alias("both"), name.alias("name"), topic.alias("topic"))
    held = found.join(known.select("n", "pid"), "pid").select("n", "kind", "key")
    common = pairs.join(held.withColumnRenamed("n", "a"), "a").join(held.withColumnRenamed("n", "b"), ["b", "kind", "key"])
    common = common.groupBy("a", "b").agg(*[F.max(F.col("kind") == n).cast("int").alias(k) for k, n in _EVIDENCE.items()])
    return _voted(rows.join(common, ["a", "b"], "left").fillna(0, list(_EVIDENCE)))


def strangers(known: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(patterns, shares): how the functions vote on any two packages, from the counts of all.

    Two packages drawn from all share no evidence and no stem, but may have
    repositories, pages and topics; only these counts reach the driver, at most
    four for each topic.
    """
    counted = known.groupBy("topic", "flags").count().collect()
    total, shares = sum(r["count"] for r in counted), Counter()
    by_topic: dict[int, np.ndarray] = {}
    for r in counted:
        by_topic.setdefault(r["topic"], np.zeros(len(_FLAGS)))[r["flags"]] += r["count"] / total
    none = np.zeros(len(_FLAGS))
    plain, unclear = by_topic.pop(_PLAIN, none), by_topic.pop(_UNCLEAR, none)
    real = sum(by_topic.values(), none)
    silent = np.outer(plain, plain) + np.outer(plain, real) + np.outer(real, plain) + np.outer(unclear, unclear)
    alike = sum((np.outer(t, t) for t in by_topic.values()), np.zeros((len(_FLAGS), len(_FLAGS))))
    for topic, share in ((0, silent), (1, alike)):  # pairs whose topics differ take no part
        for f in _FLAGS:
            for g in _FLAGS:
                if share[f, g] > 0:
                    shares[-(f & g & 1), -((f & g) >> 1), topic] += share[f, g]
    if not shares:
        return None
    rows = [[{"repository": r, "page": p, "name": -1, "topic": t}.get(f, 0) for f in FUNCTIONS] for r, p, t in shares]
    return np.array(rows, dtype=np.int64), np.array(list(shares.values()))


def score(votes: DataFrame, model: LabelModel | None = None, known: DataFrame | None = None) -> tuple[DataFrame, LabelModel | None]:
    """(``votes`` with the confidence of each pair, model): by a label model, fitted on their patterns if none is given.

    Beside the candidates the fit sees as many pairs of strangers among ``known``.
    """
    counted = votes.groupBy(*FUNCTIONS).count().collect()  # at most 3 ** len(FUNCTIONS) rows
    if not counted:
        return votes.withColumn("confidence", F.lit(0.0)), model
    patterns = np.array([[r[f] for f in FUNCTIONS] for r in counted], dtype=np.int64)
    # components of one repository are different by definition: they'd teach the functions that sharing means nothing
    open_ = patterns[:, FUNCTIONS.index("topic")] >= 0
    if model is None:
        counts = np.array([r["count"] for r in counted], dtype=float)[open_]
        apart = strangers(known) if known is not None else None
        model = LabelModel(len(FUNCTIONS)).fit(patterns[open_], counts, apart and (apart[0], apart[1] * counts.sum()))
    rows = [(*map(int, p), float(c) if o else 0.0) for p, c, o in zip(patterns, model.posterior(patterns), open_, strict=True)]
    scored = votes.sparkSession.createDataFrame(rows, ", ".join(f"{f} int" for f in FUNCTIONS) + ", confidence double")
    return votes.join(F.broadcast(scored), FUNCTIONS), model


def _linked(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, LabelModel | None]:
    """(evidence, packages, scored candidates a, b, model)."""
    found = scratch.keep(evidence(rows), "evidence")
    known = scratch.keep(packages(found), "packages")
    scored, model = score(scratch.keep(candidates(found, known), "votes"), known=known)
    return found, known, scored, model


def _named(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs a, b as package_a < package_b."""
    pid = lambda c: known.select(F.col("n").alias(c), F.col("pid").alias(f"{c}_pid"))
    both = pairs.join(pid("a"), "a").join(pid("b"), "b")
    return both.select(F.least("a_pid", "b_pid").alias("package_a"), F.greatest("a_pid", "b_pid").alias("package_b"), *[c for c in pairs.columns if c not in ("a", "b")])


def link_packages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored candidates, (pid, registry)): every candidate pair package_a, package_b with its confidence."""
    _, known, scored, _ = _linked(rows, Scratch(rows.sparkSession, "linkage"))
    return _named(scored, known), known.select("pid", "registry")


def _links(scored: DataFrame) -> DataFrame:
    """Confident candidates; components that their topics tell apart are never linked."""
    return scored.where((F.col("confidence") >= CONFIDENT) & (F.col("topic") >= 0))


def _projects(scored: DataFrame) -> DataFrame:
    """(member, group): the package numbers of every project of two or more."""
    return consolidate(_links(scored), "a", "b", [])


def _project_pairs(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b, group, package_a, package_b) of different registries within a project."""
    members = groups.join(known.select(F.col("n").alias("member"), "pid", "registry"), "member").select("group", F.col("member").alias("a"), F.col("pid").alias("package_a"), "registry")
    other = members.select("group", F.col("a").alias("b"), F.col("package_a").alias("package_b"), F.col("registry").alias("other"))
    return members.join(other, "group").where((F.col("package_a") < F.col("package_b")) & (F.col("registry") != F.col("other"))).select("a", "b", "group", "package_a", "package_b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_a, package_b) of all packages of one project in different registries."""
    _, known, scored, _ = _linked(table(spark, sf_dir, "package_versions"), Scratch(spark, "linkage"))
    return _project_pairs(_projects(scored), known).select("package_a", "package_b")


def p5_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_a, package_b, confidence, direct): every pair of p5_found with a confidence.

    ``direct`` is the posterior of the pair's own votes.  Packages are also one
    project through others: a path is as good as its weakest link, and none within
    a project is weaker than the project's weakest, so the confidence is the
    greater of the two.
    """
    scratch = Scratch(spark, "linkage")
    found, known, scored, model = _linked(table(spark, sf_dir, "package_versions"), scratch)
    groups = scratch.keep(_projects(scored), "groups")
    weakest = _links(scored).join(groups.withColumnRenamed("member", "a"), "a").groupBy("group").agg(F.min("confidence").alias("weakest"))
    pairs = scratch.keep(_project_pairs(groups, known), "pairs")
    direct, _ = score(scratch.keep(votes_on(pairs.select("a", "b"), found, known), "direct"), model)
    out = pairs.join(direct.select("a", "b", "confidence"), ["a", "b"]).join(weakest, "group")
    return out.select("package_a", "package_b", F.round(F.greatest("confidence", "weakest"), 6).alias("confidence"), F.round("confidence", 6).alias("direct"))
