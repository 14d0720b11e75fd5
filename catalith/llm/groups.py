"""Pairwise matches consolidated into groups, with pairs that must stay apart.

Links are taken by falling confidence, then smaller id, then larger id; a link
that would bring both ids of a forbidden pair into one group is refused.

The graph is reduced before anything is solved.  Each round strips the vertices
of degree one and splices an independent set of the inner vertices of
degree-two chains (list ranking by contraction), replacing a spliced vertex by a
link of the worse of its two orders.  What was removed remembers the neighbour
it joins: a leaf joins its only neighbour, a spliced vertex the neighbour of its
better link.  Ids of forbidden pairs are never removed, so a removed vertex joins
its neighbour in the sequential order too, whatever is refused elsewhere.

A core of more than ``REPLAY_LINKS`` links shrinks by Boruvka rounds: a cluster
without id of a forbidden pair joins along its best link, which can't be refused.
A core of at most ``REPLAY_LINKS`` links is replayed in order by one task.  Of a
larger one only links between clusters around forbidden ids are left; each of its
components is replayed by a task of its own, with the rules inside it.  Only while
a component exceeds ``COMPONENT_LINKS`` do parallel rounds over mutually best
links come first.  Finally the labels are restored to everything that was removed,
by pointer doubling.  All of this gives the groups of the sequential order, at any
size.

Each step is a shuffle of the shrinking link table; intermediate tables are
written to the shared folder.  Aggregations combine a hub's links before they are
shuffled; in joins the side that holds a hub's links is split by adaptive
execution, since the other side has one row a vertex.  No component or link list
is collected.

Defined cases: links with null or blank ids and links of an id with itself say
nothing; repeated and reversed links count once, at their best order; a null
confidence comes last; a forbidden pair of an id with itself, or of ids without
links, has no effect; an empty table gives no groups.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from catalith.operators.resolve import components
from catalith.util import Scratch, clean_id, table

#: Links of the core that a single task may replay (12 MB of ids).
REPLAY_LINKS = 500_000
#: Links of one component of a larger core that a task may replay (120 MB of ids).
COMPONENT_LINKS = 5_000_000
#: A reduction round that removes a smaller share of the vertices is the last; the core solver takes the rest.
LEAST_GAIN = 0.1


def _canonical(links: DataFrame) -> DataFrame:
    """(u, v, r): one row per linked pair with u < v and its best order r."""
    return links.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("r").alias("r"))


def _arcs(links: DataFrame) -> DataFrame:
    """Each link from both of its ends."""
    return links.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y"), "r"), F.struct(F.col("v").alias("x"), F.col("u").alias("y"), "r"))).alias("a")).select("a.*")


def _kept(scratch: Scratch, df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A written table and its rows, counted while it is written."""
    seen = Observation()
    out = scratch.keep(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return out, seen.get["rows"]


def _reduce_once(scratch: Scratch, links: DataFrame, apart: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """One round of stripping and splicing: (links left, joins (x, to), vertices, removed)."""
    ends = _arcs(links).groupBy("x").agg(F.count("*").alias("deg"), F.min(F.struct("r", "y")).alias("best"), F.max(F.struct("r", "y")).alias("worst"))
    ends = ends.join(apart, "x", "left").withColumn("free", F.col("kept").isNull()).drop("kept")
    ends, vertices = _kept(scratch, ends, "ends")
    light = ends.where("free AND deg <= 2").select("x", "deg", F.col("best.y").alias("p"), F.col("best.r").alias("rp"), F.col("worst.y").alias("q"), F.col("worst.r").alias("rq"), F.xxhash64("x").alias("h"))
    about = light.select(F.col("x").alias("n"), F.col("deg").alias("ndeg"), F.struct(F.col("h"), F.col("x")).alias("nh"))
    beside = light.where("deg = 2").select("x", F.struct("h", "x").alias("own"), F.explode(F.array("p", "q")).alias("n")).join(about, "n")
    blocked = beside.where("ndeg = 1 OR nh < own").select("x").distinct()
    chosen = light.where("deg = 2").join(blocked, "x", "left_anti").select("x", F.col("p").alias("to"), "p", "q", "rq", F.lit(2).alias("deg"))
    twins = light.where("deg = 1").select("x", "p").join(light.where("deg = 1").select(F.col("x").alias("p"), F.lit(True).alias("twin")), "p", "left")
    leaves = twins.where("twin IS NULL OR x > p").select("x", F.col("p").alias("to"), "p", F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("rq"), F.lit(1).alias("deg"))
    gone, n = _kept(scratch, leaves.unionByName(chosen), "gone")
    scratch.drop(ends)
    spliced = gone.where("deg = 2").select(F.col("p").alias("u"), F.col("q").alias("v"), F.col("rq").alias("r"))
    names = gone.select(F.col("x").alias("g"))
    rest = links.join(names, F.col("u") == F.col("g"), "left_anti").join(names, F.col("v") == F.col("g"), "left_anti")
    return scratch.keep(_canonical(rest.unionByName(spliced)), "links"), gone.select("x", "to"), vertices, n


def _contract(scratch: Scratch, links: DataFrame, apart: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, int]:
    """One Boruvka round among clusters without forbidden partner: (links, joins, joined)."""
    best = _arcs(links).groupBy("x").agg(F.min(F.struct("r", "y")).alias("b"))
    best = best.join(apart, "x", "left").where("kept IS NULL").select("x", F.col("b.y").alias("y"))
    best = best.join(apart.select(F.col("x").alias("y"), F.col("kept").alias("anchor")), "y", "left")
    tail = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2)) == 0
    joins, n = _kept(scratch, best.where(tail("x") & (F.col("anchor").isNotNull() | ~tail("y"))).select("x", F.col("y").alias("to")), "joins")
    if not n:
        return links, joins, 0
    return scratch.keep(_relabel(links, joins), "links"), joins, n


def _relabel(links: DataFrame, joins: DataFrame) -> DataFrame:
    to = joins.select(F.col("x").alias("g"), "to")
    left = links.join(to, F.col("u") == F.col("g"), "left").select(F.coalesce("to", "u").alias("u"), "v", "r")
    both = left.join(to, F.col("v") == F.col("g"), "left").select("u", F.coalesce("to", "v").alias("v"), "r")
    return _canonical(both)


def _free_links_left(links: DataFrame, apart: DataFrame) -> bool:
    ends = _arcs(links).select("x").distinct()
    return not ends.join(apart, "x", "left_anti").isEmpty()


class _Clusters:
    """Sequential union with forbidden pairs, for one component of the core."""

    def __init__(self, forbidden: list[tuple[int, int]]):
        self.parent: dict[int, int] = {}
        self.foes: dict[int, set[int]] = {}
        for a, b in forbidden:
            self.foes.setdefault(a, set()).add(b)
            self.foes.setdefault(b, set()).add(a)

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x] = root
            x = up
        return root

    def join(self, a: int, b: int) -> None:
        """Joins two clusters unless a forbidden pair would meet; foes are kept by root."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return
        fa, fb = self.foes.get(a, set()), self.foes.get(b, set())
        if b in fa:
            return
        if len(fa) < len(fb):
            a, b, fa, fb = b, a, fb, fa
        self.parent[b] = a
        if fb:
            for foe in fb:
                self.foes[foe].discard(b)
                self.foes[foe].add(a)
            self.foes.setdefault(a, set()).update(fb)
            self.foes.pop(b, None)


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    rules = pdf[pdf["r"] < 0]
    clusters = _Clusters(list(zip(rules["u"].tolist(), rules["v"].tolist(), strict=True)))
    for row in pdf[pdf["r"] >= 0].sort_values("r").itertuples(index=False):
        clusters.join(row.u, row.v)
    names = pd.unique(pdf[["u", "v"]].to_numpy().ravel())
    return pd.DataFrame({"x": names, "to": [clusters.find(int(x)) for x in names]}, dtype="int64")


def _by_component(links: DataFrame) -> DataFrame:
    """``links`` with the component they lie in, as ``core``."""
    found = components(links, "u", "v").select(F.col("id").alias("u"), F.col("component").alias("core"))
    return links.join(found, "u")


def _mutual_rounds(scratch: Scratch, links: DataFrame, rules: DataFrame, joins: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Parallel rounds for components too large to replay: links that are best for both
    ends are accepted, or refused and dropped with their pair for good."""
    while not _by_component(links).groupBy("core").count().where(F.col("count") > COMPONENT_LINKS).isEmpty():
        best = _arcs(links).groupBy("x").agg(F.min("r").alias("r"))
        mutual = links.join(best.select(F.col("x").alias("u"), "r"), ["u", "r"]).join(best.select(F.col("x").alias("v"), "r"), ["v", "r"]).select("u", "v", "r")
        mutual = scratch.keep(mutual.join(rules.select("u", "v", F.lit(True).alias("refused")), ["u", "v"], "left"), "mutual")
        joined = scratch.keep(mutual.where("refused IS NULL").select(F.col("v").alias("x"), F.col("u").alias("to")), "joins")
        rest = links.join(mutual.where("refused").select("u", "v"), ["u", "v"], "left_anti")
        joins.append(joined)
        links = scratch.keep(_relabel(rest, joined), "links")
        rules = scratch.keep(_relabel(rules.withColumn("r", F.lit(-1).cast("long")), joined), "rules")
    return links, rules


def _replayed(scratch: Scratch, graph: DataFrame, rules: DataFrame, size: int, joins: list[DataFrame]) -> DataFrame:
    """(x, to) of the core: in one task, or in one for each of its components; only rules inside the core are sent."""
    if size > REPLAY_LINKS:
        graph, rules = _mutual_rounds(scratch, graph, rules, joins)
        graph = scratch.keep(_by_component(graph), "cores")
    else:
        graph = graph.withColumn("core", F.lit(0).cast("long"))
    inside = graph.select(F.explode(F.array("u", "v")).alias("u"), "core").distinct()
    rules = rules.select("u", "v").join(inside, "u").join(inside.select(F.col("u").alias("v"), "core"), ["v", "core"])
    work = graph.select("u", "v", "r", "core").unionByName(rules.select("u", "v", F.lit(-1).cast("long").alias("r"), "core"))
    return work.groupBy("core").applyInPandas(lambda pdf: _replay(pdf), "x long, to long").where("x <> to")


def _restore(scratch: Scratch, joins: DataFrame, depth: int) -> DataFrame:
    """(x, to) with ``to`` the final root, by pointer doubling over at most ``depth`` levels."""
    here, reach = scratch.keep(joins, "pointers"), 1
    while reach < depth:
        up = here.select(F.col("x").alias("to"), F.col("to").alias("above"))
        here, before = scratch.keep(here.join(up, "to", "left").select("x", F.coalesce("above", "to").alias("to")), "pointers"), here
        scratch.drop(before)
        reach *= 2
    return here


def consolidate(links: DataFrame, left: str, right: str, order: list, forbidden: DataFrame | None = None, forbidden_ids: tuple[str, str] = ("left_id", "right_id")) -> DataFrame:
    """(member, group): the group of every linked id, named by its smallest id.

    ``order`` are sort columns that put the links into the order in which they
    are taken; ``forbidden`` has the pairs that must not share a group.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "groups")
    a, b = F.col(left), F.col(right)
    if dict(links.dtypes)[left] == "bigint" and forbidden is None and not order:  # numbers need no other, and no link can be refused
        graph = links.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.lit(0).cast("long").alias("r")).distinct()
        graph = scratch.keep(graph, "links")
        ids = graph.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("n"))
        none = spark.createDataFrame([], "u long, v long")
        return _solved(scratch, graph, none, none.select(F.col("u").alias("x"), F.lit(True).alias("kept")), ids)
    named = links.where(a.isNotNull() & b.isNotNull() & (a != "") & (b != "") & (a != b))
    ordered = named.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    pairs = ordered.groupBy("a", "b").agg(F.min(F.struct(*[f"o{i}" for i in range(len(order))])).alias("o"))
    # monotonically_increasing_id after a global sort is an order: partitions are ranges
    pairs = scratch.keep(pairs.orderBy("o", "a", "b").select("a", "b", F.monotonically_increasing_id().alias("r")), "pairs")
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.monotonically_increasing_id().alias("n")), "ids")
    left_ids, right_ids = ids.select(F.col("id").alias("a"), F.col("n").alias("u")), ids.select(F.col("id").alias("b"), F.col("n").alias("v"))
    graph = scratch.keep(_canonical(pairs.join(left_ids, "a").join(right_ids, "b").select("u", "v", "r")), "links")
    if forbidden is None:
        rules = spark.createDataFrame([], "u long, v long")
    else:
        x, y = (F.col(c) for c in forbidden_ids)
        rules = forbidden.where(x != y).select(x.alias("a"), y.alias("b")).join(left_ids, "a").join(right_ids, "b").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    rules = scratch.keep(rules, "rules")
    apart = scratch.keep(rules.select(F.explode(F.array("u", "v")).alias("x")).distinct().select("x", F.lit(True).alias("kept")), "apart")
    return _solved(scratch, graph, rules, apart, ids)


def _solved(scratch: Scratch, graph: DataFrame, rules: DataFrame, apart: DataFrame, ids: DataFrame) -> DataFrame:
    """(member, group) of a graph (u, v, r) of numbers, with ``ids`` (id, n) naming them."""
    joins: list[DataFrame] = []
    while True:
        graph, gone, vertices, n = _reduce_once(scratch, graph, apart)
        joins.append(gone)
        if not n or n < LEAST_GAIN * vertices:
            break
    turn, size = 0, graph.count()
    while size > REPLAY_LINKS and _free_links_left(graph, apart):
        graph, gone, n = _contract(scratch, graph, apart, turn := turn + 1)
        if n:
            joins.append(gone)
            size = graph.count()
    if size:
        joins.append(scratch.keep(_replayed(scratch, graph, rules, size, joins), "solved"))
    depth = len(joins)
    table_of_joins = joins[0]
    for more in joins[1:]:
        table_of_joins = table_of_joins.unionByName(more)
    roots = _restore(scratch, table_of_joins, depth)
    members = ids.join(roots.withColumnRenamed("x", "n"), "n", "left").select("id", F.coalesce("to", "n").alias("root"))
    members = scratch.keep(members, "members")
    first = members.groupBy("root").agg(F.min("id").alias("group"), F.count("*").alias("size")).where("size > 1").drop("size")
    return members.join(first, "root").select(F.col("id").alias("member"), "group")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_id, group_id) of every package in a group of two or more."""
    rows = table(spark, sf_dir, "package_matches").where(clean_id("decision").isin("merge", "manual_merge"))
    links = rows.select(clean_id("left_id").alias("left_id"), clean_id("right_id").alias("right_id"), "confidence")
    never = table(spark, sf_dir, "never_merge").select(clean_id("left_id").alias("left_id"), clean_id("right_id").alias("right_id"))
    order = [-F.coalesce(F.col("confidence"), F.lit(-1.0))]
    groups = consolidate(links, "left_id", "right_id", order, never)
    return groups.select(F.col("member").alias("package_id"), F.col("group").alias("group_id"))
