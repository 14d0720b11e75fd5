"""One surviving record for each group of duplicates, chosen field by field.

For every field the survivor is the greatest composite (trust of the origin,
time, row id) among the usable values of the group.  Rows outside any group of
two or more are dropped before texts are shuffled; equal values are combined
map-side, so exact copies of a hot group collapse before they move.

A value that is merely a shortened copy of another member's isn't usable.  In
the sorted order of a group's distinct texts a text is a proper prefix of some
other exactly if it is a prefix of its successor, so one range-partitioned sort
finds them: a group of any size is spread over tasks, and each task learns from
a table of one row per task what follows its last row.  No group is collected.

Defined cases: nulls, blanks and stand-ins aren't usable; a null origin has trust
0; a null time is oldest; equal trust and time fall to the largest row id; a group
without usable value of a field gives no row for it; a text that ends in a
truncation mark counts without the mark, and is shortened if that is a prefix of
another member's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.util import Scratch, broadcast_if_small, clean_id, table

# Texts that only stand in for a missing one (lower case, without outer blanks).
TEXT_STAND_INS = [
    "", "-", "--", "?", ".", "...", "…", "n/a", "n.a.", "na", "none", "(none)", "null", "nil", "nan", "tbd", "todo", "fixme", "fixme: add summary",
    "fixme: add description", "unknown", "unspecified", "(unspecified)", "undefined", "lorem", "lorem ipsum", "xxx", "test", "description",
    "<description>", "<summary>", "summary", "description goes here", "summary goes here", "no description", "no description available", "no summary",
    "no summary available", "no description provided", "not available", "not set", "&nbsp;", "placeholder",
]
# Licence entries that name no licence.
LICENCE_STAND_INS = [
    "", "-", "--", "?", ".", "...", "…", "n/a", "n.a.", "na", "none", "(none)", "none given", "not given", "null", "nil", "tbd", "todo", "unknown", "unspecified",
    "(unspecified)", "other", "noassertion", "unlicensed?", "license", "licence", "licensed", "see license", "see licence", "see license.txt", "see license.md",
    "license.txt", "license.md", "see license file", "copying", "see copying", "not set", "&nbsp;", "xxx",
]
# Hosts that never serve a page of a project.
EMPTY_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "homepage.invalid", "about"]

_MARK = r"\s*(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{3,}|…)\s*$"
_BLANKS = r"[\s\p{Z}\u200b\ufeff]+"
RELEASE_FIELDS = {"summary": "text", "description": "text", "licenses": "licences", "homepage": "address"}


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _BLANKS, " "))


def usable_text(c: Column) -> Column:
    """A text that says something: neither missing nor a stand-in."""
    return c.isNotNull() & ~F.lower(_squeezed(c)).isin(TEXT_STAND_INS) & (F.regexp_replace(_squeezed(c), _MARK, "") != "")


def usable_licences(c: Column) -> Column:
    """A list with at least one entry that names a licence."""
    return F.coalesce(F.exists(c, lambda x: x.isNotNull() & ~F.lower(_squeezed(x)).isin(LICENCE_STAND_INS)), F.lit(False))


def usable_address(c: Column) -> Column:
    """An address with a host, with or without scheme, that isn't reserved."""
    bare = F.regexp_replace(F.lower(_squeezed(c)), r"^(?:[a-z][a-z0-9+.-]*://|//|mailto:)", "")
    host = F.regexp_extract(bare, r"^(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.coalesce(host.rlike(r"^[^.\s]+(?:\.[^.\s]+)+$") & ~host.isin(EMPTY_HOSTS) & ~host.rlike(r"\.(?:invalid|localhost)$") & ~F.lower(_squeezed(c)).isin(TEXT_STAND_INS), F.lit(False))


def shortened(values: DataFrame, group: list[str], text: str, out: str = "shortened") -> DataFrame:
    """``values`` (distinct by group and text) with a flag: the text, without a
    truncation mark, is a proper prefix of another text of its group.

    Compared in lower case with single blanks.  The sort is by ranges of
    (group, text); each range knows the first row of the next non-empty one.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "shortened")
    plain = F.lower(_squeezed(F.col(text)))
    bare = F.regexp_replace(plain, _MARK, "")
    keyed = values.withColumn("__bare", bare)
    distinct = keyed.select(*group, "__bare").distinct()
    ranged = scratch.keep(distinct.repartitionByRange(*[F.col(g) for g in group], F.col("__bare")).sortWithinPartitions(*group, "__bare").withColumn("__part", F.spark_partition_id()), "ranged")
    order = [F.col(g) for g in group] + [F.col("__bare")]
    here = Window.partitionBy("__part").orderBy(*order)
    following = F.lead(F.struct(*order)).over(here)
    firsts = ranged.groupBy("__part").agg(F.min(F.struct(*order)).alias("__first"))
    across = firsts.select((F.lead("__part", -1).over(Window.orderBy("__part"))).alias("__part"), F.col("__first").alias("__after"))  # one row a task
    following_row = ranged.withColumn("__next", following).join(F.broadcast(across), "__part", "left")
    after = F.coalesce(F.col("__next"), F.col("__after"))
    same = [F.col(g).eqNullSafe(after[g]) for g in group]
    is_prefix = after["__bare"].startswith(F.col("__bare"))
    for cond in same:
        is_prefix = is_prefix & cond
    cut = following_row.where(is_prefix & (F.length("__bare") > 0)).select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__bare").alias("__cut"))
    joined = keyed.join(cut, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col("__bare") == F.col("__cut")], "left")
    return joined.withColumn(out, F.col("__cut").isNotNull()).drop("__bare", "__cut", *[f"__{g}" for g in group])


def survivors(rows: DataFrame, group: list[Column], row_id: str, fields: dict[str, str], trust: Column, time: str, required: int = 2) -> DataFrame:
    """(first_id, field_name, row id): the member whose value survives.

    ``group`` are the expressions of the duplicate key; a row in which one of the
    first ``required`` is null belongs to no group, the others are compared
    null-safe.  ``fields`` maps a column to text, licences or address.
    """
    usable = {"text": usable_text, "licences": usable_licences, "address": usable_address}
    key = F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.concat(F.lit("="), g), F.lit("~")) for g in group]), 256)
    named = F.lit(True)
    for g in group[:required]:
        named = named & g.isNotNull()
    keyed = rows.where(F.col(row_id).isNotNull() & named).withColumn("__g", F.substring(key, 1, 32))
    groups = keyed.groupBy("__g").agg(F.min(row_id).alias("first_id"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    values = F.array(*[
        F.struct(F.lit(name).alias("field_name"), usable[kind](F.col(name)).alias("usable"), (F.col(name) if kind == "text" else F.lit(None).cast("string")).alias("text"))
        for name, kind in fields.items()
    ])
    rank = F.struct(trust.alias("trust"), F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(2**62)).cast("long")).alias("at"), F.col(row_id).alias("id"))
    members = keyed.select("__g", rank.alias("__rank"), F.explode(F.filter(values, lambda v: v["usable"])).alias("__v"))
    # a hot group's members are split by adaptive execution: the other side has one row a group
    members = members.join(groups, "__g").select("first_id", F.col("__v.field_name").alias("field_name"), F.col("__v.text").alias("text"), "__rank")
    best = members.groupBy("first_id", "field_name", "text").agg(F.max("__rank").alias("__rank"))
    best = Scratch(rows.sparkSession, "survivors").keep(best, "best")
    texts = shortened(best.where("text IS NOT NULL"), ["first_id", "field_name"], "text").where("NOT shortened").drop("shortened")
    kept = texts.unionByName(best.where("text IS NULL"))
    return kept.groupBy("first_id", "field_name").agg(F.max("__rank").alias("__rank")).select("first_id", "field_name", F.col("__rank.id").alias(row_id))


def release_key() -> list[Column]:
    """Duplicate key of a release: clean package, version without case, blanks and a leading v, channel."""
    return [clean_id("package_id"), F.regexp_replace(F.lower(F.trim("release_version")), r"^v", ""), F.col("channel")]


def _trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = table(spark, sf_dir, "origins").where("origin IS NOT NULL").groupBy(F.col("origin").alias("__origin")).agg(F.max("trust").alias("__trust"))
    rows = table(spark, sf_dir, "package_versions")
    return rows.join(broadcast_if_small(trust), F.col("origin") == F.col("__origin"), "left")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(first_id, field_name, release_id): the member whose value survives."""
    rows = _trusted(spark, sf_dir)
    return survivors(rows, release_key(), "release_id", RELEASE_FIELDS, F.coalesce(F.col("__trust"), F.lit(0)), "fetched_at")


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per release: first_id and the four fields as chosen."""
    chosen = p1_found(spark, sf_dir)
    rows = table(spark, sf_dir, "package_versions").select("release_id", "summary", "description", F.array_join("licenses", "; ").alias("licenses"), "homepage")
    picked = rows.join(chosen, "release_id")
    value = F.when(F.col("field_name") == "summary", F.col("summary")).when(F.col("field_name") == "description", F.col("description")).when(F.col("field_name") == "licenses", F.col("licenses")).otherwise(F.col("homepage"))
    return picked.groupBy("first_id").agg(*[F.max(F.when(F.col("field_name") == f, value)).alias(f) for f in RELEASE_FIELDS])
