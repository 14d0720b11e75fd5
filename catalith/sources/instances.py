"""Packages evaluated once per platform, united: their metadata, versions and addresses.

One row is one package on one platform, as an evaluating tool prints it.  Scalars
come from the first platform that states them, lists are united and sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.presentation import semver_key


def stated(values: Column) -> Column:
    """Values of a list or of the keys of a map, as text, without empties, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")))


def sha256(value: Column) -> Column:
    """``sha256:`` and digits of a 64-digit hash; a shorter one names a revision and gives null."""
    return F.when(value.rlike(r"^[0-9A-Fa-f]{64}$"), F.concat(F.lit("sha256:"), F.lower(value)))


def filled_url(url: Column, version: Column) -> Column:
    """An address with ``$(version)`` and ``$(version_nodot)`` filled in; null without address or version."""
    whole = F.replace(url, F.lit("$(version)"), version)
    return F.replace(whole, F.lit("$(version_nodot)"), F.replace(version, F.lit("."), F.lit("")))


def united(rows: DataFrame) -> DataFrame:
    """One row per package from rows (name, place, platform, description, homepage, kind, urls, licenses, dependencies, components)."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(stated(F.col(c)))))).alias(c) for c in ("urls", "licenses", "dependencies", "components")]
    platforms = F.array_sort(F.collect_set(F.coalesce(F.nullif("platform", F.lit("")), F.lit("default")))).alias("platforms")
    return rows.groupBy("name").agg(first("description"), first("homepage"), first("kind"), *lists, platforms)


def united_versions(rows: DataFrame) -> DataFrame:
    """(name, version, source_urls, checksums) from rows (name, versions, urls, hashes as a map from version to hashes)."""
    each = rows.select("name", F.explode("versions").alias("version"), "urls", "hashes")
    urls = F.transform(F.coalesce("urls", F.array().cast("array<string>")), lambda u: filled_url(u, F.col("version")))
    sums = F.transform(F.coalesce(F.try_element_at("hashes", F.col("version")), F.array().cast("array<string>")), sha256)
    return each.select("name", "version", stated(urls).alias("u"), stated(sums).alias("s")).groupBy("name", "version").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("u")))).alias("source_urls"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("s")))).alias("checksums"))


def in_version_order(versions: DataFrame) -> DataFrame:
    """(name, versions): the versions of each package, semantic ones in their order, others as text behind them."""
    keyed = versions.select("name", F.struct(semver_key(F.col("version")).isNull().alias("other"), semver_key(F.col("version")).alias("key"), "version", "source_urls", "checksums").alias("v"))
    return keyed.groupBy("name").agg(F.transform(F.array_sort(F.collect_list("v")), lambda v: F.struct(v["version"].alias("version"), v["source_urls"].alias("source_urls"), v["checksums"].alias("checksums"))).alias("versions"))
