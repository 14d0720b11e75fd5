"""Aggregates over the variants of an entity: names, chosen fields, matrices, releases, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import names

# Quality of a registry's fields.
FIELD_QUALITY = {"vcpkg": 50, "cppget": 45, "conan": 40, "xmake": 35, "spack": 30, "bazel": 25, "meson": 20, "hunter": 15}
# Quality of a registry's summaries, of any other, and what a dedicated summary adds.
SUMMARY_QUALITY = {"cppget": 40, "vcpkg": 35, "conan": 34, "xmake": 33, "spack": 25}
SUMMARY_OTHER, SUMMARY_DEDICATED = 10, 50


def _rank(table: dict[str, int], c: Column, other: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c), F.lit(other))


def most_common_name(rows: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name): the most frequent name; ties go to the shortest, then without case, then as written."""
    counts = rows.groupBy(group, name).agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), F.length(name), F.lower(name), F.col(name))
    return counts.groupBy(group).agg(F.min_by(name, order).alias(name))


def other_names(rows: DataFrame, group: str, name: str) -> DataFrame:
    """(group, aliases): the other names, sorted without case, joined by a comma."""
    chosen = most_common_name(rows, group, name).select(F.col(group).alias("__g"), F.col(name).alias("__chosen"))
    rest = rows.select(group, name).distinct().join(chosen, F.col(group) == F.col("__g")).where(F.col(name) != F.col("__chosen"))
    return rest.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.lower(name).alias("k"), F.col(name).alias("v")))), lambda x: x["v"]), ",").alias("aliases"))


def summary_rank(registry: Column, dedicated: Column) -> Column:
    """Quality of a registry's summary; a dedicated one counts more."""
    return _rank(SUMMARY_QUALITY, registry, SUMMARY_OTHER) + F.when(dedicated, SUMMARY_DEDICATED).otherwise(0)


def best_summary(rows: DataFrame, group: str, registry: str, summary: str, description: str, row_id: str) -> DataFrame:
    """(group, summary_text): by registry, dedicated summaries first; ties go to the greater text and id."""
    dedicated = F.coalesce(F.col(summary), F.lit("")) != ""
    text = F.when(dedicated, F.col(summary)).otherwise(F.coalesce(description, F.lit("")))
    score = summary_rank(F.col(registry), dedicated)
    return rows.where(text != "").groupBy(group).agg(F.max_by(text, F.struct(score, text, F.col(row_id))).alias("summary_text"))


def best_field(rows: DataFrame, group: str, registry: str, field: str, row_id: str, preferred: Column | None = None) -> DataFrame:
    """(group, field, source): a preferred row, then the registry's quality, the shorter value, the greater id."""
    filled = rows.where(F.coalesce(F.col(field).cast("string"), F.lit("")) != "")
    order = F.struct(F.coalesce(preferred, F.lit(False)) if preferred is not None else F.lit(False), _rank(FIELD_QUALITY, F.col(registry), 0), -F.length(F.col(field).cast("string")), F.col(row_id))
    return filled.groupBy(group).agg(F.max_by(field, order).alias(field), F.max_by(row_id, order).alias("source"))


def registry_counts(rows: DataFrame, group: str, registry: str) -> DataFrame:
    """(registry, entities): entities that each registry has, once each."""
    return rows.groupBy(registry).agg(F.count_distinct(group).alias("entities"))


def availability(rows: DataFrame, group: str, version: str, registry: str, registries: list[str]) -> DataFrame:
    """One row per entity and version, one column per registry with its number of releases."""
    return rows.groupBy(group, version).agg(*[F.count(F.when(F.col(registry) == r, 1)).alias(r) for r in registries])


def release_groups(rows: DataFrame, package: str, release: str, presented: list[Column]) -> DataFrame:
    """(package, releases, first_release): releases that are presented alike, one row per group."""
    key = F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.concat(F.lit("="), p), F.lit("~")) for p in presented]), 256)
    return rows.groupBy(package, key.alias("presentation")).agg(F.count_distinct(release).alias("releases"), F.min(release).alias("first_release")).drop("presentation")


def resolve_dependencies(wanted: DataFrame, packages: DataFrame, entity: str) -> DataFrame:
    """``wanted`` (registry, name) with the target's entity: the package of that registry, else the only entity of that name, else null."""
    own = packages.select(F.col("registry").alias("__r"), F.lower("name").alias("__n"), F.col(entity).alias("__own")).groupBy("__r", "__n").agg(F.min("__own").alias("__own"))
    only = packages.groupBy(F.lower("name").alias("__m")).agg(F.count_distinct(entity).alias("__k"), F.min(entity).alias("__only")).where("__k = 1").drop("__k")
    out = wanted.join(own, (F.col("registry") == F.col("__r")) & (F.lower("name") == F.col("__n")), "left").join(only, F.lower("name") == F.col("__m"), "left")
    return out.withColumn("target", F.coalesce("__own", "__only")).drop("__r", "__n", "__own", "__m", "__only")


def last_filled(rows: DataFrame, group: str, place: str, field: str) -> DataFrame:
    """(group, field): the last list of a group that isn't empty."""
    filled = rows.where(F.size(field) > 0)
    return filled.groupBy(group).agg(F.max_by(field, place).alias(field))


def united_licences(rows: DataFrame, group: str, licences: str) -> DataFrame:
    """(group, licences): the cleaned licences of all members, once each and sorted."""
    each = rows.select(group, F.explode(names.clean_list(F.col(licences))).alias("l")).distinct()
    return each.groupBy(group).agg(F.array_sort(F.collect_list("l")).alias(licences))


def references(rows: DataFrame, group: str) -> DataFrame:
    """(group, packages): the members (registry, id) of each group, by registry and id."""
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_set(F.struct("registry", "id"))), lambda m: m["id"]).alias("packages"))
