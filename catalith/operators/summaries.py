"""What is published of entities: one summary each, the details of their packages, and releases without what they repeat.

All are aggregations by entity or package; a package's list of releases is never
put into one row before its repetitions are gone.

Defined cases: an entity without any text has an empty summary without source; a
preference for a package that isn't a member, or whose field is empty, has no
effect; releases with nothing of their own to show form no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions import names, prose
from catalith.operators import entities
from catalith.util import broadcast_if_small

# Fields that a release may show differently from its package, and fields that an entity takes from one of its packages.
PRESENTED = ["summary", "description", "licenses", "homepage", "repository_url", "documentation_url"]
CHOSEN = ["licenses", "homepage", "repository_url", "documentation_url"]
# Fixed value: entities shown before a search.
PREVIEW = 30


def member_entities(entities_: DataFrame) -> DataFrame:
    """(package_id, entity_id, place): each member of entities (id, packages)."""
    return entities_.select(F.col("id").alias("entity_id"), F.posexplode("packages").alias("place", "package_id"))


def in_order(rows: DataFrame, group: str, place: str, values: str) -> DataFrame:
    """(group, values): the distinct values of a list column over the rows of a group, in order of place and list."""
    each = rows.select(group, place, F.posexplode(values).alias("__i", "v")).groupBy(group, "v").agg(F.min(F.struct(place, "__i")).alias("at"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(values))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def chosen(variants: DataFrame, preferences: DataFrame, field: str) -> DataFrame:
    """(entity_id, field, field_source): a preferred package's value, else the best registry's, the shorter, the greater package."""
    filled = variants.where(F.size(field) > 0) if dict(variants.dtypes)[field].startswith("array") else variants.where(_text(F.col(field)) != "")
    wish = preferences.where(F.col("field") == field).select(F.col("entity_id").alias("__e"), F.col("source").alias("__s"), F.lit(True).alias("__wish"))
    held = filled.join(broadcast_if_small(wish), (F.col("entity_id") == F.col("__e")) & (F.col("package_id") == F.col("__s")), "left")
    best = entities.best_field(held, "entity_id", "registry", field, "package_id", F.coalesce("__wish", F.lit(False)))
    return best.withColumnRenamed("source", f"{field}_source")


def spoken(variants: DataFrame, preferences: DataFrame) -> DataFrame:
    """(entity_id, content, content_source): the summary text of the preferred package, else of the best registry."""
    dedicated = _text(F.col("summary")) != ""
    raw = F.when(dedicated, F.col("summary")).otherwise(_text(F.col("description")))
    rows = variants.select("entity_id", "package_id", "registry", dedicated.alias("dedicated"), raw.alias("raw")).where("raw <> ''")
    rows = rows.select("*", prose.rendered(F.col("raw")).alias("r")).select("entity_id", "package_id", "registry", "dedicated", F.col("r.summary_text").alias("text")).where("text <> ''")
    wish = preferences.where("field = 'summary'").select(F.col("entity_id").alias("__e"), F.col("source").alias("__s"), F.lit(True).alias("wish"))
    rows = rows.join(broadcast_if_small(wish), (F.col("entity_id") == F.col("__e")) & (F.col("package_id") == F.col("__s")), "left")
    score = entities.summary_rank(F.col("registry"), F.col("dedicated"))
    order = F.struct(F.coalesce("wish", F.lit(False)), score, "text", "package_id")
    return rows.groupBy("entity_id").agg(F.max_by(F.struct(F.col("text"), F.col("package_id")), order).alias("b")).select("entity_id", F.col("b.text").alias("content"), F.col("b.package_id").alias("content_source"))


def summaries(entities_: DataFrame, packages: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """One row per entity: id, title, aliases, chosen fields with their sources, content, topics, packages and managers.

    ``entities_``: id, name, aliases, packages; ``packages``: package_id, registry,
    summary, description, topics and the chosen fields; ``preferences``: entity_id,
    field, source.  The title is left out if it equals the id.
    """
    spark = packages.sparkSession
    preferences = preferences if preferences is not None else spark.createDataFrame([], "entity_id string, field string, source string")
    members = member_entities(entities_)
    variants = members.join(packages, "package_id")
    out = entities_.select(F.col("id").alias("entity_id"), F.when(F.col("name") != F.col("id"), F.col("name")).alias("title"), "aliases", "packages")
    managers = members.select("entity_id", "place", F.array(F.substring_index("package_id", ":", 1)).alias("managers"))
    out = out.join(in_order(managers, "entity_id", "place", "managers"), "entity_id", "left")
    out = out.join(in_order(variants.where(F.size("topics") > 0), "entity_id", "place", "topics"), "entity_id", "left")
    out = out.join(spoken(variants, preferences), "entity_id", "left")
    for field in CHOSEN:
        out = out.join(chosen(variants, preferences, field), "entity_id", "left")
    return out.withColumnRenamed("entity_id", "id")


def manager_counts(found: DataFrame) -> DataFrame:
    """(registry, entities): of the entities found (id, packages), how many each registry has."""
    members = found.select("id", F.explode("packages").alias("p")).select("id", F.substring_index("p", ":", 1).alias("registry"))
    return entities.registry_counts(members, "id", "registry")


def preview(found: DataFrame) -> DataFrame:
    """The first entities by id."""
    return found.orderBy("id").limit(PREVIEW)


def listed(master: DataFrame) -> DataFrame:
    """Entities by name, without case first."""
    return master.orderBy(F.lower("name"), "name")


def by_confidence(matches: DataFrame) -> DataFrame:
    """Matches, the most confident first."""
    return matches.orderBy(F.desc("confidence"), "left", "right")


def detail_excerpts(packages: DataFrame) -> DataFrame:
    """Packages with the first two blocks of their description."""
    shown = packages.withColumn("__r", prose.excerpted(F.col("description")))
    return shown.withColumn("description", F.nullif(F.col("__r.body_html"), F.lit(""))).drop("__r")


def release_delta(releases: DataFrame, packages: DataFrame, fields: list[str] = PRESENTED) -> tuple[DataFrame, DataFrame]:
    """(own, groups): what releases show differently from their package.

    ``own`` (package_id, release_id, shown): fields, as a map to JSON, of releases that
    alone show them; ``groups`` (package_id, releases, shown): those that several
    releases of a package show.  A field that equals the package's, or that the
    release doesn't state, isn't shown.
    """
    plain = lambda df, prefix: df.select("package_id", *[c for c in ("release_id",) if c in df.columns], *[F.to_json(F.struct(F.col(f).alias("v"))).alias(f"{prefix}{f}") for f in fields])
    both = plain(releases, "r_").join(plain(packages, "p_"), "package_id", "left")
    differs = [F.when((F.col(f"r_{f}") != "{}") & ~F.col(f"r_{f}").eqNullSafe(F.col(f"p_{f}")), F.struct(F.lit(f).alias("k"), F.get_json_object(f"r_{f}", "$.v").alias("v"))) for f in fields]
    shown = both.select("package_id", "release_id", F.array_compact(F.array(*differs)).alias("shown")).where("size(shown) > 0")
    counted = shown.groupBy("package_id", "shown").agg(F.count("*").alias("n"), F.min("release_id").alias("only"), F.array_sort(F.collect_list("release_id")).alias("releases"))
    fields_of = F.map_from_entries("shown").alias("shown")
    return counted.where("n = 1").select("package_id", F.col("only").alias("release_id"), fields_of), counted.where("n > 1").select("package_id", "releases", fields_of)


def normalise_package(releases: DataFrame) -> DataFrame:
    """Releases in one form: upstream version, packaging revision and typed artifacts from address and checksum lists.

    Input: registry, version, artifacts, source_urls, checksums.  An address that an
    artifact has is not added again; checksums go with the only address, or with the
    first artifact if no artifact has any, or form an artifact of their own.
    """
    none = F.array().cast("array<struct<kind:string,url:string,checksums:array<string>>>")
    kind = F.when(F.col("registry").isin("cppget", "meson"), "registry_package").otherwise("upstream_source")
    texts = lambda c: names.clean_list(F.coalesce(F.col(c), F.array().cast("array<string>")))
    v = names.version_identity(F.col("registry"), F.col("version"))
    rows = releases.withColumns({"artifacts": F.coalesce("artifacts", none), "source_urls": texts("source_urls"), "checksums": texts("checksums"), "__v": v, "__kind": kind})
    sums = F.when((F.size("checksums") > 0) & (F.size("source_urls") == 1), F.col("checksums"))
    fresh = F.filter("source_urls", lambda u: ~F.exists("artifacts", lambda a: F.coalesce(a["url"], F.lit("")) == u))
    made = F.transform(fresh, lambda u: F.struct(F.col("__kind").alias("kind"), u.alias("url"), sums.alias("checksums")))
    bare = F.array(F.struct(F.col("__kind").alias("kind"), F.lit(None).cast("string").alias("url"), F.col("checksums").alias("checksums")))
    first = lambda a, i: F.when(i == 0, F.struct(a["kind"].alias("kind"), a["url"].alias("url"), F.col("checksums").alias("checksums"))).otherwise(F.struct(a["kind"].alias("kind"), a["url"].alias("url"), a["checksums"].alias("checksums")))
    orphan = (F.size("checksums") > 0) & (F.size("source_urls") == 0)
    unsummed = ~F.exists("artifacts", lambda a: F.coalesce(F.size(a["checksums"]), F.lit(0)) > 0)
    all_ = F.when(orphan & (F.size("artifacts") == 0), bare).when(orphan & unsummed, F.transform("artifacts", first)).otherwise(F.concat("artifacts", made))
    upstream = F.when((F.col("__v.upstream") != "") & (F.col("__v.upstream") != F.col("version")), F.col("__v.upstream"))
    return rows.withColumns({"upstream_version": upstream, "packaging_revision": F.nullif("__v.revision", F.lit("")), "artifacts": all_}).drop("source_urls", "checksums", "__v", "__kind")


def version_map(releases: DataFrame, shown: list[str]) -> DataFrame:
    """(package_id, versions): a map from release id (version, ``#revision`` unless the version states it, ``@channel``) to its fields.

    Input: package_id, place, version, upstream_version, packaging_revision, channel
    and the shown fields; the last of a release id counts.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    stated = F.when(F.col("version") == F.coalesce(F.nullif("upstream_version", F.lit("")), F.col("version")), blank("packaging_revision")).otherwise(F.lit(""))
    named = releases.select("package_id", "place", names.release_id(F.col("version"), stated, blank("channel")).alias("k"), F.struct(*shown).alias("v"))
    last = named.groupBy("package_id", "k").agg(F.max_by("v", "place").alias("v"))
    return last.groupBy("package_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("versions"))


def totals(found: DataFrame) -> DataFrame:
    """(registry, entities) of all entities, with their number under registry '' — what a page shows before any filter."""
    return manager_counts(found).unionByName(found.select(F.lit("").alias("registry"), "id").groupBy("registry").agg(F.count_distinct("id").alias("entities")))
