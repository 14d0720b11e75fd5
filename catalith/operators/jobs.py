"""Refreshing and maintaining cached collections: merge, label, correct, hide, prune, and the records that are published.

A job takes tables and gives tables; where rows come from and go to is the
caller's (``operators.publish``, ``operators.collection``).  A cache only grows
while it is refreshed: an empty or failed fetch removes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions.ids import short_id
from catalith.operators import merge
from catalith.util import broadcast_if_small


@dataclass(frozen=True)
class Kind:
    """What a collection's job needs to know."""

    key: str
    fields: tuple[str, ...]
    source: str


# Fields that curators may correct.
POSTS = Kind("post_id", ("title", "source_title", "published", "updated", "description", "tags"), "source_id")
VIDEOS = Kind("video_id", ("title", "published", "updated", "description", "thumbnail_url", "tags"), "channel_id")


def checked_labels(labels: DataFrame, collection: str) -> DataFrame:
    """(item_id, label) of one collection from curated rows (collection, item_id, relevance as written).

    A value that isn't a number from 0 to 1, a truth value included, is an error.
    """
    number = F.when(F.trim("relevance").rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.trim("relevance").try_cast("double"))
    wrong = F.raise_error(F.concat(F.lit("relevance of "), "item_id", F.lit(" must be a number between 0 and 1"))).cast("double")
    return labels.where(F.col("collection") == collection).select(F.col("item_id").cast("string").alias("item_id"), F.when(number.between(0, 1), number).otherwise(wrong).alias("label"))


def _overridden(rows: DataFrame, overrides: DataFrame, kind: Kind) -> DataFrame:
    """Rows with curated values; a row that is hidden stays hidden."""
    before = F.coalesce("hidden", F.lit(False)) if "hidden" in rows.columns else F.lit(False)
    out = merge.override(rows.withColumn("__was", before), overrides, kind.key, [f for f in kind.fields if f in rows.columns])
    return out.withColumn("hidden", F.col("hidden") | F.col("__was")).drop("__was")


def merged(current: DataFrame, updates: DataFrame, kind: Kind, labels: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """The cache with updates: the latest row of each key with its last known relevance, then labels, then corrections; newest first."""
    rows = current.select("*", F.lit(0).alias("__batch")).unionByName(updates.select("*", F.lit(1).alias("__batch")), allowMissingColumns=True)
    order = ["__batch", *[c for c in ("fetched_at",) if c in rows.columns]]
    rows = rows.withColumn("__tie", F.xxhash64(*[c for c in rows.columns if c != "__batch"]))
    carried = [c for c in ("cpp_relevance",) if c in rows.columns]
    out = merge.upsert(rows, kind.key, [*order, "__tie"], carried).drop("__batch", "__tie")
    if labels is not None:
        out = merge.label(out, labels.select(F.col("item_id").alias(kind.key), "label"), kind.key, "cpp_relevance")
    if overrides is not None:
        unknown = overrides.select(F.explode(F.map_keys("values")).alias("f")).where(~F.col("f").isin(*kind.fields)).first()
        if unknown is not None:
            raise ValueError(f"no correction of {unknown['f']}")
        out = _overridden(out, overrides, kind)
    return out.orderBy(F.desc("published"), kind.key)


def corrected_within(cache: DataFrame, overrides: DataFrame, kind: Kind = VIDEOS) -> DataFrame:
    """A cache with corrections by key; every row stays with its channel, newest first within it."""
    rows = _overridden(cache, overrides, kind)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(kind.source).orderBy(F.desc("published"), kind.key)) - 1)


def pruned(cache: DataFrame, kind: Kind, before: str | None = None, keep: int | None = None, per_source: bool = False) -> DataFrame:
    """The cache without rows before a date and beyond the newest ``keep``, in all or per source; one of both must be given."""
    if before is None and keep is None:
        raise ValueError("pruning needs a date or a number to keep")
    if keep is not None and keep < 0:
        raise ValueError("the number to keep can't be negative")
    rows = cache if before is None else cache.where(F.col("published") >= F.lit(before).cast("timestamp"))
    if keep is None:
        return rows
    newest = [F.desc("published"), F.asc(kind.key)]
    return merge.top_n(rows, kind.source, newest, keep) if per_source else rows.orderBy(*newest).limit(keep)


def post_records(cache: DataFrame) -> DataFrame:
    """Published records of posts: id, title, source, url, published, description, tags and relevance; hidden ones are left out."""
    return cache.where(~F.coalesce("hidden", F.lit(False))).select(
        F.col("post_id").alias("id"), "title", F.col("source_title").alias("source"), "url", F.col("published").cast("string").alias("published"), "description",
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), "cpp_relevance")


def video_records(cache: DataFrame, channels: DataFrame) -> DataFrame:
    """Published records of videos of curated channels (channel_id, title), with the channel's title, newest first."""
    titles = channels.select("channel_id", F.col("title").alias("channel"))
    if not titles.groupBy("channel_id").count().where("count > 1").isEmpty():
        raise ValueError("channel_id is not unique")
    known = cache.where(~F.coalesce("hidden", F.lit(False))).join(broadcast_if_small(titles), "channel_id")
    return known.select(
        F.col("video_id").alias("id"), "title", "channel", "url", F.col("published").cast("string").alias("published"), "thumbnail_url", "description",
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), "cpp_relevance").orderBy(F.desc("published"), "id")


def refresh_posts(cache: DataFrame, fetched: DataFrame, sources: DataFrame, exclusions: DataFrame, labels: DataFrame | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cache, records) after fetched posts of visible sources; posts with a source's excluded tags are hidden, as are those curators hide."""
    visible = sources.where(~F.coalesce("hidden", F.lit(False))).select("source_id")
    updates = fetched.join(broadcast_if_small(visible), "source_id", "left_semi")
    rows = merged(cache, updates, POSTS, labels, overrides)
    rows = rows if "hidden" in rows.columns else rows.withColumn("hidden", F.lit(False))
    marked = merge.hide_by_tag(rows, exclusions, "source_id", "tags", "__tagged").withColumn("hidden", F.coalesce("hidden", F.lit(False)) | F.col("__tagged")).drop("__tagged")
    return marked, post_records(marked)


def refresh_videos(cache: DataFrame, fetched: DataFrame, channels: DataFrame, labels: DataFrame | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cache, records) after fetched videos; channels that aren't curated any more stay in the cache and aren't published."""
    rows = merged(cache, fetched, VIDEOS, labels)
    none = rows.sparkSession.createDataFrame([], "video_id string, values map<string,string>, hidden boolean")
    rows = corrected_within(rows, overrides if overrides is not None else none).drop("place")
    return rows, video_records(rows, channels)


def with_saved(parsed: DataFrame, saved: DataFrame, registries: list[str]) -> DataFrame:
    """Packages of the parsed registries beside the saved ones of all others."""
    unknown = set(registries) - {r["registry"] for r in saved.select("registry").unionByName(parsed.select("registry")).distinct().collect()}  # as many as registries
    if unknown:
        raise ValueError(f"unknown registries {sorted(unknown)}")
    return parsed.where(F.col("registry").isin(*registries)).unionByName(saved.where(~F.col("registry").isin(*registries)), allowMissingColumns=True)


def normal_posts(rows: DataFrame) -> DataFrame:
    """Posts with their id made anew from source and address, and text fields without nulls."""
    texts = {c: F.coalesce(c, F.lit("")) for c in ("title", "source_title", "description") if c in rows.columns}
    return rows.withColumns({**texts, "post_id": short_id(F.col("source_id"), F.col("url"))})


def normal_videos(rows: DataFrame) -> DataFrame:
    """Videos with instants: a date alone is its midnight in UTC."""
    return rows.withColumns({c: F.to_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) if rows.schema[c].dataType.typeName() == "date" else F.col(c).cast("timestamp") for c in ("published", "updated") if c in rows.columns})


def maintain(cache: DataFrame, kind: Kind, command: str, exclusions: DataFrame | None = None, labels: DataFrame | None = None, overrides: DataFrame | None = None, before: str | None = None, keep: int | None = None) -> DataFrame:
    """The cache after ``clean``, ``compact`` or ``prune``: labels, corrections and exclusions are applied anew; only pruning removes rows."""
    if command not in ("clean", "compact", "prune"):
        raise ValueError(f"unknown command: {command}")
    rows = merged(cache, cache.limit(0), kind, labels, overrides)
    if exclusions is not None:
        hidden = F.coalesce("hidden", F.lit(False)) if "hidden" in rows.columns else F.lit(False)
        rows = merge.hide_by_tag(rows.withColumn("__was", hidden), exclusions, kind.source, "tags").withColumn("hidden", F.col("hidden") | F.col("__was")).drop("__was")
    return pruned(rows, kind, before, keep, per_source=kind is VIDEOS) if command == "prune" else rows
