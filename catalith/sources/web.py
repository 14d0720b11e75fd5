"""Web pages and JSON answers of services, as rows; fetching them is the caller's step.

Input is a table of raw documents.  JSON is read with declared schemas, HTML with
column expressions; only shell-like keyword lists and address resolution run in
Arrow batches.
"""

from __future__ import annotations

import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from catalith.functions import names
from catalith.functions.text import entities_decoded, feed_text, strip_tags
from catalith.sources.feeds import attributes, favicon, meta_values, title

# Words that mark a picture as a page's own, and classes of a page's subtitle by rank.
AVATAR_WORDS = ["avatar", "logo", "portrait"]
SUBTITLES = [("site-subtitle", 4), ("site-description", 3), ("tagline", 2), ("subtitle", 1)]

_CHANNEL = "title string, description string, keywords string, channelUrl string, vanityChannelUrl string, avatar struct<thumbnails:array<struct<url:string,width:int>>>"
_INVITE = "guild struct<id:string,name:string,description:string,icon:string,banner:string>, approximate_member_count long"
_TAGS = "items array<struct<tag_name:string,excerpt:string>>"
_NAMED = "array<struct<name:string>>"
_EDITION = (
    f"title string, subtitle string, url string, publish_date string, number_of_pages int, authors {_NAMED}, publishers {_NAMED}, subjects {_NAMED}, "
    "cover struct<large:string>, identifiers struct<isbn_13:array<string>,isbn_10:array<string>>"
)
_WORK = "docs array<struct<key:string,author_name:array<string>,subject:array<string>,ratings_average:double,ratings_count:long>>"


@F.pandas_udf(ArrayType(StringType()))
def shell_words(values: pd.Series) -> pd.Series:
    """Words of a shell-like list; a list with open quotes is split at blanks."""

    def one(v: str | None) -> list[str]:
        try:
            return shlex.split(v or "")
        except ValueError:
            return (v or "").split()

    return values.map(one)


def nearest_image(sources: Column, width: int) -> Column:
    """Address of the picture whose width is closest; the first of equals, '' for none."""
    ranked = F.transform(sources, lambda s, i: F.struct(F.abs(F.coalesce(s["width"], F.lit(0)) - width).alias("off"), i.alias("i"), s["url"].alias("url")))
    return F.coalesce(F.array_min(ranked)["url"], F.lit(""))


def _object_after(page: Column, marker: str) -> Column:
    """The JSON text that follows a marker; readers stop at the object's end."""
    return F.regexp_extract(page, r"(?s)" + marker + r"\s*(\{.*)", 1)


def channels(pages: DataFrame) -> DataFrame:
    """(source, url, description, keywords, avatar_url, about_url) of video channel pages (source, document)."""
    raw = _object_after(F.col("document"), '"channelMetadataRenderer":')
    read = pages.withColumn("c", F.from_json(_balanced(raw), _CHANNEL)).where("c IS NOT NULL")
    url = F.coalesce(F.nullif("c.vanityChannelUrl", F.lit("")), F.nullif("c.channelUrl", F.lit("")), F.lit(""))
    return read.select("source", url.alias("url"), F.trim(F.coalesce("c.description", F.lit(""))).alias("description"), shell_words("c.keywords").alias("keywords"), nearest_image(F.col("c.avatar.thumbnails"), 900).alias("avatar_url"), F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/about")).alias("about_url"))


@F.pandas_udf(StringType())
def _balanced(values: pd.Series) -> pd.Series:
    """The first complete JSON object of each text."""
    import json

    def one(v: str | None) -> str | None:
        try:
            _, end = json.JSONDecoder().raw_decode(v or "")
            return v[:end]
        except ValueError:
            return None

    return values.map(one)


def avatar(page: Column, base: Column) -> Column:
    """A labelled picture in the header, else on the page, else the page's icon; '' for none."""
    label = lambda t: F.lower(F.concat_ws(" ", F.try_element_at(t, F.lit("class")), F.try_element_at(t, F.lit("alt"))))

    def labelled(area: Column) -> Column:
        tags = F.transform(F.regexp_extract_all(area, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0)), attributes)
        return F.transform(F.filter(tags, lambda t: label(t).rlike("|".join(AVATAR_WORDS))), lambda t: F.coalesce(F.try_element_at(t, F.lit("src")), F.lit("")))

    header = F.regexp_extract(page, r"(?is)<header\b[^>]*>(.*?)</header>", 1)
    found = F.filter(F.concat(labelled(header), labelled(page)), lambda u: (u != "") & ~u.rlike(r"^(?:https?://[^/]+)?/?$"))
    best = F.coalesce(F.try_element_at(found, F.lit(1)), favicon(page))
    return names.image_url(base, best)


def subtitle(page: Column) -> Column:
    """Text of the element whose class ranks highest as a page's subtitle; ties go to the greater text."""
    elements = F.regexp_extract_all(page, F.lit(r"(?is)<(?:p|div|span|h[1-6])\b[^>]*>.*?</(?:p|div|span|h[1-6])>"), F.lit(0))
    rank = lambda c: F.coalesce(*[F.when(c.contains(n), s) for n, s in SUBTITLES], F.lit(0))
    ranked = F.transform(elements, lambda e: F.struct(rank(F.lower(F.coalesce(F.try_element_at(attributes(F.regexp_extract(e, r"^(<[^>]*>)", 1)), F.lit("class")), F.lit("")))).alias("s"), feed_text(e, 320).alias("t")))
    return F.coalesce(F.array_max(F.filter(ranked, lambda r: (r["s"] > 0) & (r["t"] != "")))["t"], F.lit(""))


def pages(documents: DataFrame) -> DataFrame:
    """(source, url, description, keywords, avatar_url) of home pages (source, url, document)."""
    read = documents.withColumns({"m": meta_values(F.col("document")), "sub": subtitle(F.col("document")), "title": title(F.col("document"))})
    said = lambda k: F.nullif(F.trim(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))), F.lit(""))
    second = F.regexp_extract("title", r"\s+[–—|]\s+(.*)$", 1)
    description = F.coalesce(F.nullif("sub", F.lit("")), said("og:description"), said("description"), second)
    return read.select("source", "url", entities_decoded(strip_tags(description)).alias("description"), names.clean_list(F.split(F.coalesce(said("keywords"), F.lit("")), ",")).alias("keywords"), avatar(F.col("document"), F.col("url")).alias("avatar_url"))


def _style_image(page: Column, community: Column, name: str) -> Column:
    """Address of a community's picture among a page's style files; '' for none."""
    found = F.filter(F.regexp_extract_all(page, F.lit(rf"""(?i)https?://styles\.redditmedia\.com/[^/"' <>]+/styles/{name}[^"' <>]+"""), F.lit(0)), lambda u: F.lower(u).contains(F.concat(F.lit("redditmedia.com/"), F.lower(community), F.lit("/styles/"))))
    plain = entities_decoded(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")))
    return F.regexp_replace(F.regexp_extract(plain, r"""^([^"' <>]*)""", 1), r"[);]+$", "")


def forums(documents: DataFrame) -> DataFrame:
    """(source, description, avatar_url, banner_url, weekly_visitors, weekly_contributions) of forum pages (source, document).

    All is in the attributes of the page's header element, pictures also among its
    style files; a page without that element is an error.
    """
    header = F.regexp_extract("document", r"<shreddit-subreddit-header\s+([^>]+)>", 1)
    checked = documents.where("document IS NOT NULL").withColumn("h", F.when(header != "", header).otherwise(F.raise_error(F.concat(F.lit("no community in page of "), F.col("source"))).cast("string")))
    read = checked.withColumn("a", attributes(F.col("h")))
    said = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at("a", F.lit(k)), F.lit("")) for k in keys])
    here = F.coalesce(said("subreddit-id"), F.lit(""))
    picture = lambda name, *keys: entities_decoded(F.coalesce(said(*keys), _style_image(F.col("document"), here, name)))
    return read.select(
        "source", F.trim(entities_decoded(F.coalesce(said("description"), F.lit("")))).alias("description"),
        picture("communityIcon", "icon-url", "community-icon").alias("avatar_url"), picture("bannerBackgroundImage", "banner-background-image", "banner-img", "mobile-banner-image").alias("banner_url"),
        said("weekly-active-users").alias("weekly_visitors"), said("weekly-contributions").alias("weekly_contributions"))


def communities(documents: DataFrame) -> DataFrame:
    """(source, description, avatar_url, banner_url, members) by kind: discord, stackoverflow, reddit or web (source, kind, url, document).

    Another kind is an error.
    """
    invite, tags = F.from_json("document", _INVITE), F.from_json("document", _TAGS)
    kinds = ("discord", "stackoverflow", "reddit", "web")
    known = documents.withColumn("kind", F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown community: "), F.coalesce("kind", F.lit("null")))).cast("string")))
    blank = F.lit("")
    image = lambda part, hash_, ending: F.when(F.coalesce(hash_, blank) != "", F.concat(F.lit(f"https://cdn.discordapp.com/{part}/"), invite["guild"]["id"], F.lit("/"), hash_, F.lit(ending))).otherwise(blank)
    meta = meta_values(F.col("document"))
    said = lambda k: F.coalesce(F.try_element_at(meta, F.lit(k)), blank)
    is_ = lambda k: F.col("kind") == k
    out = known.where(~is_("reddit")).select(
        "source", "url",
        F.when(is_("discord"), F.coalesce(invite["guild"]["description"], blank)).when(is_("stackoverflow"), F.coalesce(F.try_element_at(tags["items"], F.lit(1))["excerpt"], blank)).otherwise(F.coalesce(F.nullif(said("og:description"), blank), said("description"))).alias("description"),
        F.when(is_("discord"), image("icons", invite["guild"]["icon"], ".png?size=512")).when(is_("web"), F.coalesce(F.nullif(said("og:logo"), blank), favicon(F.col("document")))).otherwise(blank).alias("avatar_url"),
        F.when(is_("discord"), image("banners", invite["guild"]["banner"], ".jpg?size=1024")).when(is_("web"), said("og:image")).otherwise(blank).alias("banner_url"),
        F.when(is_("discord"), invite["approximate_member_count"]).alias("members"))
    resolve = lambda c: F.when(F.col(c) == "", blank).otherwise(names.image_url("url", c)).alias(c)
    others = out.select("source", F.trim("description").alias("description"), resolve("avatar_url"), resolve("banner_url"), "members")
    return others.unionByName(forums(known.where(is_("reddit"))).select("source", "description", "avatar_url", "banner_url", F.lit(None).cast("long").alias("members")))


def books(editions: DataFrame, works: DataFrame) -> DataFrame:
    """One row per ISBN from edition and work answers (isbn, document); both must be there."""
    e = editions.select("isbn", F.from_json("document", _EDITION).alias("e"))
    w = works.select("isbn", F.try_element_at(F.from_json("document", _WORK)["docs"], F.lit(1)).alias("w"))
    both = e.join(w, "isbn").where("e IS NOT NULL AND w IS NOT NULL")
    texts = lambda c: F.coalesce(F.transform(c, lambda x: x["name"]), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    heading = names.split_title(F.coalesce("e.title", F.lit("")), F.coalesce("e.subtitle", F.lit("")))
    thirteen = F.coalesce(F.try_element_at(F.col("e.identifiers.isbn_13"), F.lit(1)), F.col("isbn"))
    listed = F.when(F.size(texts(F.col("e.subjects"))) > 0, texts(F.col("e.subjects"))).otherwise(F.coalesce("w.subject", none))
    return both.select(
        "isbn", heading["title"].alias("title"), heading["subtitle"].alias("subtitle"), names.clean_list(F.concat(texts(F.col("e.authors")), F.coalesce("w.author_name", none))).alias("authors"),
        thirteen.alias("isbn_13"), F.coalesce(F.try_element_at(F.col("e.identifiers.isbn_10"), F.lit(1)), names.isbn10(thirteen)).alias("isbn_10"), F.array_join(texts(F.col("e.publishers")), ", ").alias("publisher"),
        F.col("e.publish_date").alias("publish_date"), F.col("e.number_of_pages").alias("pages"), F.coalesce("e.cover.large", F.lit("")).alias("cover_url"), F.col("w.key").alias("work_key"), names.subjects(listed).alias("subjects"),
        F.when(F.coalesce("w.ratings_count", F.lit(0)) > 0, F.round("w.ratings_average", 3)).alias("rating"), F.coalesce("w.ratings_count", F.lit(0).cast("long")).alias("rating_count"))
