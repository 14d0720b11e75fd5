"""Source connectors as queries: documents are made from whole tables, parsed
back, and held against the tables by SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import calendar
from catalith.plans.core_queries import query
from catalith.sources import feeds, registries
from catalith.util import table


def _xml(c: Column) -> Column:
    """Escaped element text; control characters that XML forbids are dropped."""
    s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query(r"""
SELECT fetch_id::VARCHAR AS id, trim(regexp_replace(title, '^\s+|\s+$', '', 'g')) AS title, len(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: t <> ''))) AS tags
FROM blog_posts WHERE trim(title) <> '' AND trim(url) <> ''
""")
def feed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written as RSS items and parsed back."""
    posts = table(spark, sf_dir, "blog_posts")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), _xml(c), F.lit(f"</{name}>"))
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("<category>"), _xml(t), F.lit("</category>"))), "")
    item = F.concat(F.lit("<rss version='2.0'><channel><item>"), tag("guid", F.col("fetch_id")), tag("title", F.col("title")), tag("link", F.trim("url")), F.lit("<pubDate>Thu, 01 Jan 2026 00:00:00 GMT</pubDate>"), tag("description", F.col("description")), tags, F.lit("</item></channel></rss>"))
    documents = posts.select(F.col("source_id").alias("source"), item.alias("document"))
    return feeds.read_feeds(documents).select("id", "title", F.size("tags").cast("long").alias("tags"))


@query("""
SELECT o_orderkey::VARCHAR AS title, o_orderdate::DATE AS start_date, (o_orderdate::DATE + (o_orderkey % 4)::INT)::DATE AS end_date, o_orderpriority || ', a; b' AS description, 'confirmed' AS status FROM orders
""")
def calendar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as folded iCalendar events and parsed back."""
    day = F.col("o_orderdate").cast("date")
    stamp = lambda c: F.date_format(c, "yyyyMMdd")
    text = F.concat("o_orderpriority", F.lit("\\, a\\; b"))
    folded = F.concat(F.substring(text, 1, 7), F.lit("\r\n "), F.substring(text, 8, 1000))
    event = F.concat(
        F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:"), F.col("o_orderkey").cast("string"), F.lit("\r\nDTSTART;VALUE=DATE:"), stamp(day), F.lit("\r\nDTEND;VALUE=DATE:"),
        stamp(F.date_add(day, (F.col("o_orderkey") % 4).cast("int") + 1)), F.lit("\r\nSUMMARY:"), F.col("o_orderkey").cast("string"), F.lit("\r\nDESCRIPTION:"), folded, F.lit("\r\nSTATUS:OTHER\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    documents = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), event.alias("document"))
    return feeds.read_calendars(documents).select("title", "start_date", "end_date", "description", "status")


@query(r"""
WITH e AS (SELECT n_name AS nation, s_suppkey::VARCHAR AS uid, concat_ws(chr(13) || chr(10), 'BEGIN:VEVENT', 'UID:' || s_suppkey, 'DTSTART;VALUE=DATE:20260101', 'DTEND;VALUE=DATE:20260102', 'SUMMARY:' || s_name,
  'DESCRIPTION:a\, b\; c\nd', 'LOCATION:', 'STATUS:CONFIRMED', 'END:VEVENT') AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT nation, concat_ws(chr(13) || chr(10), 'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//catalith//EN', string_agg(l, chr(13) || chr(10) ORDER BY uid), 'END:VCALENDAR') || chr(13) || chr(10) AS document FROM e GROUP BY nation
""")
def calendar_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(nation, document): one calendar document per nation that has suppliers, of its suppliers as events."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    suppliers = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(
        "nation", F.col("s_suppkey").cast("string").alias("uid"), F.lit("2026-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"),
        F.col("s_name").alias("title"), F.lit("a, b; c\nd").alias("description"), F.lit("").alias("location"), F.lit("confirmed").alias("status"))
    return calendar.ical_feed(suppliers, "catalith", ["nation"])


_PORTS_SQL = "SELECT lower(trim(package_id)) AS pid, trim(lower(release_version)) AS ver FROM package_versions WHERE trim(package_id) <> '' AND trim(release_version) <> ''"


def _ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "package_versions").select(F.lower(F.trim("package_id")).alias("pid"), F.lower(F.trim("release_version")).alias("ver"))
    return rows.where("pid <> '' AND ver <> ''").distinct().withColumn("dir", F.regexp_replace("pid", r"[:/]", "~"))


@query(f"SELECT 'vcpkg:' || pid AS id, count(DISTINCT ver) AS versions, 'https://github.com/' || regexp_replace(pid, '[^a-z0-9]', '-', 'g') || '/x' AS repository_url FROM ({_PORTS_SQL}) GROUP BY pid")
def registry_vcpkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every package written as a port with its version history and parsed back."""
    ports = _ports(spark, sf_dir).groupBy("pid", "dir").agg(F.collect_set("ver").alias("vers"))
    manifest = F.to_json(F.struct(F.col("pid").alias("name"), F.element_at("vers", 1).alias("version"), F.lit("A port").alias("description"), F.lit("MIT").alias("license")))
    history = F.to_json(F.struct(F.transform("vers", lambda v: F.struct(v.alias("version"))).alias("versions")))
    port = F.concat(F.lit("vcpkg_from_github(OUT x REPO "), F.regexp_replace("pid", "[^a-z0-9]", "-"), F.lit('/x REF "v(1)" SHA512 00aa)'))
    files = ports.select(F.explode(F.array(
        F.struct(F.concat(F.lit("ports/"), "dir", F.lit("/vcpkg.json")).alias("path"), manifest.alias("text")), F.struct(F.concat(F.lit("ports/"), "dir", F.lit("/portfile.cmake")).alias("path"), port.alias("text")),
        F.struct(F.concat(F.lit("versions/x-/"), "dir", F.lit(".json")).alias("path"), history.alias("text")))).alias("f")).select("f.*")
    return registries.parse(files, "vcpkg").select("id", F.size("versions").cast("long").alias("versions"), "repository_url")


@query(f"SELECT 'hunter:' || pid AS id, count(DISTINCT ver) AS versions, min('sha1:' || sha1(ver)) AS first_sum FROM ({_PORTS_SQL}) GROUP BY pid")
def registry_hunter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every package written as CMake version calls and parsed back."""
    call = F.concat(F.lit('# a "comment\nhunter_add_version(PACKAGE_NAME "'), "pid", F.lit('" VERSION "'), "ver", F.lit('" URL [[https://x.example/(a).tgz]] SHA1 '), F.upper(F.sha1("ver")), F.lit(")\n"))
    files = _ports(spark, sf_dir).groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list(call)), "").alias("text")).select(F.concat(F.lit("cmake/projects/"), "dir", F.lit("/hunter.cmake")).alias("path"), "text")
    sums = F.transform("versions", lambda v: F.element_at(F.element_at(v["artifacts"], 1)["checksums"], 1))
    return registries.parse(files, "hunter").select("id", F.size("versions").cast("long").alias("versions"), F.array_min(sums).alias("first_sum"))
