"""Publishing, maintenance and presentation as queries over whole tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import names, presentation
from catalith.operators import changefeed, collection, jobs, summaries, termindex
from catalith.plans.core_queries import _BEFORE_SQL, _KEYED, CHUNK, TERMS, _snapshots, query
from catalith.sources import instances, web
from catalith.util import clean_id, table

_SIZES_SQL = "SELECT row_number() OVER (ORDER BY op_id) - 1 AS position, octet_length(encode(concat_ws('|', collection_name, id, title, content, url))) + 1 AS size FROM browser_changes"


@query(f"""
WITH RECURSIVE s AS ({_SIZES_SQL}), r AS (
  SELECT position, 0 AS container, size AS used FROM s WHERE position = 0
  UNION ALL SELECT s.position, CASE WHEN r.used + s.size > 4096 THEN r.container + 1 ELSE r.container END, CASE WHEN r.used + s.size > 4096 THEN s.size ELSE r.used + s.size END FROM r JOIN s ON s.position = r.position + 1)
SELECT container, count(*) AS operations, max(used)::BIGINT AS bytes, min(position) AS start FROM r GROUP BY container
""")
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cut into chunks that are filled to the byte."""
    from catalith.operators import changelog

    ops = table(spark, sf_dir, "browser_changes")
    sized = ops.select("op_id", (F.octet_length(F.concat_ws("|", "collection_name", "id", "title", "content", "url")) + 1).cast("long").alias("size"), F.lit(0).cast("long").alias("surcharge"))
    items = changelog.positions(sized, ["op_id"]).select("position", "size", "surcharge")
    placed = items.join(collection.next_fit(items, 4096), "position")
    return placed.groupBy("container").agg(F.count("*").alias("operations"), F.sum("size").alias("bytes"), F.min("position").alias("start"))


@query(_KEYED.format(changefeed.P6_STATE_SQL).replace("SELECT collection_name", "SELECT DISTINCT collection_name"))
def collection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection published from one snapshot, updated to the next, and read back from its log."""
    before, after = _snapshots(spark, sf_dir)
    record = lambda df: df.select(F.col("key").alias("id"), "title", "content", "url")
    log, manifest = collection.update(None, record(before), chunk_bytes=collection.LEAST_CHUNK_BYTES)
    log, _ = collection.update(log, record(after), manifest, chunk_bytes=collection.LEAST_CHUNK_BYTES)
    read = lambda c: F.get_json_object("operation", f"$.{c}").alias(c)
    return collection.current(log).select(F.col("id").alias("key"), read("title"), read("content"), read("url"))


@query(f"""
WITH b AS ({_KEYED.format(_BEFORE_SQL)}), a AS ({_KEYED.format(changefeed.P6_STATE_SQL)})
SELECT (SELECT count(*) FROM b) + (SELECT count(*) FROM a LEFT JOIN b USING (key) WHERE b.key IS NULL OR (a.title, a.content, a.url) IS DISTINCT FROM (b.title, b.content, b.url)) + (SELECT count(*) FROM b ANTI JOIN a USING (key)) AS operations, 2 AS revision, 1 AS epoch, true AS fits
""")
def collection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two publications append, and that every chunk of several operations keeps its limit."""
    before, after = _snapshots(spark, sf_dir)
    record = lambda df: df.select(F.col("key").alias("id"), "title", "content", "url")
    log, manifest = collection.update(None, record(before), chunk_bytes=collection.LEAST_CHUNK_BYTES)
    log, manifest = collection.update(log, record(after), manifest, chunk_bytes=collection.LEAST_CHUNK_BYTES)
    chunks = collection.chunk_texts(log)
    fits = F.min((F.col("bytes") <= collection.LEAST_CHUNK_BYTES) | (F.col("operations") == 1))
    return chunks.agg(F.sum("operations").alias("operations"), F.lit(manifest["revision"]).alias("revision"), F.lit(manifest["epoch"]).alias("epoch"), fits.alias("fits"))


@query(f"""
SELECT min(term) AS first_term, max(term) AS last_term, count(DISTINCT term) AS terms, true AS fits FROM (SELECT unnest(regexp_extract_all(lower(text), {TERMS})) AS term FROM documents) WHERE length(term) >= 2
""")
def route_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routing lexicon of all documents: its ends, its terms, and that every segment of several terms keeps its limit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = termindex.postings(docs, {"content": ["text"]}, F.floor(F.col("doc_id") / (16 * CHUNK)).cast("long"))
    chunks = (docs.agg(F.max("doc_id")).first()[0] or 0) // (16 * CHUNK) + 1
    made = collection.routes(index, chunks)
    fits = F.min((F.octet_length("text") <= collection.ROUTE_BYTES) | (F.col("terms") == 1))
    return made.agg(F.min("first").alias("first_term"), F.max("last").alias("last_term"), F.sum("terms").alias("terms"), fits.alias("fits"))


# entities and their packages

_PACKAGE_SQL = "SELECT lower(trim(package_id)) AS package_id, split_part(lower(trim(package_id)), ':', 1) AS registry, min(lower(package_name)) AS name, max(summary) AS summary, max(description) AS description, max(homepage) AS homepage, max(repository_url) AS repository_url FROM package_versions GROUP BY ALL"


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "package_versions").groupBy(clean_id("package_id").alias("package_id")).agg(
        F.min(F.lower("package_name")).alias("name"), *[F.max(c).alias(c) for c in ("summary", "description", "homepage", "repository_url")])
    none = F.array().cast("array<string>")
    return rows.withColumns({"registry": F.substring_index("package_id", ":", 1), "licenses": none, "topics": none, "documentation_url": F.lit(None).cast("string")})


def _named_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of one name as an entity, so that SQL can follow."""
    rows = _variants(spark, sf_dir).where("name IS NOT NULL")
    return rows.groupBy(F.col("name").alias("id")).agg(F.min("name").alias("name"), F.array_sort(F.collect_set("package_id")).alias("packages")).withColumn("aliases", F.array().cast("array<string>"))


_QUALITY = "CASE registry WHEN 'vcpkg' THEN 50 WHEN 'cppget' THEN 45 WHEN 'conan' THEN 40 WHEN 'xmake' THEN 35 WHEN 'spack' THEN 30 WHEN 'bazel' THEN 25 WHEN 'meson' THEN 20 WHEN 'hunter' THEN 15 ELSE 0 END"


@query(f"""
WITH p AS ({_PACKAGE_SQL}), e AS (SELECT name AS id, count(*) AS packages, count(DISTINCT registry) AS managers FROM p WHERE name IS NOT NULL GROUP BY name),
w AS (SELECT *, package_id = (SELECT min(package_id) FROM p q WHERE q.name = p.name AND coalesce(q.homepage, '') <> '' AND q.registry = 'spack') AS wish FROM p WHERE coalesce(homepage, '') <> ''),
h AS (SELECT name AS id, arg_max(package_id, (coalesce(wish, false), {_QUALITY}, -length(homepage), package_id)) AS homepage_source, arg_max(homepage, (coalesce(wish, false), {_QUALITY}, -length(homepage), package_id)) AS homepage FROM w GROUP BY name)
SELECT id, packages, managers, homepage, homepage_source FROM e LEFT JOIN h USING (id)
""")
def entity_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary per entity; spack's pages are preferred."""
    packages = _variants(spark, sf_dir)
    wish = packages.where("registry = 'spack' AND name IS NOT NULL AND coalesce(homepage, '') <> ''").groupBy(F.col("name").alias("entity_id")).agg(F.min("package_id").alias("source"))
    made = summaries.summaries(_named_entities(spark, sf_dir), packages.drop("name"), wish.select("entity_id", F.lit("homepage").alias("field"), "source"))
    return made.select("id", F.size("packages").cast("long").alias("packages"), F.size("managers").cast("long").alias("managers"), "homepage", "homepage_source")


@query(f"WITH p AS ({_PACKAGE_SQL}) SELECT registry, count(DISTINCT name) AS entities FROM p WHERE starts_with(name, 'b') GROUP BY registry")
def found_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities per registry among those that a search found."""
    return summaries.manager_counts(_named_entities(spark, sf_dir).where(F.col("name").startswith("b")))


@query(f"WITH p AS ({_PACKAGE_SQL}) SELECT name AS id, count(*) AS packages FROM p WHERE name IS NOT NULL GROUP BY name ORDER BY name LIMIT 30")
def entity_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.preview(_named_entities(spark, sf_dir)).select("id", F.size("packages").cast("long").alias("packages"))


@query(f"WITH p AS ({_PACKAGE_SQL}) SELECT name AS id, package_id, CASE WHEN registry <> 'conan' THEN homepage END AS homepage FROM p WHERE name IS NOT NULL")
def entity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details of every package of every entity; one registry's are missing."""
    details = _variants(spark, sf_dir).where("registry <> 'conan'").select("package_id", "homepage")
    return presentation.details_of(_named_entities(spark, sf_dir), details).select("id", "package_id", F.col("detail.homepage").alias("homepage"))


@query("""
WITH r AS (SELECT release_id, lower(trim(package_id)) AS p, summary, homepage FROM package_versions), i AS (SELECT p, max(summary) AS s, max(homepage) AS h FROM r GROUP BY p),
d AS (SELECT p, release_id, CASE WHEN summary IS NOT NULL AND summary IS DISTINCT FROM s THEN summary END AS s, CASE WHEN homepage IS NOT NULL AND homepage IS DISTINCT FROM h THEN homepage END AS h FROM r JOIN i USING (p)),
g AS (SELECT p, s, h, count(*) AS n FROM d WHERE s IS NOT NULL OR h IS NOT NULL GROUP BY ALL)
SELECT p AS package_id, count(*) FILTER (n = 1) AS alone, count(*) FILTER (n > 1) AS shared, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS releases FROM g GROUP BY p
""")
def release_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What releases show differently from their package, alone or together."""
    rows = table(spark, sf_dir, "package_versions").select(clean_id("package_id").alias("package_id"), "release_id", "summary", "homepage")
    own, groups = summaries.release_delta(rows, rows.groupBy("package_id").agg(F.max("summary").alias("summary"), F.max("homepage").alias("homepage")), ["summary", "homepage"])
    both = own.select("package_id", F.lit(1).alias("alone"), F.lit(0).alias("shared"), F.lit(0).alias("releases")).unionByName(groups.select("package_id", F.lit(0).alias("alone"), F.lit(1).alias("shared"), F.size("releases").alias("releases")))
    return both.groupBy("package_id").agg(*[F.sum(c).alias(c) for c in ("alone", "shared", "releases")])


@query(r"""
WITH a AS (SELECT release_id, registry, list_filter(coalesce(artifacts, []), lambda x: x.url IS NOT NULL AND trim(x.url, ' ') <> '') AS x FROM package_versions)
SELECT release_id, CASE WHEN registry IN ('cppget', 'meson') THEN 'registry_package' ELSE 'upstream_source' END AS kind, len(list_distinct(list_transform(x, lambda y: trim(y.url, ' ')))) AS artifacts FROM a WHERE len(x) > 0
""")
def normalised_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address lists of all releases as typed artifacts."""
    urls = F.transform("artifacts", lambda a: a["url"])
    rows = table(spark, sf_dir, "package_versions").select("release_id", "registry", F.col("release_version").alias("version"), F.lit(None).cast("array<struct<kind:string,url:string,checksums:array<string>>>").alias("artifacts"), urls.alias("source_urls"), F.lit(None).cast("array<string>").alias("checksums"))
    made = summaries.normalise_package(rows).where(F.size("artifacts") > 0)
    return made.select("release_id", F.element_at("artifacts", 1)["kind"].alias("kind"), F.size("artifacts").cast("long").alias("artifacts"))


# jobs

_MERGED_SQL = """
SELECT post_id, arg_max(fetch_id, k) AS fetch_id, arg_max(title, k) AS title, arg_max(cpp_relevance, k) FILTER (cpp_relevance IS NOT NULL) AS cpp_relevance
FROM (SELECT *, (fetched_at >= TIMESTAMP '2024-06-01', fetched_at) AS k FROM (SELECT * REPLACE (coalesce(title, '') AS title) FROM blog_posts WHERE fetched_at IS NOT NULL)) GROUP BY post_id
"""


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "blog_posts").where("fetched_at IS NOT NULL").withColumn("title", F.coalesce("title", F.lit("")))
    late = F.col("fetched_at") >= F.lit("2024-06-01").cast("timestamp")
    return rows.where(~late), rows.where(late)


@query(_MERGED_SQL)
def posts_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of posts with later fetches merged into it."""
    return jobs.merged(*_cache(spark, sf_dir), jobs.POSTS).select("post_id", "fetch_id", "title", "cpp_relevance")


@query("""
WITH f AS (SELECT * FROM blog_posts WHERE fetched_at IS NOT NULL), old AS (SELECT * FROM f WHERE fetched_at < TIMESTAMP '2024-06-01'), new AS (SELECT f.* FROM f JOIN blog_sources USING (source_id) WHERE fetched_at >= TIMESTAMP '2024-06-01' AND discoverable),
l AS (SELECT post_id, arg_max({'h': hidden, 't': tags, 's': source_id}, (b, fetched_at)) AS r FROM (SELECT *, 0 AS b FROM old UNION ALL SELECT *, 1 FROM new) GROUP BY post_id)
SELECT post_id AS id, coalesce(len(r.t), 0)::BIGINT AS tags FROM l WHERE NOT coalesce(r.h, false) AND NOT list_contains(list_transform(coalesce(r.t, []), lambda t: lower(trim(t))), 'release')
""")
def refreshed_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a refresh publishes."""
    sources = table(spark, sf_dir, "blog_sources").select("source_id", (~F.col("discoverable")).alias("hidden"))
    excluded = sources.select("source_id", F.lit("Release").alias("tag"))
    _, records = jobs.refresh_posts(*_cache(spark, sf_dir), sources, excluded)
    return records.select("id", F.coalesce(F.size("tags"), F.lit(0)).cast("long").alias("tags"))


@query("SELECT fetch_id, source_id FROM blog_posts WHERE fetched_at >= TIMESTAMP '2023-01-01' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, fetch_id) <= 5")
def pruned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five posts of each source since a date."""
    rows = table(spark, sf_dir, "blog_posts").select("fetch_id", "source_id", F.col("fetched_at").alias("published"))
    kind = jobs.Kind("fetch_id", (), "source_id")
    return jobs.pruned(rows, kind, "2023-01-01", 5, per_source=True).select("fetch_id", "source_id")


@query("""
SELECT f.post_id || '/' || f.fetch_id AS id, s.source_title AS channel FROM blog_posts f JOIN (SELECT * FROM blog_sources WHERE discoverable) s USING (source_id) WHERE NOT coalesce(f.hidden, false)
""")
def channel_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of curated sources with the source's title."""
    rows = table(spark, sf_dir, "blog_posts").select(F.concat_ws("/", "post_id", "fetch_id").alias("video_id"), F.col("source_id").alias("channel_id"), "title", "url", F.col("fetched_at").alias("published"), F.lit("").alias("thumbnail_url"), "description", "tags", "cpp_relevance", "hidden")
    channels = table(spark, sf_dir, "blog_sources").where("discoverable").select(F.col("source_id").alias("channel_id"), F.col("source_title").alias("title"))
    return jobs.video_records(rows, channels).select("id", "channel")


# presentation

_NAMES_SQL = "SELECT DISTINCT registry, package_name AS name FROM package_versions WHERE package_name IS NOT NULL AND regexp_matches(package_name, '^[A-Za-z0-9._-]+$')"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "package_versions").select("registry", F.col("package_name").alias("name"))
    return rows.where(F.col("name").rlike("^[A-Za-z0-9._-]+$")).distinct()


@query(f"""
SELECT registry, name, CASE registry WHEN 'conan' THEN 'https://conan.io/center/recipes/' || name WHEN 'vcpkg' THEN 'https://vcpkg.io/en/package/' || name WHEN 'spack' THEN 'https://packages.spack.io/package.html?name=' || name
  WHEN 'meson' THEN 'https://mesonbuild.com/Wrapdb-projects.html' WHEN 'cppget' THEN 'https://cppget.org/' || name WHEN 'hunter' THEN 'https://hunter.readthedocs.io/en/latest/packages/pkg/' || name || '.html'
  WHEN 'bazel' THEN 'https://registry.bazel.build/modules/' || name WHEN 'xmake' THEN 'https://packages.xmake.io/packages/' || name ELSE '' END AS url FROM ({_NAMES_SQL})
""")
def registry_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("registry", "name", presentation.site_url(F.col("registry"), F.col("name")).alias("url"))


@query(f"""
SELECT registry, name, CASE registry WHEN 'conan' THEN '[requires]' || chr(10) || name || '/1.0' WHEN 'vcpkg' THEN '"' || name || '"' WHEN 'spack' THEN 'spack:' || chr(10) || '  specs:' || chr(10) || '  - ' || name || '@1.0'
  WHEN 'meson' THEN 'subproject(''' || name || ''')' WHEN 'bazel' THEN 'bazel_dep(name = "' || name || '", version = "1.0")' WHEN 'cppget' THEN 'depends: ' || name || ' ^1.0'
  WHEN 'hunter' THEN 'hunter_add_package(' || name || ')' WHEN 'xmake' THEN 'add_requires("' || name || ' 1.0")' ELSE '' END AS snippet FROM ({_NAMES_SQL})
""")
def consumer_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("registry", "name", presentation.consumer_snippet(F.col("registry"), F.col("name"), F.lit("1.0")).alias("snippet"))


@query(r"""
WITH e AS (SELECT DISTINCT unnest(licenses) AS x FROM package_versions), s AS (SELECT x, regexp_matches(x, '^[A-Za-z0-9][A-Za-z0-9.+-]*$') OR regexp_matches(x, '\s(?:AND|OR|WITH)\s|[()]') AS ex FROM e WHERE x IS NOT NULL)
SELECT x AS licence, CASE WHEN ex THEN len(regexp_extract_all(x, '\s+|[()]|[^\s()]+')) ELSE 1 END AS tokens, CASE WHEN ex THEN len(list_filter(regexp_extract_all(x, '[^\s()]+'), lambda t: t NOT IN ('AND', 'OR', 'WITH'))) ELSE 0 END AS linked FROM s
""")
def licence_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "package_versions").select(F.explode("licenses").alias("licence")).where("licence IS NOT NULL").distinct()
    cut = rows.withColumn("t", presentation.licence_tokens(F.col("licence")))
    return cut.select("licence", F.size("t").cast("long").alias("tokens"), F.size(F.filter("t", lambda t: t["url"] != "")).cast("long").alias("linked"))


@query("SELECT p_partkey, lower(concat_ws(' ', p_name, p_brand, p_type, 'brand', p_brand, 'x')) AS search FROM part")
def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = presentation.card_text(F.col("p_name"), F.col("p_brand"), F.array("p_type"), F.create_map(F.lit("brand"), F.col("p_brand")), F.array(F.lit("X")))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("search"))


@query(r"""
SELECT lower(trim(package_id)) AS pid, arg_max(v, list_transform(string_split(v, '.'), lambda x: x::BIGINT)) AS latest FROM (SELECT package_id, trim(release_version) AS v FROM package_versions) WHERE regexp_matches(v, '^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$') GROUP BY 1
""")
def latest_semver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest plain semantic version of each package."""
    rows = table(spark, sf_dir, "package_versions").select(clean_id("package_id").alias("pid"), F.trim("release_version").alias("v"))
    return rows.where(F.col("v").rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$")).groupBy("pid").agg(F.max_by("v", presentation.semver_key(F.col("v"))).alias("latest"))


@query("""
WITH n AS (SELECT source_id, fetch_id FROM blog_posts WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC NULLS LAST, fetch_id) <= 3)
SELECT source_id, coalesce(nullif(trim(locale), ''), zone_name) AS note, count(n.fetch_id) AS latest FROM blog_sources LEFT JOIN n USING (source_id) GROUP BY ALL
""")
def source_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of all sources with a fallback and their three newest posts."""
    sources = table(spark, sf_dir, "blog_sources")
    rows = presentation.cards(sources.select("source_id", F.trim("locale").alias("note")), sources.select("source_id", "zone_name"), "source_id", fallback={"note": "zone_name"})
    posts = table(spark, sf_dir, "blog_posts").select("source_id", "fetched_at", "fetch_id")
    return presentation.latest_of(rows, posts, "source_id", "fetched_at", 3).select("source_id", "note", F.size("latest").cast("long").alias("latest"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 12 OFFSET 24")
def card_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.page_of(table(spark, sf_dir, "part"), [F.col("p_name"), F.col("p_partkey")], 4, 3, 2).select("p_partkey", "p_name")


@query("SELECT e_kind, id, start_date FROM (SELECT 'own' AS e_kind, o_orderkey AS id, o_orderdate::DATE AS start_date FROM orders UNION ALL SELECT 'imported', event_id, ts::DATE FROM events)")
def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and imported events together, by start."""
    own = table(spark, sf_dir, "orders").select(F.lit("own").alias("e_kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("start_date"))
    imported = table(spark, sf_dir, "events").select(F.lit("imported").alias("e_kind"), F.col("event_id").alias("id"), F.col("ts").cast("date").alias("start_date"))
    return own.unionByName(imported).orderBy("start_date", "id")


@query(r"""
WITH r AS (SELECT package_name AS name, trim(release_version) AS version FROM package_versions WHERE package_name IS NOT NULL AND trim(release_version) <> '')
SELECT name, version, 'https://x.example/' || name || '/' || version || '-' || replace(version, '.', '') || '.tgz' AS url, 'sha256:' || sha256(version) AS checksum FROM r GROUP BY ALL
""")
def united_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases as evaluated on platforms, united by name and version."""
    rows = table(spark, sf_dir, "package_versions").select(F.col("package_name").alias("name"), F.trim("release_version").alias("version"), "registry").where("name IS NOT NULL AND version <> ''")
    evaluated = rows.select("name", F.array("version").alias("versions"), F.array(F.concat(F.lit("https://x.example/"), "name", F.lit("/$(version)-$(version_nodot).tgz"))).alias("urls"), F.create_map("version", F.array(F.upper(F.sha2("version", 256)), F.lit("abc"))).alias("hashes"))
    return instances.united_versions(evaluated).select("name", "version", F.element_at("source_urls", 1).alias("url"), F.element_at("checksums", 1).alias("checksum"))


@query("""
SELECT source_id AS source, 'About ' || replace(replace(coalesce(source_title, ''), '&', 'and'), '<', '') AS description, rtrim(website_url, '/') || '/logo.png' AS avatar_url FROM blog_sources
WHERE regexp_matches(website_url, '^https?://[^/?#]+/?$')
""")
def home_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home pages written from all sources and read back."""
    title = F.replace(F.replace(F.coalesce("source_title", F.lit("")), F.lit("&"), F.lit("and")), F.lit("<"), F.lit(""))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><header><img class='logo' src='./a/../logo.png'></header><p class='site-description'>About "), title, F.lit("</p></body></html>"))
    documents = table(spark, sf_dir, "blog_sources").where(F.col("website_url").rlike(r"^https?://[^/?#]+/?$")).select(F.col("source_id").alias("source"), F.col("website_url").alias("url"), page.alias("document"))
    return web.pages(documents).select("source", "description", "avatar_url")


@query("SELECT source_id AS source, 'a & ' || source_id AS description, 'https://styles.redditmedia.com/t5_' || source_id || '/styles/communityIcon_1.png' AS avatar_url FROM blog_sources WHERE regexp_matches(source_id, '^[A-Za-z0-9_-]+$')")
def forum_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community pages written from all sources and read back."""
    page = F.concat(F.lit('<shreddit-subreddit-header subreddit-id="t5_'), "source_id", F.lit('" description=" a &amp; '), "source_id", F.lit('"><i style="url(https://styles.redditmedia.com/t5_'), "source_id", F.lit('/styles/communityIcon_1.png);">'))
    documents = table(spark, sf_dir, "blog_sources").where(F.col("source_id").rlike("^[A-Za-z0-9_-]+$")).select(F.col("source_id").alias("source"), page.alias("document"))
    return web.forums(documents).select("source", "description", "avatar_url")


@query(r"SELECT release_id, regexp_replace(lower(coalesce(homepage, '')), '^\s+|\s+$', '', 'g') <> '' AS stated FROM package_versions")
def stated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "package_versions").select("release_id", (names.without_empty(F.trim(F.regexp_replace(F.coalesce("homepage", F.lit("")), r"^\s+|\s+$", "")), "text").isNotNull()).alias("stated"))


@query(f"""
WITH p AS (SELECT lower(trim(package_id)) AS package_id, release_id, trim(release_version) AS v, coalesce(channel, '') AS c, release_id AS place FROM package_versions WHERE trim(release_version) <> '')
SELECT package_id, count(DISTINCT v || CASE WHEN c <> '' THEN '@' || c ELSE '' END) AS versions, arg_min(first, v || CASE WHEN c <> '' THEN '@' || c ELSE '' END) AS first_place FROM (
  SELECT *, max(place) OVER (PARTITION BY package_id, v, c) AS first FROM p) GROUP BY package_id
""")
def version_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The releases of each package under their ids; of repeated ones the last counts."""
    rows = table(spark, sf_dir, "package_versions").select(clean_id("package_id").alias("package_id"), F.col("release_id").alias("place"), F.trim("release_version").alias("version"), F.lit("").alias("upstream_version"), F.lit("").alias("packaging_revision"), "channel", "release_id")
    made = summaries.version_map(rows.where("version <> ''"), ["release_id"])
    first = F.element_at(F.map_values("versions"), 1)["release_id"]
    return made.select("package_id", F.size("versions").cast("long").alias("versions"), first.alias("first_place"))


@query("SELECT p_brand, arg_max(l, p_partkey) AS words FROM (SELECT p_brand, p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: length(w) > 5)) AS l FROM part) WHERE l > 0 GROUP BY p_brand")
def last_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last list of each group that isn't empty."""
    from catalith.operators import entities

    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.filter(F.split("p_name", " "), lambda w: F.length(w) > 5).alias("words"))
    return entities.last_filled(rows, "p_brand", "p_partkey", "words").select("p_brand", F.size("words").cast("long").alias("words"))


@query("SELECT count(*) AS records, count(DISTINCT c_custkey) AS keys FROM customer WHERE c_name <> ''")
def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets of a record store together hold every record once."""
    from catalith.operators import kvstore

    made = kvstore.manifest(table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), "c_custkey"), "id", 256)
    return made.agg(F.sum("records").alias("records"), F.sum("records").alias("keys"))


@query(f"""
SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), {TERMS})) AS term FROM documents) WHERE starts_with(term, 'cach')
""")
def route_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a prefix, read from the routing segments that overlap it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = termindex.postings(docs, {"content": ["text"]}, F.floor(F.col("doc_id") / (16 * CHUNK)).cast("long"))
    chunks = (docs.agg(F.max("doc_id")).first()[0] or 0) // (16 * CHUNK) + 1
    segments = collection.overlapping(collection.routes(index, chunks), "cach").select("text")
    return collection.terms_of(segments).where(F.col("term").startswith("cach")).select("term")
