"""Registered queries of the core library with their oracle SQL.

Every query runs over its whole tables.  Queries without SQL are tested against
brute force or an exact round trip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import ids, names
from catalith.functions import text as tx
from catalith.operators import calendar, changefeed, changelog, entities, kvstore, merge, resolve, termindex, timestamps
from catalith.plans.search import RESULTS, SearchRequest, search, search_indexed, substring_match
from catalith.util import Scratch, clean_id, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CHUNK = 64
BUCKETS = 256
TERMS = r"'[\p{L}\p{N}_+#.\-]+'"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its oracle if SQL can express it."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


query(name="p4_found")(timestamps.p4_found)
query(changefeed.P6_FOUND_SQL, "p6_found")(changefeed.p6_found)
query(changefeed.P6_STATE_SQL, "p6_current_records")(changefeed.current_records)

# search and index

_DOC_FIELDS = {"content": ["text"]}
_POST_FIELDS = {"title": ["title"], "content": ["description"], "source": ["source_title"], "tags": ["tag_text"]}


def _doc_chunk():
    return F.floor(F.col("doc_id") / CHUNK).cast("long")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blog_posts").withColumn("tag_text", F.array_join("tags", " "))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termindex.postings(table(spark, sf_dir, "documents").select("doc_id", "text"), _DOC_FIELDS, _doc_chunk())


_SEARCH_SQL = f"""
WITH terms AS (SELECT doc_id, fetched_at, source, regexp_extract_all(lower(text), {TERMS}) AS t FROM documents)
SELECT doc_id, source FROM (
  SELECT * FROM terms WHERE len(list_filter(t, lambda x: starts_with(x, 'cach'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'templ'))) > 0
  ORDER BY fetched_at DESC NULLS LAST, doc_id LIMIT {RESULTS})
"""


@query(_SEARCH_SQL)
def search_prefix_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "fetched_at")
    return search(docs, _DOC_FIELDS, SearchRequest("cach templ"), "doc_id", "fetched_at").select("doc_id", "source")


@query(_SEARCH_SQL)
def search_through_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "fetched_at")
    return search_indexed(docs, _postings(spark, sf_dir), _DOC_FIELDS, SearchRequest("cach templ"), "doc_id", "fetched_at", _doc_chunk()).select("doc_id", "source")


@query(f"""
WITH posts AS (
  SELECT fetch_id, regexp_extract_all(lower(concat_ws(' ', title, array_to_string(tags, ' '))), {TERMS}) AS t
  FROM blog_posts WHERE fetched_at >= TIMESTAMP '2021-01-01' AND fetched_at < TIMESTAMP '2025-07-01' AND (cpp_relevance IS NULL OR cpp_relevance >= 0.5))
SELECT fetch_id FROM posts WHERE len(list_filter(t, lambda x: starts_with(x, 're'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'c'))) > 0
""")
def search_fields_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = SearchRequest("re", ["title", "tags"], "2021-01-01", "2025-06-30", relevance=0.5, limit=None)
    found = search(_posts(spark, sf_dir), _POST_FIELDS, request, "fetch_id", "fetched_at", "cpp_relevance")
    one = F.exists(tx.terms(F.col("title"), F.col("tag_text")), lambda t: t.startswith("c"))
    return found.where(one).select("fetch_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'cache') AND contains(lower(text), 'ring buf')")
def search_substring_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.where(substring_match(["text"], "cache") & tx.squeeze(F.col("text")).contains("ring buf")).select("doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY fetched_at DESC NULLS LAST, doc_id LIMIT 30")
def browse_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), _DOC_FIELDS, SearchRequest(limit=30), "doc_id", "fetched_at").select("doc_id", "source")


_POSTINGS_SQL = f"SELECT DISTINCT term, doc_id // {CHUNK} AS chunk FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {TERMS})) AS term FROM documents) WHERE length(term) >= 2"


@query(f"SELECT term, count(*) AS chunks, min(chunk) AS first_chunk, max(chunk) AS last_chunk, 1 AS fields FROM ({_POSTINGS_SQL}) GROUP BY term")
def index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termindex.term_ranges(_postings(spark, sf_dir))


@query(f"SELECT chunk FROM ({_POSTINGS_SQL}) GROUP BY chunk HAVING bool_or(starts_with(term, 'cach')) AND bool_or(starts_with(term, 'templ'))")
def index_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termindex.candidates(_postings(spark, sf_dir), ["cach", "templ"])


@query(f"SELECT term[1:2] AS zone, count(DISTINCT term) AS terms, min(term) AS first_term, max(term) AS last_term FROM ({_POSTINGS_SQL}) GROUP BY zone")
def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termindex.segments(_postings(spark, sf_dir))


@query(f"""
WITH t AS (SELECT DISTINCT term FROM ({_POSTINGS_SQL})), b AS (SELECT term, lag(term) OVER (PARTITION BY term[1:2] ORDER BY term) AS before FROM t)
SELECT term, CASE WHEN before IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(term), length(before)) + 1), lambda i: term[1:i] = before[1:i])) END AS shared FROM b
""")
def index_front_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termindex.front_coding(_postings(spark, sf_dir))


@query(f"SELECT term, chunk, chunk - coalesce(lag(chunk) OVER (PARTITION BY term ORDER BY chunk), 0) AS delta FROM ({_POSTINGS_SQL})")
def index_chunk_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termindex.chunk_deltas(_postings(spark, sf_dir))


@query(f"""
WITH t AS (SELECT fetch_id // {CHUNK} AS chunk, 0 AS field, title AS x FROM blog_posts UNION ALL SELECT fetch_id // {CHUNK}, 1, description FROM blog_posts
  UNION ALL SELECT fetch_id // {CHUNK}, 2, source_title FROM blog_posts UNION ALL SELECT fetch_id // {CHUNK}, 3, array_to_string(tags, ' ') FROM blog_posts)
SELECT term, count(*) AS postings, min(chunk) AS first_chunk FROM (SELECT DISTINCT chunk, field, unnest(regexp_extract_all(lower(x), {TERMS})) AS term FROM t) WHERE length(term) >= 2 GROUP BY term
""")
def index_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon of all posts written as encoded segments and read back."""
    index = termindex.postings(_posts(spark, sf_dir), _POST_FIELDS, F.floor(F.col("fetch_id") / CHUNK).cast("long"))
    chunks = (table(spark, sf_dir, "blog_posts").agg(F.max("fetch_id")).first()[0] or 0) // CHUNK + 1
    return termindex.decoded_postings(termindex.encoded_segments(index, chunks), chunks).groupBy("term").agg(F.count("*").alias("postings"), F.min("chunk").alias("first_chunk"))


@query(f"""
SELECT field, count(*) AS postings, count(DISTINCT term) AS terms FROM (
  SELECT DISTINCT 0 AS field, p_partkey AS id, unnest(regexp_extract_all(lower(p_name), {TERMS})) AS term FROM part
  UNION SELECT DISTINCT 1, p_partkey, unnest(regexp_extract_all(lower(concat_ws(' ', p_brand, p_type)), {TERMS})) FROM part) WHERE length(term) >= 2 GROUP BY field
""")
def term_field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    index = termindex.postings(parts, {"title": ["p_name"], "kind": ["p_brand", "p_type"]}, F.col("id"))
    return index.groupBy("field").agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))


# merge and maintenance


@query("""
SELECT post_id, arg_max(fetch_id, (fetched_at, fetch_id)) AS fetch_id, arg_max(title, (fetched_at, fetch_id)) AS title,
  arg_max(cpp_relevance, (fetched_at, fetch_id)) FILTER (cpp_relevance IS NOT NULL) AS cpp_relevance, min(fetch_id) AS place
FROM (SELECT * REPLACE (coalesce(title, '') AS title) FROM blog_posts) GROUP BY post_id
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "blog_posts").select("post_id", F.coalesce("title", F.lit("")).alias("title"), "cpp_relevance", "fetched_at", "fetch_id")
    return merge.upsert(rows, "post_id", ["fetched_at", "fetch_id"], ["cpp_relevance"], "place").select("post_id", "fetch_id", "title", "cpp_relevance", "place")


@query("SELECT fetch_id, last_value(cpp_relevance IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY fetched_at, fetch_id ROWS UNBOUNDED PRECEDING) AS relevance FROM blog_posts")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.carry_forward(table(spark, sf_dir, "blog_posts"), "post_id", ["fetched_at", "fetch_id"], "cpp_relevance", "relevance").select("fetch_id", "relevance")


@query("SELECT source_id, fetch_id FROM blog_posts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, fetch_id) <= 8")
def topn_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "blog_posts").select("source_id", "fetch_id", "fetched_at")
    return merge.top_n(rows, "source_id", [F.desc("fetched_at"), F.asc("fetch_id")], 8).select("source_id", "fetch_id")


@query("SELECT fetch_id, source_id FROM blog_posts WHERE fetched_at >= TIMESTAMP '2024-01-01' ORDER BY fetched_at DESC, fetch_id LIMIT 500")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "blog_posts").select("fetch_id", "source_id", "fetched_at")
    return merge.retain(rows, "fetched_at", "2024-01-01", 500, [F.desc("fetched_at"), F.asc("fetch_id")]).select("fetch_id", "source_id")


@query("""
WITH labels AS (SELECT l_partkey AS p_partkey, round(avg(l_discount), 6) AS label FROM lineitem GROUP BY 1)
SELECT p_partkey, coalesce(label, round(p_retailprice / 10000, 6)) AS relevance FROM part LEFT JOIN labels USING (p_partkey)
""")
def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.round(F.avg("l_discount"), 6).alias("label"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") / 10000, 6).alias("relevance"))
    return merge.label(rows, labels, "p_partkey", "relevance")


@query("SELECT fetch_id FROM blog_posts WHERE cpp_relevance IS NULL OR cpp_relevance >= 0.5")
def relevance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.relevant(table(spark, sf_dir, "blog_posts"), "cpp_relevance").select("fetch_id")


_OVERRIDES = [(1, {"s_name": "First supplier"}, None), (3, {"s_name": ""}, True), (5, {}, True), (999_999_999, {"s_name": "Nobody"}, False)]


def _overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_OVERRIDES, "s_suppkey long, values map<string,string>, hidden boolean")


@query("SELECT s_suppkey, CASE s_suppkey WHEN 1 THEN 'First supplier' WHEN 3 THEN '' ELSE s_name END AS s_name, s_suppkey IN (3, 5) AS hidden FROM supplier")
def override_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.override(table(spark, sf_dir, "supplier"), _overrides(spark), "s_suppkey", ["s_name"]).select("s_suppkey", "s_name", "hidden")


@query("SELECT o.s_suppkey FROM (VALUES (1::BIGINT), (3), (5), (999999999)) o(s_suppkey) ANTI JOIN supplier USING (s_suppkey)")
def override_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.unknown_overrides(table(spark, sf_dir, "supplier"), _overrides(spark), "s_suppkey").select("s_suppkey")


@query("""
WITH ex AS (SELECT source_id, unnest(['Release ', 'c++20', 'NEWS', 'job']) AS tag FROM blog_sources WHERE discoverable)
SELECT fetch_id, EXISTS (SELECT 1 FROM ex WHERE ex.source_id = p.source_id AND list_contains(list_transform(p.tags, lambda t: lower(trim(t))), lower(trim(ex.tag)))) AS hidden FROM blog_posts p
""")
def exclude_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(*[F.lit(t) for t in ("Release ", "c++20", "NEWS", "job")])
    excluded = table(spark, sf_dir, "blog_sources").where("discoverable").select("source_id", F.explode(tags).alias("tag"))
    return merge.hide_by_tag(table(spark, sf_dir, "blog_posts").drop("hidden"), excluded, "source_id", "tags").select("fetch_id", "hidden")


# change log

_BEFORE_SQL = changefeed.P6_STATE_SQL.replace("FROM browser_changes", "FROM (SELECT * FROM browser_changes WHERE received_at < TIMESTAMP '2024-07-01')")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    changes = table(spark, sf_dir, "browser_changes")
    state = lambda rows: changefeed.apply_changes(rows, ["collection_name", "id"], ["title", "content", "url"]).select(F.concat_ws("/", "collection_name", "id").alias("key"), "title", "content", "url")
    return state(changes.where("received_at < TIMESTAMP '2024-07-01 00:00:00'")), state(changes)


_KEYED = "SELECT collection_name || '/' || id AS key, title, content, url FROM ({})"


@query(f"WITH b AS ({_KEYED.format(_BEFORE_SQL)}), a AS ({_KEYED.format(changefeed.P6_STATE_SQL)}) SELECT a.key, a.title FROM a LEFT JOIN b USING (key) WHERE b.key IS NULL OR (a.title, a.content, a.url) IS DISTINCT FROM (b.title, b.content, b.url)")
def diff_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return merge.changed(before, after, "key").select("key", "title")


@query(f"WITH b AS ({_KEYED.format(_BEFORE_SQL)}), a AS ({_KEYED.format(changefeed.P6_STATE_SQL)}) SELECT b.key FROM b ANTI JOIN a USING (key)")
def diff_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return merge.deleted(before, after, "key")


@query(_KEYED.format(changefeed.P6_STATE_SQL))
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that turns one snapshot into the next, appended to the first and replayed."""
    before, after = _snapshots(spark, sf_dir)
    first = changelog.positions(before.withColumn("_deleted", F.lit(False)), ["key"]).drop("offset")
    ops = changelog.operations(before, after, "key", ["title"]).drop("offset")
    log = first.withColumn("batch", F.lit(0)).unionByName(ops.withColumn("batch", F.lit(1)))
    ordered = log.withColumn("position", F.struct("batch", "position")).drop("batch")
    return changelog.replay(ordered, "key")


_LOG_SQL = """
SELECT *, sum(bytes) OVER (ORDER BY op_id ROWS UNBOUNDED PRECEDING) - bytes AS start_byte, row_number() OVER (ORDER BY op_id) - 1 AS position
FROM (SELECT op_id, received_at, coalesce(_deleted, false) AS gone, octet_length(encode(concat_ws('|', collection_name, id, title, content, url))) AS bytes FROM browser_changes)
"""


@query(f"""
WITH log AS ({_LOG_SQL}), c AS (
  SELECT (start_byte // 131072)::INT AS chunk, count(*) AS operations, min(position) AS start, sum(bytes)::BIGINT AS bytes,
    min(received_at) FILTER (NOT gone) AS first_time, max(received_at) FILTER (NOT gone) AS last_time FROM log GROUP BY 1)
SELECT *, chunk < (SELECT max(chunk) FROM c) AS sealed FROM c
""")
def chunk_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "browser_changes")
    size = F.octet_length(F.concat_ws("|", "collection_name", "id", "title", "content", "url")).cast("long")
    rows = ops.select("op_id", "received_at", F.coalesce("_deleted", F.lit(False)).alias("gone"), size.alias("bytes"))
    placed = changelog.chunked(rows, ["op_id"], F.col("bytes"), 131_072)
    return changelog.descriptors(placed, "received_at", F.col("bytes"), ~F.col("gone"))


_FNV_SQL = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"SELECT c_custkey, (({_FNV_SQL.format('c_name')}) & {BUCKETS - 1})::INT AS bucket FROM customer")
def kv_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kvstore.with_bucket(table(spark, sf_dir, "customer"), "c_name", BUCKETS).select("c_custkey", "bucket")


@query("SELECT p_partkey, p_brand FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of one name, from a store written in buckets; only its bucket is read."""
    parts = table(spark, sf_dir, "part")
    wanted = parts.agg(F.min("p_name")).first()[0] or ""
    path = f"{Scratch(spark, 'store').root}/part"
    one = parts.where("p_name <> ''").groupBy("p_name").agg(F.collect_list(F.struct("p_partkey", "p_brand")).alias("rows"))
    kvstore.write(one, "p_name", BUCKETS, path)
    return kvstore.lookup(spark, path, "p_name", wanted, BUCKETS, one.schema).select(F.explode("rows").alias("r")).select("r.p_partkey", "r.p_brand")


# entity resolution


def _packages(spark: SparkSession, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One row per package with what comparison needs, from all of its releases; kept in ``scratch``, if given.

    The table has no authors, maintainers and package types.  These aren't kept, so
    that no shuffle carries them.
    """
    rows = table(spark, sf_dir, "package_versions")
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    repo = names.host_path(F.col("repository_url"))
    none = F.array().cast("array<string>")
    upstream = F.filter(F.coalesce("artifacts", F.array()), lambda a: F.lower(F.trim(a["kind"])) == "upstream_source")
    urls = F.array_compact(F.transform(upstream, lambda a: said(a["url"])))
    sums = F.array_compact(F.flatten(F.transform(upstream, lambda a: F.transform(F.coalesce(a["checksums"], none), names.plain_checksum))))
    rows = rows.select(
        clean_id("package_id").alias("id"), said(F.lower("package_name")).alias("name"), F.col("release_version"), "licenses",
        F.when(repo.rlike(r"^[^/]+\.example/[^/]+/[^/]+$"), repo).alias("repo"), F.nullif(names.host_path(F.col("homepage")), F.lit("")).alias("page"), F.col("summary"), urls.alias("urls"), sums.alias("sums"))
    # the repositories that a package, and the addresses of its upstream sources, name
    kept = lambda u: F.regexp_extract(names.host_path(u), r"^([^/]+\.example/[^/]+/[^/]+)/", 1)
    rows = rows.withColumn("repos", F.array_distinct(F.concat(F.array_compact(F.array("repo")), F.filter(F.transform("urls", kept), lambda r: r != ""))))
    grouped = rows.groupBy("id").agg(
        F.min("name").alias("name"), F.min("repo").alias("repository"), F.min("page").alias("homepage"), F.array_distinct(F.flatten(F.collect_set("repos"))).alias("repositories"),
        F.array_distinct(F.flatten(F.collect_set(F.transform(F.coalesce("licenses", F.array().cast("array<string>")), lambda v: F.lower(F.trim(F.coalesce(v, F.lit(""))))))) ).alias("licenses"),
        F.collect_set(F.lower(F.trim("release_version"))).alias("versions"), F.max("summary").alias("description"),
        F.array_distinct(F.flatten(F.collect_set("urls"))).alias("source_urls"), F.array_distinct(F.flatten(F.collect_set("sums"))).alias("checksums"))
    drop = F.filter("licenses", lambda v: (v != "") & ~v.isin(names.LICENCE_MISSING))
    grouped = grouped.withColumns({"registry": F.substring_index("id", ":", 1), "licenses": drop})
    if scratch:
        grouped = scratch.keep(grouped, "packages", free=True)
    return grouped.withColumns({"authors": none, "maintainers": none, "package_type": F.lit(None).cast("string")})


_PACKAGES_SQL = r"""
WITH rows AS (
  SELECT lower(trim(package_id)) AS id, nullif(trim(lower(package_name)), '') AS name, lower(trim(release_version)) AS ver,
    list_filter(list_transform(coalesce(licenses, []), lambda v: lower(trim(coalesce(v, '')))), lambda v: v <> '' AND v NOT IN ('noassertion', 'unknown', 'unspecified')) AS lic,
    regexp_replace(regexp_replace(lower(regexp_extract(trim(coalesce(repository_url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1)), '^www\.', ''), '/+$', '') AS repo0,
    nullif(regexp_replace(regexp_replace(lower(regexp_extract(trim(coalesce(homepage, '')), '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1)), '^www\.', ''), '/+$', ''), '') AS page
    , list_filter(list_transform(list_filter(coalesce(artifacts, []), lambda a: lower(trim(a.kind, ' ')) = 'upstream_source'), lambda a: trim(a.url, ' ')), lambda u: u IS NOT NULL AND u <> '') AS urls,
    list_filter(list_transform(list_transform(flatten(list_transform(list_filter(coalesce(artifacts, []), lambda a: lower(trim(a.kind, ' ')) = 'upstream_source'), lambda a: coalesce(a.checksums, []))),
      lambda c: regexp_extract(lower(trim(c, ' ')), '([0-9a-f]{32,128})\s*$', 1)), lambda d: CASE length(d) WHEN 32 THEN 'md5:' || d WHEN 40 THEN 'sha1:' || d WHEN 64 THEN 'sha256:' || d WHEN 128 THEN 'sha512:' || d END), lambda c: c IS NOT NULL) AS sums
  FROM package_versions
), packages AS (
  SELECT id, split_part(id, ':', 1) AS registry, min(name) AS name, min(page) AS homepage,
    list_distinct(flatten(list(list_filter([CASE WHEN regexp_matches(repo0, '^[^/]+\.example/[^/]+/[^/]+$') THEN repo0 END] || list_transform(urls, lambda u: nullif(regexp_extract(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1)), '^www\.', ''), '^([^/]+\.example/[^/]+/[^/]+)/', 1), '')), lambda r: r IS NOT NULL)))) AS repos, min(repo0) FILTER (regexp_matches(repo0, '^[^/]+\.example/[^/]+/[^/]+$')) AS repo,
    list(DISTINCT ver) AS versions, list_distinct(flatten(list(lic))) AS licenses, list_distinct(flatten(list(urls))) AS urls, list_distinct(flatten(list(sums))) AS sums
  FROM rows GROUP BY id
), keyed AS (
  SELECT id, registry, unnest(list_distinct(list_filter(['s:' || regexp_replace(name, '[-_.+]', '', 'g'), 'a:' || regexp_replace(regexp_replace(name, '[-_.+]', '', 'g'), '^lib', ''), 'r:' || repo, 'h:' || homepage] || list_transform(urls, lambda u: 'u:' || lower(u)) || list_transform(sums, lambda c: 'c:' || c), lambda k: k IS NOT NULL))) AS k FROM packages
), pairs AS (
  SELECT DISTINCT a.id AS "left", b.id AS "right" FROM keyed a JOIN keyed b USING (k) WHERE a.id < b.id AND a.registry <> b.registry
), repeated AS (
  SELECT homepage, max(n) > 1 AS repeated FROM (SELECT homepage, registry, count(*) AS n FROM packages WHERE homepage IS NOT NULL GROUP BY ALL) GROUP BY 1
), scored AS (
  SELECT p."left", p."right", x.name = y.name AS exact, regexp_replace(x.name, '[-_.+]', '', 'g') = regexp_replace(y.name, '[-_.+]', '', 'g') AS spelled,
    regexp_replace(regexp_replace(x.name, '[-_.+]', '', 'g'), '^lib', '') = regexp_replace(regexp_replace(y.name, '[-_.+]', '', 'g'), '^lib', '') AS aliased,
    coalesce(list_has_any(x.repos, y.repos), false) AS same_repo, list_has_any(x.urls, y.urls) AS url, list_has_any(x.sums, y.sums) AS summed, same_repo OR url OR summed AS repo, x.homepage = y.homepage AND NOT coalesce(r.repeated, false) AS page,
    list_has_any(x.licenses, y.licenses) AS lic, len(x.licenses) > 0 AND len(y.licenses) > 0 AS lics, list_has_any(x.versions, y.versions) AS ver
  FROM pairs p JOIN packages x ON x.id = p."left" JOIN packages y ON y.id = p."right" LEFT JOIN repeated r ON r.homepage = x.homepage
), weighed AS (
  SELECT *, (CASE WHEN repo THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN exact THEN 1.0::DOUBLE - 0.95::DOUBLE WHEN spelled THEN 1.0::DOUBLE - 0.75::DOUBLE WHEN aliased THEN 1.0::DOUBLE - 0.6::DOUBLE ELSE 1.0::DOUBLE END)
    * (CASE WHEN page THEN 1.0::DOUBLE - 0.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN lic THEN 1.0::DOUBLE - 0.05::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN ver THEN 1.0::DOUBLE - 0.12::DOUBLE ELSE 1.0::DOUBLE END) AS miss,
    (CASE WHEN exact OR spelled OR aliased THEN 0.0::DOUBLE ELSE -0.3::DOUBLE END) + (CASE WHEN NOT lic AND lics THEN -0.12::DOUBLE ELSE 0.0::DOUBLE END) AS penalty
  FROM scored
)
"""


@query(_PACKAGES_SQL + 'SELECT "left", "right" FROM pairs')
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.block_pairs(_packages(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(packages, scored pairs); the pairs are kept, so that the files of their shuffles are gone before theirs with the packages are written."""
    scratch = Scratch(spark, "scored")
    packages = _packages(spark, sf_dir, scratch)
    pairs = scratch.keep(resolve.candidate_pairs(packages), "pairs", free=True)
    return packages, resolve.score_pairs(pairs, packages, texts)


@query(_PACKAGES_SQL + 'SELECT "left", "right", confidence FROM (SELECT *, round(CASE WHEN repo THEN 1 - miss ELSE (1 - miss) * greatest(0.0::DOUBLE, 1.0::DOUBLE + penalty) END, 4) AS confidence FROM weighed) WHERE confidence >= 0.45')
def pair_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1].select("left", "right", "confidence")


@query(_PACKAGES_SQL + """SELECT "left", "right", CASE WHEN exact THEN 7 WHEN spelled THEN 6 WHEN summed THEN 5 WHEN url THEN 4 WHEN aliased THEN 3 WHEN same_repo THEN 1 ELSE 0 END AS priority
FROM (SELECT *, round(CASE WHEN repo THEN 1 - miss ELSE (1 - miss) * greatest(0.0::DOUBLE, 1.0::DOUBLE + penalty) END, 4) AS confidence FROM weighed) WHERE confidence >= 0.45""")
def merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1].select("left", "right", "priority")


@query()
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages, scored = _scored(spark, sf_dir, True)
    similar = F.filter("evidence", lambda e: e["signal"].isin("similar description", "conflicting descriptions"))
    return scored.select("left", "right", "confidence", F.array_join(F.transform(similar, lambda e: e["signal"]), ",").alias("texts"))


@query("""
WITH RECURSIVE e AS (SELECT lower(trim(left_id)) AS x, lower(trim(right_id)) AS y FROM package_matches WHERE lower(trim(decision)) IN ('merge', 'manual_merge') AND lower(trim(left_id)) <> lower(trim(right_id))),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x AS id, x AS c FROM b UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.id WHERE r.c < b.y)
SELECT id, min(c) AS component FROM r GROUP BY id
""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "package_matches").where(clean_id("decision").isin("merge", "manual_merge"))
    return resolve.components(rows.select(clean_id("left_id").alias("left"), clean_id("right_id").alias("right")).where("left <> right"))


def _entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "entities")
    packages = scratch.keep(_packages(spark, sf_dir), "packages")
    scored = resolve.score_pairs(resolve.candidate_pairs(packages), packages)
    scored = scratch.keep(scored.select("left", "right", "confidence", "priority"), "scored")
    roots, decisions = resolve.constrained_merge(packages, scored)
    return packages, roots, decisions


@query()
def constrained_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir)[1]


@query()
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages, roots, _ = _entities(spark, sf_dir)
    rows = packages.select("id", "name").join(roots, "id")
    groups = entities.most_common_name(rows.withColumnRenamed("entity_root", "root"), "root", "name")
    members = roots.groupBy(F.col("entity_root").alias("root")).agg(F.array_sort(F.collect_set("id")).alias("members"))
    return resolve.entity_ids(groups.join(members, "root"))


# entities; the spelling of the name stands for the entity here, so that SQL can follow

_RELEASES_SQL = "SELECT *, lower(trim(package_id)) AS pid, regexp_replace(lower(package_name), '[-_.+]', '', 'g') AS entity FROM package_versions"


def _releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "package_versions").withColumns({"pid": clean_id("package_id"), "entity": names.spelling(F.col("package_name"))})


@query(f"SELECT entity, arg_min(package_name, (-n, length(package_name), lower(package_name), package_name)) AS package_name FROM (SELECT entity, package_name, count(*) AS n FROM ({_RELEASES_SQL}) GROUP BY ALL) GROUP BY entity")
def group_name_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.most_common_name(_releases(spark, sf_dir), "entity", "package_name")


@query(f"""
WITH n AS (SELECT entity, package_name, count(*) AS n FROM ({_RELEASES_SQL}) GROUP BY ALL), c AS (SELECT entity, arg_min(package_name, (-n, length(package_name), lower(package_name), package_name)) AS chosen FROM n GROUP BY entity)
SELECT entity, string_agg(package_name, ',' ORDER BY lower(package_name), package_name) AS aliases FROM n JOIN c USING (entity) WHERE package_name <> chosen GROUP BY entity
""")
def group_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.other_names(_releases(spark, sf_dir), "entity", "package_name")


_QUALITY_SQL = "CASE registry WHEN 'cppget' THEN 40 WHEN 'vcpkg' THEN 35 WHEN 'conan' THEN 34 WHEN 'xmake' THEN 33 WHEN 'spack' THEN 25 ELSE 10 END"


@query(f"""
SELECT entity, arg_max(t, (s, t, release_id)) AS summary_text FROM (
  SELECT entity, release_id, CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE coalesce(description, '') END AS t, {_QUALITY_SQL} + CASE WHEN coalesce(summary, '') <> '' THEN 50 ELSE 0 END AS s FROM ({_RELEASES_SQL})) WHERE t <> '' GROUP BY entity
""")
def argmax_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.best_summary(_releases(spark, sf_dir), "entity", "registry", "summary", "description", "release_id")


_FIELD_SQL = "CASE registry WHEN 'vcpkg' THEN 50 WHEN 'cppget' THEN 45 WHEN 'conan' THEN 40 WHEN 'xmake' THEN 35 WHEN 'spack' THEN 30 WHEN 'bazel' THEN 25 WHEN 'meson' THEN 20 WHEN 'hunter' THEN 15 ELSE 0 END"


@query(f"SELECT entity, arg_max(homepage, k) AS homepage, arg_max(release_id, k) AS source FROM (SELECT entity, homepage, release_id, ({_FIELD_SQL}, -length(homepage), release_id) AS k FROM ({_RELEASES_SQL}) WHERE coalesce(homepage, '') <> '') GROUP BY entity")
def argmax_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.best_field(_releases(spark, sf_dir), "entity", "registry", "homepage", "release_id")


@query(f"SELECT registry, count(DISTINCT entity) AS entities FROM ({_RELEASES_SQL}) GROUP BY registry")
def registry_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.registry_counts(_releases(spark, sf_dir), "entity", "registry")


_REGISTRIES = ["bazel", "conan", "cppget", "hunter", "meson", "spack", "vcpkg", "xmake"]
_UPSTREAM_SQL = "regexp_replace(trim(release_version), '^[vV]([0-9])', '\\1')"


@query(f"SELECT entity, upstream, {', '.join(f'count(*) FILTER (registry = {chr(39)}{r}{chr(39)}) AS {r}' for r in _REGISTRIES)} FROM (SELECT *, {_UPSTREAM_SQL} AS upstream FROM ({_RELEASES_SQL})) GROUP BY entity, upstream")
def availability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _releases(spark, sf_dir).withColumn("upstream", F.regexp_replace(F.trim("release_version"), r"^[vV](\d)", "$1"))
    return entities.availability(rows, "entity", "upstream", "registry", _REGISTRIES)


@query(f"SELECT pid, count(DISTINCT release_id) AS releases, min(release_id) AS first_release FROM ({_RELEASES_SQL}) GROUP BY pid, description, coalesce(array_to_string(licenses, '|'), ''), lifecycle")
def release_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = [F.col("description"), F.coalesce(F.array_join("licenses", "|"), F.lit("")), F.col("lifecycle")]
    return entities.release_groups(_releases(spark, sf_dir), "pid", "release_id", shown)


@query(f"""
WITH p AS (SELECT DISTINCT registry, package_name AS name, pid FROM ({_RELEASES_SQL})), own AS (SELECT registry, lower(name) AS n, min(pid) AS own FROM p GROUP BY ALL),
only_ AS (SELECT lower(name) AS n, min(pid) AS only_ FROM p GROUP BY 1 HAVING count(DISTINCT pid) = 1), wanted AS (SELECT DISTINCT 'conan' AS registry, name FROM p)
SELECT w.registry, w.name, coalesce(own.own, only_.only_) AS target FROM wanted w LEFT JOIN own ON own.registry = w.registry AND own.n = lower(w.name) LEFT JOIN only_ ON only_.n = lower(w.name)
""")
def dependency_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = _releases(spark, sf_dir).select("registry", F.col("package_name").alias("name"), "pid").distinct()
    wanted = packages.select(F.lit("conan").alias("registry"), "name").distinct()
    return entities.resolve_dependencies(wanted, packages, "pid").select("registry", "name", "target")


_HOST_SQL = r"regexp_replace(regexp_replace(lower(regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1)), '^www\.', ''), '/+$', '')"


@query(f"""
SELECT homepage, max(n) > 1 AS repeated FROM (SELECT {_HOST_SQL.format('homepage')} AS homepage, registry, count(DISTINCT pid) AS n FROM ({_RELEASES_SQL}) GROUP BY ALL) WHERE homepage <> '' GROUP BY homepage
""")
def homepage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _releases(spark, sf_dir).select(F.col("pid").alias("id"), "registry", names.host_path(F.col("homepage")).alias("homepage"))
    return resolve.homepage_counts(rows)


@query(f"""
SELECT release_id, CASE WHEN regexp_matches(h, '^(forge|codeyard|srcpool|gitbarn)\\.example/[^/]+/[^/]+') THEN 'https://' || regexp_replace(regexp_extract(h, '^([^/]+/[^/]+/[^/]+)', 1), '\\.git$', '') ELSE '' END AS identity
FROM (SELECT release_id, {_HOST_SQL.format('repository_url')} AS h FROM package_versions WHERE repository_url IS NOT NULL)
""")
def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    forges = [f"{h}.example" for h in ("forge", "codeyard", "srcpool", "gitbarn")]
    rows = table(spark, sf_dir, "package_versions").where("repository_url IS NOT NULL")
    return rows.select("release_id", names.repository_identity(F.col("repository_url"), forges).alias("identity"))


# scalar functions


@query("""
SELECT fetch_id, translate(to_base64(unhex(substr(sha256(source_id || chr(0) || url), 1, 24))), '+/', '-_') AS short_id, substr(sha256(coalesce(title, '')), 1, 16) AS digest FROM blog_posts WHERE url IS NOT NULL
""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "blog_posts").where("url IS NOT NULL")
    return rows.select("fetch_id", ids.short_id(F.col("source_id"), F.col("url")).alias("short_id"), ids.digest(F.coalesce("title", F.lit(""))).alias("digest"))


@query("""
WITH g AS (SELECT entity, min(package_name) AS name, list_sort(list(DISTINCT pid)) AS members FROM (SELECT lower(trim(package_id)) AS pid, package_name, lower(package_name) AS entity FROM package_versions) GROUP BY entity),
s AS (SELECT *, CASE WHEN b = '' THEN 'package' ELSE b END AS base FROM (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS b FROM g))
SELECT entity, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base ELSE base || '-' || substr(sha256(array_to_string(members, chr(10))), 1, 8) END AS entity_id FROM s
""")
def entity_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "package_versions").select(clean_id("package_id").alias("pid"), "package_name", F.lower("package_name").alias("root"))
    groups = rows.groupBy("root").agg(F.min("package_name").alias("name"), F.array_sort(F.collect_set("pid")).alias("members"))
    return resolve.entity_ids(groups).select(F.col("root").alias("entity"), "entity_id")


@query(r"""
WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(text[1:161], ' [^ ]*$', ''), '[ ,.;:\-]+$', '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(text) <= 160 THEN text WHEN length(w) < 80 THEN rtrim(text[1:160], ' ') || '…' ELSE w || '…' END AS summary FROM c
""")
def truncate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.truncate(F.col("text"), 160).alias("summary"))


@query(r"""
SELECT fetch_id, CASE WHEN length(p) <= 280 THEN p ELSE rtrim(p[1:279], ' ') || '…' END AS plain
FROM (SELECT fetch_id, trim(regexp_replace(regexp_replace(description, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM blog_posts WHERE description IS NOT NULL)
""")
def feed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "blog_posts").where("description IS NOT NULL").select("fetch_id", tx.feed_text(F.col("description")).alias("plain"))


@query("""
SELECT release_id, x AS licence FROM (SELECT release_id, unnest(list_distinct(list_filter(list_transform(list_filter(licenses, lambda v: v IS NOT NULL), lambda v: trim(v, ' ')),
  lambda v: v <> '' AND lower(v) NOT IN ('noassertion', 'unknown', 'unspecified')))) AS x FROM package_versions)
""")
def clean_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "package_versions").select("release_id", F.explode(names.clean_licences(F.col("licenses"))).alias("licence"))


@query(r"""
SELECT DISTINCT release_id, CASE length(d) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1' WHEN 64 THEN 'sha256' WHEN 128 THEN 'sha512' END || ':' || d AS checksum
FROM (SELECT release_id, regexp_extract(lower(trim(c)), '([0-9a-f]{32,128})\s*$', 1) AS d FROM (SELECT release_id, unnest(a.checksums) AS c FROM (SELECT release_id, unnest(artifacts) AS a FROM package_versions)))
WHERE length(d) IN (32, 40, 64, 128)
""")
def checksum_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "package_versions").select("release_id", F.explode("artifacts").alias("a")).select("release_id", F.explode("a.checksums").alias("c"))
    return rows.select("release_id", names.plain_checksum(F.col("c")).alias("checksum")).where("checksum IS NOT NULL").distinct()


@query(r"""
SELECT release_id, CASE WHEN registry = 'cppget' AND regexp_matches(v, '^.*\+\d+$') THEN regexp_extract(v, '^(.*)\+(\d+)$', 1) WHEN registry = 'hunter' AND regexp_matches(v, '(?i)^.*?[-_.]hunter(?:[-_.]?\d+)?$') THEN regexp_extract(v, '(?i)^(.*?)[-_.]hunter(?:[-_.]?(\d+))?$', 1) ELSE v END AS upstream
FROM (SELECT release_id, registry, regexp_replace(trim(release_version), '^[vV]([0-9])', '\1') AS v FROM package_versions)
""")
def version_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "package_versions").select("release_id", names.version_identity(F.col("registry"), F.col("release_version"))["upstream"].alias("upstream"))


@query(r"""
SELECT pid, arg_max(v, (list_transform(regexp_extract_all(v, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END).array_to_string(''), v)) AS latest
FROM (SELECT lower(trim(package_id)) AS pid, lower(trim(release_version)) AS v FROM package_versions) GROUP BY pid
""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "package_versions").select(clean_id("package_id").alias("pid"), F.lower(F.trim("release_version")).alias("v"))
    return rows.groupBy("pid").agg(F.max_by("v", F.struct(names.natural_key(F.col("v")), F.col("v"))).alias("latest"))


_ISBN_BASE = "'978' || lpad(((p_partkey * 104729) % 1000000000)::VARCHAR, 9, '0')"


@query(f"""
WITH b AS (SELECT p_partkey, {_ISBN_BASE} AS s FROM part), d AS (SELECT *, list_transform(range(1, 13), lambda i: s[i]::INT * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) AS w, list_transform(range(1, 10), lambda i: s[i + 3]::INT * (11 - i)) AS t FROM b),
e AS (SELECT p_partkey, s || (p_partkey % 10)::VARCHAR AS isbn, (10 - list_sum(w) % 10) % 10 = p_partkey % 10 AS valid, s, (11 - list_sum(t) % 11) % 11 AS k FROM d)
SELECT p_partkey, isbn, valid, s[4:12] || CASE WHEN k = 10 THEN 'X' ELSE k::BIGINT::VARCHAR END AS isbn10 FROM e
""")
def isbn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("978"), F.lpad(((F.col("p_partkey") * 104729) % 1000000000).cast("string"), 9, "0"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(base, (F.col("p_partkey") % 10).cast("string")).alias("isbn"))
    return rows.select("p_partkey", "isbn", names.valid_isbn(F.col("isbn")).alias("valid"), names.isbn10(F.col("isbn")).alias("isbn10"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey FROM supplier")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b)


# calendar

_EVENTS_SQL = "SELECT o_orderkey, o_orderdate::DATE AS start_date, max(l_shipdate)::DATE AS end_date FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("end_date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start_date")).join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


@query(f"""
WITH e AS ({_EVENTS_SQL}), days AS (SELECT unnest(generate_series(date_trunc('week', DATE '1996-05-01')::TIMESTAMP, date_trunc('week', DATE '1996-05-01')::TIMESTAMP + INTERVAL 41 DAY, INTERVAL 1 DAY))::DATE AS day)
SELECT day, count(*) AS events, count(*) FILTER (day = start_date) AS starts, count(*) FILTER (day = coalesce(end_date, start_date)) AS ends FROM days JOIN e ON start_date <= day AND coalesce(end_date, start_date) >= day GROUP BY day
""")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.by_day(_events(spark, sf_dir), "start_date", "end_date", "1996-05")
    return days.groupBy("day").agg(F.count("*").alias("events"), F.count(F.when(F.col("starts"), 1)).alias("starts"), F.count(F.when(F.col("ends"), 1)).alias("ends"))


@query(f"SELECT o_orderkey, start_date FROM ({_EVENTS_SQL}) WHERE start_date <= DATE '1996-05-31' AND coalesce(end_date, start_date) >= DATE '1996-05-01'")
def month_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.in_month(_events(spark, sf_dir), "start_date", "end_date", "1996-05").select("o_orderkey", "start_date")


@query("SELECT o_orderkey, o_orderdate::DATE AS start_date FROM orders WHERE o_orderdate::DATE > DATE '1996-05-31' AND o_orderstatus <> 'F' ORDER BY 2, 1 LIMIT 1")
def next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("start_date"), "o_orderstatus")
    return calendar.next_after(rows, "start_date", F.lit("1996-05-31").cast("date"), F.col("o_orderstatus") == "F", ["o_orderkey"]).select("o_orderkey", "start_date")


@query("SELECT day::DATE AS day, ((row_number() OVER (ORDER BY day) - 1) // 7)::INT AS week FROM (SELECT unnest(generate_series(TIMESTAMP '2024-12-30', TIMESTAMP '2025-02-09', INTERVAL 1 DAY)) AS day)")
def month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.grid(spark, "2025-01")


FLAGSHIP: Query = search_prefix_and
