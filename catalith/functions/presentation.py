"""What a page shows of packages and cards: registry pages, consumer snippets, licence expressions, search texts, joins with metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.util import broadcast_if_small

# A registry's page of a package; {} is its name.
SITES = {
    "conan": "https://conan.io/center/recipes/{}", "vcpkg": "https://vcpkg.io/en/package/{}", "spack": "https://packages.spack.io/package.html?name={}",
    "meson": "https://mesonbuild.com/Wrapdb-projects.html", "cppget": "https://cppget.org/{}", "hunter": "https://hunter.readthedocs.io/en/latest/packages/pkg/{}.html",
    "bazel": "https://registry.bazel.build/modules/{}", "xmake": "https://packages.xmake.io/packages/{}",
}
# How a consumer names a package, and what a version adds in the place of @; {} is name or version.
SNIPPETS = {
    "conan": ("[requires]\n{}@", "/{}"), "vcpkg": ('"{}"', ""), "spack": ("spack:\n  specs:\n  - {}@", "@{}"), "meson": ("subproject('{}')", ""),
    "bazel": ('bazel_dep(name = "{}"@)', ', version = "{}"'), "cppget": ("depends: {}@", " ^{}"), "hunter": ("hunter_add_package({})", ""), "xmake": ('add_requires("{}@")', " {}"),
}
# Words that join licences, and the page of one.
OPERATORS, LICENCE_PAGE = ("AND", "OR", "WITH"), "https://spdx.org/licenses/{}.html"
_TOKEN = r"^[A-Za-z0-9][A-Za-z0-9.+-]*$"


def _by_registry(registry: Column, made: dict[str, Column]) -> Column:
    out = F.lit("")
    for key, value in made.items():
        out = F.when(registry == key, value).otherwise(out)
    return out


def _around(pattern: str, value: Column) -> Column:
    left, mark, right = pattern.partition("{}")
    return F.concat(F.lit(left), value, F.lit(right)) if mark else F.lit(left)


def site_url(registry: Column, name: Column) -> Column:
    """A registry's page of a package; '' for another registry."""
    safe = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    return _by_registry(registry, {r: _around(p, safe) for r, p in SITES.items()})


def consumer_snippet(registry: Column, name: Column, version: Column) -> Column:
    """How a consumer declares a package, with the version where the registry states one; '' for another registry."""

    def one(shape: str, part: str) -> Column:
        left, _, right = shape.partition("@")
        stated = F.when(F.coalesce(version, F.lit("")) != "", _around(part, version)).otherwise("") if part else F.lit("")
        return F.concat(_around(left, name), stated, F.lit(right))

    return _by_registry(registry, {r: one(*s) for r, s in SNIPPETS.items()})


def licence_url(identifier: Column) -> Column:
    """The page of a single licence identifier; '' for an expression or anything else."""
    return F.when(identifier.rlike(_TOKEN), _around(LICENCE_PAGE, identifier)).otherwise("")


def licence_tokens(expression: Column) -> Column:
    """A licence as tokens (text, url): identifiers have a page; operators, brackets, blanks and plain names have none."""
    is_expression = expression.rlike(_TOKEN) | expression.rlike(r"\s(?:AND|OR|WITH)\s|[()]")
    cut = F.when(is_expression, F.regexp_extract_all(expression, F.lit(r"\s+|[()]|[^\s()]+"), F.lit(0))).otherwise(F.array(expression))
    plain = lambda t: t.rlike(r"^(?:\s+|[()])$") | t.isin(*OPERATORS) | ~is_expression
    return F.transform(cut, lambda t: F.struct(t.alias("text"), F.when(plain(t), "").otherwise(_around(LICENCE_PAGE, F.url_encode(t))).alias("url")))


def card_text(title: Column, description: Column, tags: Column, metadata: Column, items: Column, *extra: Column) -> Column:
    """The text that a page is searched by: all of a card's values, lower case."""
    return F.lower(F.concat_ws(" ", title, description, tags, F.map_keys(metadata), F.map_values(metadata), items, *extra))


def semver_key(version: Column) -> Column:
    """Sort key of a semantic version, null for any other: numbers, then release after its previews, then their parts (numbers before words)."""
    numbers, preview = r"^(\d+)\.(\d+)\.(\d+)", r"^\d+\.\d+\.\d+-([0-9A-Za-z.-]+)"
    valid = version.rlike(r"^\d+\.\d+\.\d+(?:-[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?(?:\+[0-9A-Za-z.-]+)?$")
    part = lambda i: F.regexp_extract(version, numbers, i).try_cast("decimal(38,0)")
    pre = F.regexp_extract(version, preview, 1)
    steps = F.transform(F.split(pre, r"\."), lambda p: F.struct((~p.rlike(r"^\d+$")).alias("word"), p.try_cast("decimal(38,0)").alias("number"), F.when(~p.rlike(r"^\d+$"), p).alias("text")))
    return F.when(valid, F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (pre == "").alias("release"), F.when(pre != "", steps).alias("preview")))


def version_less(a: Column, b: Column) -> Column:
    """Whether a version comes before another: semantically if both are semantic versions, else as text."""
    x, y = semver_key(a), semver_key(b)
    return F.when(x.isNotNull() & y.isNotNull(), x < y).otherwise(a < b)


def cards(rows: DataFrame, metadata: DataFrame, key: str, required: bool = False, fallback: dict[str, str] | None = None) -> DataFrame:
    """Cards with their metadata (all its other columns); without ``required`` a card may have none.

    ``fallback`` maps a card's column to the metadata column that stands in if it is empty.
    """
    taken = [c for c in metadata.columns if c != key]
    side = metadata.select(F.col(key).alias("__key"), *[F.col(c).alias(f"meta_{c}") for c in taken])
    out = rows.join(broadcast_if_small(side), F.col(key) == F.col("__key"), "inner" if required else "left").drop("__key")
    return out.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), F.col(f"meta_{m}")) for c, m in (fallback or {}).items()}) if fallback else out


def latest_of(rows: DataFrame, items: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """Cards with their newest items as a list, newest first; cards without items have an empty list.

    Only ``n`` structs a key survive each partial aggregation.
    """
    from catalith.operators import merge

    columns = [c for c in items.columns if c != key]
    top = merge.top_n(items.where(F.col(key).isNotNull()), key, [F.desc(time), *[F.asc(c) for c in columns if c != time]], n)
    lists = top.groupBy(F.col(key).alias("__key")).agg(F.reverse(F.array_sort(F.collect_list(F.struct(time, *[c for c in columns if c != time])))).alias("latest"))
    out = rows.join(lists, F.col(key) == F.col("__key"), "left").drop("__key")
    return out.withColumn("latest", F.coalesce("latest", F.array().cast(lists.schema["latest"].dataType)))


def details_of(found: DataFrame, details: DataFrame) -> DataFrame:
    """(id, package_id, detail): the details of all packages of the entities found (id, packages); a missing one is null and fails nothing."""
    wanted = found.select("id", F.explode("packages").alias("package_id"))
    held = details.select(F.col("package_id").alias("__p"), F.struct(*[c for c in details.columns if c != "package_id"]).alias("detail"))
    return wanted.join(held, F.col("package_id") == F.col("__p"), "left").drop("__p")


def page_of(rows: DataFrame, order: list[Column], columns: int, lines: int, page: int = 0) -> DataFrame:
    """One page of cards, ``lines`` rows of ``columns`` cards, in a total order."""
    size = columns * lines
    return rows.orderBy(*order).offset(page * size).limit(size)


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """Rows in an order that depends on the seed only."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def month_of(url: Column, today: Column) -> Column:
    """First day of the month that an address asks for (``month=YYYY-MM``), else of today's month."""
    asked = F.regexp_extract(url, r"[?&#]month=(\d{4}-(?:0[1-9]|1[0-2]))(?:&|#|$)", 1)
    return F.coalesce(F.try_to_timestamp(F.concat(asked, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date"), F.trunc(today, "month"))
