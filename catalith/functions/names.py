"""Comparison keys of names, addresses, licences, versions, checksums and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions.text import entities_decoded


def spelling(name: Column) -> Column:
    """A name without case and separators."""
    return F.regexp_replace(F.lower(name), r"[-_.+]", "")


def alias(name: Column) -> Column:
    """A spelling without a leading ``lib``."""
    return F.regexp_replace(spelling(name), r"^lib", "")


def host_path(url: Column) -> Column:
    """Host without ``www.`` (with port) and path without trailing slash, lower case; '' if there is no host."""
    rest = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(rest), r"^www\.", ""), r"/+$", "")


# Hosts whose first two path parts name a repository.
FORGES = ["github.com", "gitlab.com", "bitbucket.org", "codeberg.org"]


def repository_identity(url: Column, forges: list[str] | None = None) -> Column:
    """``https://host/owner/name`` of a repository on a known forge, else ''."""
    hp = host_path(url)
    parts = F.filter(F.split(hp, "/"), lambda p: p != "")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    known = part(1).isin(forges or FORGES) & (F.size(parts) >= 3)
    return F.coalesce(F.when(known, F.concat(F.lit("https://"), part(1), F.lit("/"), part(2), F.lit("/"), F.regexp_replace(part(3), r"\.git$", ""))), F.lit(""))


def blob_url(repository: Column, revision: Column, path: Column) -> Column:
    """Address of a file in a repository at a revision, HEAD by default."""
    return F.concat(repository, F.lit("/blob/"), F.coalesce(F.nullif(revision, F.lit("")), F.lit("HEAD")), F.lit("/"), path)


def expand_scheme(url: Column) -> Column:
    """``github:owner/name`` as an address; a ``git+`` prefix is dropped."""
    return F.regexp_replace(F.regexp_replace(url, r"^github:", "https://github.com/"), r"^git\+", "")


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(p == ".", a).otherwise(F.concat(a, F.array(p))))
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise(""))


def resolved_url(base: Column, value: Column) -> Column:
    """An address resolved against the page that holds it; without a base it stays as it is."""
    v, b = F.trim(value), F.coalesce(base, F.lit(""))
    scheme, origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(b, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    path, tail = F.regexp_extract(v, r"^([^?#]*)", 1), F.regexp_extract(v, r"^[^?#]*(.*)$", 1)
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    return F.when(v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), v).when(v.startswith("//"), F.concat(scheme, F.lit(":"), v)).otherwise(F.concat(origin, _without_dots(whole), tail))


def image_url(base: Column | str, value: Column | str) -> Column:
    """An image address resolved against its page; '' for none and for a bare root."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    v = F.trim(F.coalesce(column(value), F.lit("")))
    full = resolved_url(column(base), v)
    path = F.regexp_extract(full, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when((v == "") | path.isin("", "/"), "").otherwise(full)


def clean_list(values: Column) -> Column:
    """Trimmed, without empties, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.trim(v)), lambda v: v != ""))


# Licence spellings and what they stand for; entries that name none.
LICENCE_ALIASES = {
    "apache 2.0": "Apache-2.0", "apache-2": "Apache-2.0", "boost": "BSL-1.0", "boost software license": "BSL-1.0", "bsd-2": "BSD-2-Clause",
    "bsd-3": "BSD-3-Clause", "gplv2": "GPL-2.0-only", "gplv3": "GPL-3.0-only", "lgplv2.1": "LGPL-2.1-only", "mit license": "MIT", "zlib license": "Zlib",
}
LICENCE_MISSING = ["noassertion", "unknown", "unspecified"]


def clean_licences(values: Column) -> Column:
    """A cleaned list with known spellings replaced and stand-ins dropped."""
    table = F.create_map(*[F.lit(x) for pair in LICENCE_ALIASES.items() for x in pair])
    said = F.filter(clean_list(values), lambda v: ~F.lower(v).isin(LICENCE_MISSING))
    return F.array_distinct(F.transform(said, lambda v: F.coalesce(F.try_element_at(table, F.lower(v)), v)))


# Digest algorithms in the order in which they are listed.
DIGESTS = ["md5", "sha1", "sha256", "sha512"]


def source_checksums(values: Column) -> Column:
    """``algorithm:hex`` of a map from algorithm to digest, in fixed order."""
    made = F.array(*[F.when(F.coalesce(values[a], F.lit("")) != "", F.concat(F.lit(a + ":"), F.lower(values[a]))) for a in DIGESTS])
    return F.array_compact(made)


def sri_checksum(integrity: Column) -> Column:
    """``algorithm:hex`` of a subresource-integrity value."""
    algorithm, value = F.substring_index(integrity, "-", 1), F.regexp_extract(integrity, r"^[^-]+-(.*)$", 1)
    return F.when(integrity.rlike(r"^[a-z0-9]+-[A-Za-z0-9+/=]+$"), F.concat(algorithm, F.lit(":"), F.lower(F.hex(F.unbase64(value)))))


def plain_checksum(value: Column) -> Column:
    """``algorithm:hex`` of a checksum in any usual notation; the algorithm follows from the length if it isn't stated."""
    s = F.lower(F.trim(value))
    digits = F.regexp_extract(s, r"([0-9a-f]{32,128})\s*$", 1)
    by_length = F.when(F.length(digits) == 32, "md5").when(F.length(digits) == 40, "sha1").when(F.length(digits) == 64, "sha256").when(F.length(digits) == 128, "sha512")
    return F.when(by_length.isNotNull(), F.concat(by_length, F.lit(":"), digits))


def version_identity(registry: Column, version: Column) -> Column:
    """struct(upstream, revision): the version that registries share, and the packaging revision."""
    v = F.regexp_replace(F.trim(version), r"^[vV](?=\d)", "")
    plus, hunter = r"^(.*)\+(\d+)$", r"(?i)^(.*?)[-_.]hunter(?:[-_.]?(\d+))?$"
    number = F.regexp_extract(v, hunter, 2)
    upstream = F.when((registry == "cppget") & v.rlike(plus), F.regexp_extract(v, plus, 1)).when((registry == "hunter") & v.rlike(hunter), F.regexp_extract(v, hunter, 1)).otherwise(v)
    revision = F.when((registry == "cppget") & v.rlike(plus), F.regexp_extract(v, plus, 2)).when((registry == "hunter") & v.rlike(hunter), F.when(number == "", "hunter").otherwise(F.concat(F.lit("hunter-"), number))).otherwise(F.lit(""))
    return F.struct(upstream.alias("upstream"), revision.alias("revision"))


def natural_key(version: Column) -> Column:
    """A text that sorts like the version: numbers are padded to twenty digits."""
    spaced = F.regexp_replace(F.lower(version), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(spaced, r"0*(\d{20})(?!\d)", "$1")


def release_id(version: Column, revision: Column, channel: Column) -> Column:
    """Version with ``#revision`` and ``@channel`` if they are stated."""
    part = lambda mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(mark), c)).otherwise(F.lit(""))
    return F.concat(version, part("#", revision), part("@", channel))


# Fixed value: a subject that only marks membership in a list.
SUBJECT_MARKER = "open_syllabus_project"


def subjects(values: Column, longest: int = 60, most: int = 12) -> Column:
    """Subjects of at most ``longest`` characters, distinct without case, the first ``most``."""
    short = F.filter(clean_list(values), lambda v: (F.length(v) <= longest) & (F.lower(v) != SUBJECT_MARKER))
    once = F.aggregate(short, F.array().cast("array<string>"), lambda a, v: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(v)), a).otherwise(F.concat(a, F.array(v))))
    return F.slice(once, 1, most)


def valid_isbn(value: Column) -> Column:
    """Whether the check digit of an ISBN-10 or ISBN-13 (hyphens allowed) is right."""
    s = F.upper(F.regexp_replace(value, "-", ""))
    digit = lambda i: F.when(F.substring(s, i, 1) == "X", 10).otherwise(F.substring(s, i, 1).try_cast("int"))
    thirteen = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda a, i: a + digit(i) * F.when(i % 2 == 0, 3).otherwise(1))
    ten = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda a, i: a + digit(i) * (11 - i))
    return F.coalesce(F.when(s.rlike(r"^97[89]\d{10}$"), thirteen % 10 == 0).when(s.rlike(r"^\d{9}[\dX]$"), ten % 11 == 0), F.lit(False))


def isbn10(isbn13: Column) -> Column:
    """The ISBN-10 of an ISBN-13 that starts with 978, else ''."""
    s = F.regexp_replace(isbn13, "-", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + F.substring(s, i + 3, 1).try_cast("int") * (11 - i))
    check = (11 - total % 11) % 11
    return F.coalesce(F.when(s.rlike(r"^978\d{10}$"), F.concat(F.substring(s, 4, 9), F.when(check == 10, "X").otherwise(check.cast("string")))), F.lit(""))


def split_title(title: Column, subtitle: Column) -> Column:
    """struct(title, subtitle): ``Title: Subtitle`` split if the heading has two words or more and there is no subtitle."""
    head, tail = F.substring_index(title, ": ", 1), F.regexp_extract(title, r"(?s)^.*?: (.*)$", 1)
    splits = (F.coalesce(subtitle, F.lit("")) == "") & title.contains(": ") & (F.size(F.split(F.trim(head), r"\s+")) >= 2)
    return F.struct(F.when(splits, head).otherwise(F.trim(title)).alias("title"), F.when(splits, tail).otherwise(F.coalesce(subtitle, F.lit(""))).alias("subtitle"))


def without_empty(c: Column, kind: str) -> Column:
    """Null for an empty value of the given kind (text, flag, list or map); zero stays."""
    if kind == "text":
        return F.nullif(c, F.lit(""))
    if kind == "flag":
        return F.when(c, c)
    return F.when(F.size(c) > 0, c)


def upstream_of(version: Column, upstream: Column) -> Column:
    """The stated upstream version, else the version up to its revision or channel."""
    return F.coalesce(F.nullif(upstream, F.lit("")), F.regexp_extract(version, r"^([^#@]*)", 1))


def version_order(version: Column, upstream: Column, default: Column) -> list[Column]:
    """Sort columns of a package's versions: those of the default version first, then the greatest by numbers."""
    return [F.desc(F.coalesce(upstream_of(version, upstream) == default, F.lit(False))), F.desc(natural_key(version)), F.desc(version)]


def text_or_value(c: Column) -> Column:
    """A JSON text, or the ``value`` of a JSON object, without entities and blanks at the ends; '' for neither."""
    plain = F.when(c.rlike(r"^\s*\{"), F.get_json_object(c, "$.value")).otherwise(F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v"), c))
    return F.trim(entities_decoded(F.coalesce(plain, F.lit(""))))
