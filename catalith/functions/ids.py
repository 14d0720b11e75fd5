"""Stable ids, digests and hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(*parts: Column) -> Column:
    """URL-safe base64 of the first 12 bytes of SHA-256 over the parts with NUL between them."""
    joined = F.concat(*[x for i, p in enumerate(parts) for x in ([F.char(F.lit(0)), p] if i else [p])])
    return F.translate(F.base64(F.unhex(F.substring(F.sha2(joined, 256), 1, 24))), "+/", "-_")


def digest(text: Column, length: int = 16) -> Column:
    """The first hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, length)


def event_id(source: Column, uid: Column, title: Column, start: Column, domain: str) -> Column:
    """Source, digest of the uid (or of title and date if there is none), and a domain."""
    identity = F.coalesce(F.nullif(uid, F.lit("")), F.concat(F.coalesce(title, F.lit("")), F.char(F.lit(0)), F.date_format(start, "yyyy-MM-dd")))
    return F.concat(source, F.lit("-"), digest(identity), F.lit("@" + domain))


def slug(name: Column, fallback: str = "package") -> Column:
    """Lower-case letters and digits with single hyphens."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", fallback).otherwise(s)


def qualified_slug(base: Column, members: Column) -> Column:
    """A slug with a digest of its sorted members, for names that several groups share."""
    return F.concat(base, F.lit("-"), digest(F.array_join(members, "\n"), 8))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, as a long."""
    raw = F.encode(text, "UTF-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("long")
    steps = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(2166136261).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))


def bucket(text: Column, buckets: int) -> Column:
    """The bucket of an id; ``buckets`` is a power of two."""
    if buckets < 1 or buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    return fnv1a(text).bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")
