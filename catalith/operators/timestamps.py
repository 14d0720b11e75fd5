"""Timestamps in mixed formats and zones, brought to one UTC instant.

An ordered cascade of anchored patterns turns a text into nine parts (year,
month, day, hour, minute, second, fraction, half of day, zone); the parts are
checked strictly, then resolved by the stated offset or zone, else by the zone
of the source.  Everything stays in JVM expressions; each text is matched by one
pattern and split once, and no row is shuffled.

Defined cases: null, blank and senseless texts, impossible dates (30 February,
25:00) and unknown zone names give null.  A local time that occurs twice means
its first occurrence (or the second, by ``ambiguous``); one that a change skips
uses the offset before the change (or gives null, by ``skipped``).  A date alone
is the start of its local day.  Units that are not stated are zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.util import broadcast_if_small, table

# Month names of the supported locales, English short forms too.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en_short": "jan feb mar apr may jun jul aug sep oct nov dec",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
# Minutes east of UTC of zone abbreviations.
ZONE_MINUTES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "JST": 540, "AEST": 600, "AEDT": 660, "COT": -300, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_ZONE = r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{1,5})?"
_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: name, anchored pattern, order of the groups as year|month|day|hour|minute|second|fraction|half|zone|named zone
PATTERNS = [
    ("iso", r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)? ?" + _ZONE + r"(?:\[([A-Za-z0-9_/+-]+)\])?)?", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("basic", r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + _ZONE, "$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("named", r"(?:\p{L}{2,10}\.?,? )?(\d{1,2})(?:\.|er|st|nd|rd|th)? (?:de )?(\p{L}{3,10})\.? (?:de )?(\d{4})(?:,? (?:at |um |à |a las )?" + _CLOCK + r"(?: Uhr)?)?(?: " + _ZONE + ")?", "$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("american", r"(?:\p{L}{2,10}\.?, )?(\p{L}{3,10})\.? (\d{1,2})(?:st|nd|rd|th)?, (\d{4})(?:,? (?:at )?" + _CLOCK + r"(?: ?([APap])\.?[Mm]\.?)?)?(?: " + _ZONE + ")?", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    ("slashes", r"(\d{1,2})/(\d{1,2})/(\d{4})(?:,? " + _CLOCK + r"(?: ?([APap])\.?[Mm]\.?)?)?(?: " + _ZONE + ")?", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
    ("dots", r"(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,? " + _CLOCK + r"(?: Uhr)?)?(?: " + _ZONE + ")?", "$3|$2|$1|$4|$5|$6|$7||$8|"),
]
#: digits of an epoch number and its ticks a second
EPOCHS = [(9, 10, 1), (12, 13, 1_000), (15, 16, 1_000_000), (18, 19, 1_000_000_000)]


def known_zones(spark: SparkSession) -> list[str]:
    """Zone names that the JVM can resolve."""
    names = spark._jvm.java.lang.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    return sorted(n for n in names.split(",") if "'" not in n)


def _zone_minutes(text: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])
    digits = F.regexp_replace(text, ":", "")
    hours, minutes = F.substring(digits, 2, 2).try_cast("int"), F.coalesce(F.substring(digits, 4, 2).try_cast("int"), F.lit(0))
    signed = F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1) * (hours * 60 + minutes)
    numeric = F.when((hours <= 18) & (minutes <= 59), signed)
    return F.when(text.rlike(r"^[+-]"), numeric).otherwise(F.try_element_at(names, F.upper(text)))


def add_instants(df: DataFrame, text: str, zone: str, locale: str, out: str = "epoch_us", ambiguous: str = "first", skipped: str = "before", month_first: str = r"^en[-_]US$") -> DataFrame:
    """``df`` with the microseconds since 1970-01-01 UTC that ``text`` states.

    The work is split into projections that each reuse the columns of the one
    before, so no expression is repeated in the generated code.
    """
    if ambiguous not in ("first", "second") or skipped not in ("before", "null"):
        raise ValueError("ambiguous: first or second; skipped: before or null")
    keep = df.columns
    long = lambda n: F.lit(n).cast("long")
    s = F.regexp_replace(F.regexp_replace(F.col(text).cast("string"), r"^[\s\p{Z}\u200b]+|[\s\p{Z}\u200b]+$", ""), r"[\s\p{Z}]+", " ")
    packed = reduce(
        lambda rest, p: F.when(F.col("__s").rlike(f"^(?:{p[1]})$"), F.concat(F.lit(p[0] + "|"), F.regexp_replace("__s", f"^(?:{p[1]})$", p[2]))).otherwise(rest),
        reversed(PATTERNS),
        F.lit(None),
    )
    epoch = reduce(
        lambda rest, e: F.when(F.col("__s").rlike(rf"^-?\d{{{e[0]},{e[1]}}}$"), F.floor(F.col("__s").try_cast("long") * long(max(1, 1_000_000 // e[2])) / long(max(1, e[2] // 1_000_000))).cast("long") if e[2] > 1_000_000 else F.col("__s").try_cast("long") * long(1_000_000 // e[2])).otherwise(rest),
        EPOCHS,
        F.lit(None).cast("long"),
    )
    df = df.withColumn("__s", s).withColumns({"__p": F.split(packed, r"\|", -1), "__epoch": epoch})
    p = F.col("__p")
    a, b = F.element_at(p, 3), F.element_at(p, 4)
    swap = (F.element_at(p, 1) == "slashes") & ~F.coalesce(F.col(locale).rlike(month_first), F.lit(False))
    df = df.withColumns({"__mt": F.when(swap, b).otherwise(a), "__dt": F.when(swap, a).otherwise(b)})
    names = {n: i for group in MONTHS.values() for i, n in enumerate(group.split(), 1)}
    month_map = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    unit = lambda i: F.coalesce(F.element_at(p, i).try_cast("int"), F.when(F.element_at(p, i) == "", 0))
    df = df.withColumns({
        "__y": F.element_at(p, 2).try_cast("int"),
        "__m": F.coalesce(F.col("__mt").try_cast("int"), F.try_element_at(month_map, F.lower("__mt"))),
        "__d": F.col("__dt").try_cast("int"),
        "__h12": unit(5), "__mi": unit(6), "__sec": unit(7),
        "__us": F.when(F.element_at(p, 8) == "", 0).otherwise(F.substring(F.rpad(F.element_at(p, 8), 9, "0"), 1, 6).try_cast("int")),
        "__half": F.upper(F.element_at(p, 9)),
        "__stated": F.element_at(p, 10), "__named": F.element_at(p, 11),
    })
    y, m, h = F.col("__y"), F.col("__m"), F.col("__h12")
    df = df.withColumns({
        "__h": F.when(F.col("__half") == "", h).when(h.between(1, 12), h % 12 + F.when(F.col("__half") == "P", 12).otherwise(0)),
        "__last": F.when(m == 2, F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31),
    })
    valid = m.between(1, 12) & (F.col("__d") >= 1) & (F.col("__d") <= F.col("__last")) & F.col("__h").between(0, 23) & F.col("__mi").between(0, 59) & F.col("__sec").between(0, 59) & (y >= 1)
    days = F.unix_date(F.make_date(y, m, F.col("__d"))).cast("long")
    local = F.when(valid, ((days * 24 + F.col("__h")) * 60 + F.col("__mi")) * long(60_000_000) + F.col("__sec") * long(1_000_000) + F.col("__us"))
    place = F.when(F.col("__named") != "", F.col("__named")).when(F.coalesce(F.col(zone), F.lit("")) == "", F.lit("UTC")).otherwise(F.col(zone))
    df = df.withColumns({"__local": local, "__place": place})
    df = df.withColumn("__place", F.expr("CASE WHEN __place IN (" + ", ".join(f"'{z}'" for z in known_zones(df.sparkSession)) + ") THEN __place END"))
    df = df.withColumn("__first", F.to_utc_timestamp(F.timestamp_micros("__local"), F.col("__place")))
    by_zone = F.unix_micros("__first")
    back = F.unix_micros(F.from_utc_timestamp("__first", F.col("__place")))
    if ambiguous == "second":  # the same wall time may come again within three hours
        later = [by_zone + long(n * 60_000_000) for n in (30, 60, 120, 180)]
        again = [F.when(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(t), F.col("__place"))) == F.col("__local"), t) for t in later]
        by_zone = F.when(back == F.col("__local"), F.coalesce(*again, by_zone)).otherwise(by_zone)
    if skipped == "null":
        by_zone = F.when(back == F.col("__local"), by_zone)
    by_offset = F.col("__local") - _zone_minutes(F.col("__stated")) * long(60_000_000)
    us = F.coalesce(F.when(F.col("__stated") != "", by_offset).otherwise(by_zone), F.col("__epoch"))
    return df.select(*[F.col(f"`{c}`") for c in keep], us.alias(out))


def normalise_timestamps(rows: DataFrame, key: str, fields: list[str], sources: DataFrame, source_key: str, zone: str, locale: str, **policy) -> DataFrame:
    """One row (key, field_name, epoch_us) for each field that states an instant.

    ``sources`` gives each source's zone and locale; it is broadcast only if it
    is small.  A source that it lacks counts as UTC with the day first.  Repeated
    source keys take the smallest zone, so rows never multiply.
    """
    lookup = sources.where(F.col(source_key).isNotNull()).groupBy(F.col(source_key).alias("__key")).agg(F.min(zone).alias("__zone"), F.min(locale).alias("__locale"))
    long = rows.select(F.col(key), F.col(source_key).alias("__source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("text")) for f in fields])).alias("__f"))
    long = long.where(F.col("__f.text").isNotNull() & F.col("__f.text").rlike(r"\d"))
    joined = long.join(broadcast_if_small(lookup), F.col("__source") == F.col("__key"), "left")
    named = joined.select(F.col(key), F.col("__f.field_name").alias("field_name"), F.col("__f.text").alias("__text"), "__zone", "__locale")
    stated = add_instants(named, "__text", "__zone", "__locale", **policy)
    # exploding drops the nulls; a filter would be pushed below the projections and repeat them all
    return stated.select(key, "field_name", F.explode(F.array_compact(F.array("epoch_us"))).alias("epoch_us"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fetch_id, field_name, epoch_us) of every stated time of blog_posts."""
    posts, sources = table(spark, sf_dir, "blog_posts"), table(spark, sf_dir, "blog_sources")
    return normalise_timestamps(posts, "fetch_id", ["published", "updated"], sources, "source_id", "zone_name", "locale")
