"""Text values that were cut off, and how often each source cuts.

Per source the lengths of all texts are counted, in characters and in bytes.  A
length is a spike if it holds far more texts than the lengths around it and lies
where the source's lengths end (its maximum, or the maximum of what still fits a
byte limit).  A source that cuts behind the last whole word, or writes a mark after
the cut, ends in a band of lengths instead: a band is a limit if it holds
significantly more texts than the lengths before it let expect.  A text at a spike
without terminal punctuation was cut, as was one that ends in a truncation mark or
in a torn tag or entity; the band says that a source cuts, and its texts are judged
by their ends.

Transfers also break off at any length, so texts off the spikes are judged by
their last line: running prose without terminal punctuation was cut; a list item,
link, tags, code or a closing line is complete.  Which short lines are closings
is learned from all texts: a line that begins like many others and that most of
them equal as a whole is a closing, one that most of them continue is a fragment.

Only counts are shuffled, combined map-side: (source, length) and the beginnings
of lines.  Texts stay where they are read, and are read whole.

Defined cases: null and blank texts aren't cut; null sources form a source of
their own; repeated rows count as often as they occur; a cut that happens to end
behind a full stop can't be told from an end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.util import Scratch, broadcast_if_small, table

#: A spike holds at least so many texts, and so many times the mean of the lengths around it.
SPIKE_TEXTS, SPIKE_FACTOR = 8, 6.0
#: Lengths on either side that a spike is held against.
AROUND = 24
#: Lengths of a band at a limit (a word and a mark), bands before it that tell what to expect, and standard deviations above that.
BAND, BEFORE, DEVIATIONS = 12, 5, 6.0
#: Share of a source's texts that may be longer than a spike (rows that escaped the limit).
LONGER_SHARE = 0.02
#: Lines that must begin alike, and the share of them that must equal a closing.
CLOSING_LINES, CLOSING_SHARE = 4, 0.5
#: Words of a line that count as its beginning.
HEAD_WORDS = 3

MARK = r"(?:\((?:more|continued)\)|…|\.{3}|\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\))[\s\p{Z}]*$"
TORN = r"(?:&#?[A-Za-z0-9]{0,8}|</?[A-Za-z][^<>]{0,200}|<|\ufffd+)$"
TERMINAL = r"[.!?。！？](?:[\"'”’»)\]*_]|</[A-Za-z0-9]+>|&quot;)*$"
# Last lines that are complete without a full stop, by their form.
FORMS = [
    r"^\s*(?:[-*+•–]|\d{1,3}[.)])\s+\S",  # list item
    r"^\s*(?:```|~~~)",  # fence
    r"^[<(\[]?(?:https?|ftp)://\S+[>)\]]?$",  # link
    r"^#[\p{L}\p{N}_]+(?:\s+#[\p{L}\p{N}_+-]+)*$",  # tags
    r"^`[^`]+`$",  # code
    r"[;{}]\s*$",  # code
    r"^(?:--|—|–)\s?\S",  # signature
    r"^\(.*\)$",  # aside
    r"[:;]-?[)DP]$",  # smiley
    r"^\s*</?[A-Za-z][^<>]*>$",  # tag
    r"^\s*\|.*\|$",  # table row
    r"^#{1,6}\s+\S",  # heading
]


def _masked(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+(?:[.,:]\d+)*", "9"), r"[\s\p{Z}]+", " "))


def _head(line: Column) -> Column:
    return F.substring_index(line, " ", HEAD_WORDS)


def spikes(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, unit, n, exact): lengths at which a source cuts its texts; not ``exact`` are those of a band at a limit."""
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.length(text).alias("n")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(text).alias("n")))
    lengths = docs.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.explode(units).alias("u")).groupBy("source", "u.unit", "u.n").agg(F.count("*").alias("texts"))
    own = Window.partitionBy("source", "unit")
    near = own.orderBy("n").rangeBetween(-AROUND, AROUND)
    here, before = own.orderBy("n").rangeBetween(1 - BAND, 0), own.orderBy("n").rangeBetween(-(BEFORE + 1) * BAND + 1, -BAND)
    seen = lengths.withColumns({
        "all": F.sum("texts").over(own), "upto": F.sum("texts").over(own.orderBy("n")), "near": F.sum("texts").over(near),
        "band": F.sum("texts").over(here), "expected": F.coalesce(F.sum("texts").over(before), F.lit(0)) / BEFORE})
    mean = (F.col("near") - F.col("texts")) / (2.0 * AROUND)
    last = F.col("all") - F.col("upto") <= F.col("all") * LONGER_SHARE
    spike = (F.col("texts") >= SPIKE_TEXTS) & (F.col("texts") >= SPIKE_FACTOR * mean) & last
    limit = (F.col("band") >= SPIKE_TEXTS) & (F.col("band") - F.col("expected") >= DEVIATIONS * F.sqrt(F.col("expected") + 1)) & last
    told = seen.select("source", "unit", "n", spike.alias("exact"), F.max(limit).over(own.orderBy("n").rangeBetween(0, BAND - 1)).alias("limit"))
    return told.where("exact OR limit").select("source", "unit", "n", "exact")


def closings(docs: DataFrame, text: str) -> DataFrame:
    """Masked short lines that end texts and that most lines beginning alike equal."""
    lines = docs.where(F.col(text).isNotNull()).select(F.explode(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).alias("line"))
    lines = lines.where(~F.col("line").rlike(r"^\s*\p{Ll}|[.!?] "))  # no running prose
    masked = lines.select(_masked(F.col("line")).alias("m"), (F.length("line") <= 80).alias("short"))
    heads = masked.select("m", "short", F.explode(F.array_distinct(F.array(*[F.substring_index("m", " ", k) for k in range(1, HEAD_WORDS + 1)]))).alias("head"))
    heads = heads.groupBy(F.when(F.col("short"), F.col("m")).alias("m"), "head").agg(F.count("*").alias("lines"))
    whole = heads.where(F.col("m").isNotNull() & (F.col("head") == _head(F.col("m")))).select("m", "head", "lines")
    begun = heads.groupBy("head").agg(F.sum("lines").alias("begun"))
    kept = whole.where(F.col("lines") >= CLOSING_LINES).join(begun, "head").where(F.col("lines") >= CLOSING_SHARE * F.col("begun"))
    return kept.select("m")


def find_truncated(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, reason) of the texts that were cut; reason: spike, limit, mark, torn or fragment.

    ``spike`` and ``limit`` are lengths at which the source's histogram shows a cut.
    """
    scratch = Scratch(docs.sparkSession, "truncation")
    peaks = scratch.keep(spikes(docs, source, text), "spikes")
    t = F.col(text)
    bare = F.regexp_replace(t, r"[\s\p{Z}]+$", "")
    tail = docs.where(t.isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), bare.alias("bare"))
    tail = tail.where("bare <> ''").withColumn("line", F.substring_index("bare", "\n", -1)).select("doc_id", "source", "chars", "bytes", "line")
    ended = F.col("line").rlike(TERMINAL)
    marked = F.col("line").rlike(MARK)
    tail = tail.withColumns({"marked": marked, "torn": F.col("line").rlike(TORN), "ended": ended}).where("marked OR torn OR NOT ended")
    form = F.lit(False)
    for f in FORMS:
        form = form | F.col("line").rlike(f)
    tail = tail.withColumns({"formed": form, "m": _masked(F.col("line"))})
    tail = scratch.keep(tail, "tails")
    known = closings(docs, text).join(tail.where("NOT formed AND NOT marked AND NOT torn AND length(line) <= 80").select("m").distinct(), "m", "left_semi")
    known = scratch.keep(known.withColumn("closing", F.lit(True)), "closings")
    at = lambda unit, c: peaks.where(F.col("unit") == unit).select(F.col("source").alias(f"s_{c}"), F.col("n").alias(f"n_{c}"), F.col("exact").alias(f"at_{c}"))
    judged = (
        tail.join(broadcast_if_small(at("chars", "chars")), F.col("source").eqNullSafe(F.col("s_chars")) & (F.col("chars") == F.col("n_chars")), "left")
        .join(broadcast_if_small(at("bytes", "bytes")), F.col("source").eqNullSafe(F.col("s_bytes")) & (F.col("bytes") == F.col("n_bytes")), "left")
        .join(known, "m", "left")
    )
    exact = F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))
    limit = F.col("at_chars").isNotNull() | F.col("at_bytes").isNotNull()
    fragment = ~F.col("ended") & ~F.col("formed") & F.col("closing").isNull()
    broken = F.col("marked") | F.col("torn")
    reason = (
        F.when(exact & (broken | ~F.col("ended")), "spike")
        .when(limit & (broken | fragment), "limit")
        .when(F.col("marked"), "mark")
        .when(F.col("torn"), "torn")
        .when(fragment, "fragment")
    )
    return judged.select("doc_id", "source", reason.alias("reason")).where("reason IS NOT NULL")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of every text that was cut."""
    return find_truncated(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id").distinct()


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, texts, cut, share): how often each source cuts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = find_truncated(docs).groupBy("source").agg(F.countDistinct("doc_id").alias("cut"))
    total = docs.groupBy("source").agg(F.count("*").alias("texts")).select(F.col("source").alias("__s"), "texts")
    both = total.join(cut, F.col("__s").eqNullSafe(F.col("source")), "left")
    return both.select(F.col("__s").alias("source"), "texts", F.coalesce("cut", F.lit(0)).alias("cut"), F.round(F.coalesce("cut", F.lit(0)) / F.col("texts"), 6).alias("share"))


def p9_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, reason, texts, share): what shows the cuts of each source, and the share of its cut texts."""
    cut = find_truncated(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).dropDuplicates(["doc_id"])
    counted = cut.groupBy("source", "reason").agg(F.count("*").alias("texts"))
    total = counted.groupBy(F.col("source").alias("__s")).agg(F.sum("texts").alias("all"))
    both = counted.join(total, F.col("source").eqNullSafe(F.col("__s")))
    return both.select("source", "reason", "texts", F.round(F.col("texts") / F.col("all"), 6).alias("share"))
