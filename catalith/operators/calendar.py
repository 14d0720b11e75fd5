"""Calendar views of events with inclusive date spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, month: str) -> DataFrame:
    """(day, week): the 42 days of a month view that starts on a Monday; ``month`` is YYYY-MM."""
    first = F.to_date(F.lit(month + "-01"))
    start = F.to_date(F.date_trunc("week", first))
    days = F.sequence(F.lit(0), F.lit(41))
    return spark.range(1).select(F.explode(days).alias("n")).select(F.date_add(start, F.col("n")).alias("day"), F.floor(F.col("n") / 7).cast("int").alias("week"))


def in_month(events: DataFrame, start: str, end: str, month: str) -> DataFrame:
    """Events that overlap the month."""
    first = F.to_date(F.lit(month + "-01"))
    return events.where((F.col(start) <= F.last_day(first)) & (F.coalesce(end, start) >= first))


def by_day(events: DataFrame, start: str, end: str, month: str) -> DataFrame:
    """Events of every day of the month view, with marks on the first and last day of a span.

    Spans are clipped to the view before they are exploded, so a long event costs
    at most 42 rows and the join is an equi-join by construction.
    """
    first = F.to_date(F.date_trunc("week", F.to_date(F.lit(month + "-01"))))
    last = F.date_add(first, 41)
    finish = F.coalesce(end, start)
    seen = events.where((F.col(start) <= last) & (finish >= first) & (finish >= F.col(start)))
    days = F.sequence(F.greatest(F.col(start), first), F.least(finish, last))
    return seen.withColumn("day", F.explode(days)).withColumns({"starts": F.col("day") == F.col(start), "ends": F.col("day") == finish})


def next_after(events: DataFrame, start: str, day: Column, cancelled: Column, order: list[str]) -> DataFrame:
    """The first event after a day that isn't cancelled."""
    return events.where((F.col(start) > day) & ~cancelled).orderBy(start, *order).limit(1)


def ical_feed(events: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """(by, document): events as one iCalendar text per value of ``by``, escaped and in order of start and uid.

    One row per calendar is the form of this sink; write calendars by source to keep them small.
    """
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"([\;,])", r"\\$1"), r"\r?\n", r"\\n")
    stamp = lambda c: F.date_format(c, "yyyyMMdd")
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "uid"), F.concat(F.lit("DTSTART;VALUE=DATE:"), stamp(F.col("start_date"))),
        F.concat(F.lit("DTEND;VALUE=DATE:"), stamp(F.date_add(F.coalesce("end_date", "start_date"), 1))), F.concat(F.lit("SUMMARY:"), safe(F.col("title"))),
        F.concat(F.lit("DESCRIPTION:"), safe(F.col("description"))), F.concat(F.lit("LOCATION:"), safe(F.col("location"))), F.concat(F.lit("STATUS:"), F.upper("status")), F.lit("END:VEVENT"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_date", "uid", lines.alias("l")))), lambda x: x["l"]), "\r\n")
    return events.groupBy(*(by or [])).agg(F.concat(F.lit(f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//{name}//EN\r\n"), body, F.lit("\r\nEND:VCALENDAR\r\n")).alias("document"))


def status(events: DataFrame, start: str, end: str, month: str, cancelled: Column, order: list[str]) -> tuple[str, DataFrame]:
    """(text, next): how many events a month shows, and the first one after it that isn't cancelled."""
    n = in_month(events, start, end, month).count()
    last = F.last_day(F.lit(f"{month}-01").cast("date"))
    return f"{n} event{'' if n == 1 else 's'}", next_after(events, start, last, cancelled, order)
