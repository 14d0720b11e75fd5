"""Keyed merges that keep history: upserts, labels, overrides, hiding and retention.

All are aggregations or joins on the record key.  Latest rows are chosen by the
greatest (order, row) pair with map-side combine, so a hot key needs no sort.
Null keys are left out; ties of the order fall to the greatest row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.util import broadcast_if_small


def upsert(rows: DataFrame, key: str, order: list[str], carried: list[str] = (), first_seen: str | None = None) -> DataFrame:
    """The latest row of each key; ``carried`` fields keep their last stated value.

    ``order`` ends with a unique column.  ``first_seen`` names a column for the
    smallest value of that last order column, the place a merge would keep.
    """
    at = F.struct(*[F.col(c) for c in order])
    others = [c for c in rows.columns if c != key and c not in carried]
    latest = F.max(F.struct(at.alias("__at"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")))
    kept = [F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("__at"), F.col(f"`{c}`").alias("v")))).alias(f"__{c}") for c in carried]
    extra = [F.min(order[-1]).alias(first_seen)] if first_seen else []
    out = rows.where(F.col(key).isNotNull()).groupBy(key).agg(latest.alias("__l"), *kept, *extra)
    return out.select(key, *[F.col(f"__l.row.`{c}`").alias(c) for c in others], *[F.col(f"__{c}.v").alias(c) for c in carried], *([first_seen] if first_seen else []))


def carry_forward(rows: DataFrame, key: str, order: list[str], field: str, out: str) -> DataFrame:
    """Every row with the last stated value of ``field`` of its key up to that row."""
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(field, ignorenulls=True).over(window))


def top_n(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in an order that must be total."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def retain(rows: DataFrame, time: str, cutoff: str, most: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows at or after the cutoff, and of those the first ``most`` in order."""
    kept = rows.where(F.col(time) >= F.lit(cutoff).cast("timestamp"))
    return kept.orderBy(*order).limit(most) if most is not None else kept


def label(rows: DataFrame, labels: DataFrame, key: str, field: str) -> DataFrame:
    """Rows with the labelled value of ``field`` where there is one; a label outside 0..1 is an error."""
    checked = labels.select(F.col(key), F.when(F.col("label").between(0, 1), F.col("label")).otherwise(F.raise_error("labels lie between 0 and 1").cast("double")).alias("__label"))
    return rows.join(broadcast_if_small(checked), key, "left").withColumn(field, F.coalesce("__label", field)).drop("__label")


def relevant(rows: DataFrame, field: str, least: float = 0.5) -> DataFrame:
    """Rows without a label, or with one of at least ``least``."""
    return rows.where(F.col(field).isNull() | (F.col(field) >= least))


def override(rows: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with curated values of ``fields`` (a map column ``values``) and a ``hidden`` flag.

    A field that the map holds replaces the row's, also by an empty value; lists are
    stated as JSON.
    """
    typed = lambda f, kind: F.from_json(F.col("values")[f], kind) if kind.typeName() in ("array", "map", "struct") else F.col("values")[f].cast(kind)
    one = overrides.select(F.col(key).alias("__key"), "values", F.coalesce("hidden", F.lit(False)).alias("__hidden"))
    joined = rows.drop("hidden").join(broadcast_if_small(one), F.col(key) == F.col("__key"), "left")
    new = {f: F.when(F.coalesce(F.map_contains_key("values", F.lit(f)), F.lit(False)), typed(f, rows.schema[f].dataType)).otherwise(F.col(f)) for f in fields}
    return joined.withColumns({**new, "hidden": F.coalesce("__hidden", F.lit(False))}).drop("__key", "values", "__hidden")


def unknown_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Overrides whose record doesn't exist."""
    return overrides.join(rows.select(key).distinct(), key, "left_anti")


def hide_by_tag(rows: DataFrame, exclusions: DataFrame, source: str, tags: str, out: str = "hidden") -> DataFrame:
    """Rows with a flag: one of their tags is excluded for their source, without case and blanks."""
    plain = lambda c: F.lower(F.trim(c))
    lists = exclusions.groupBy(F.col(source).alias("__source")).agg(F.collect_set(plain(F.col("tag"))).alias("__tags"))
    joined = rows.join(broadcast_if_small(lists), F.col(source) == F.col("__source"), "left")
    return joined.withColumn(out, F.coalesce(F.arrays_overlap(F.transform(tags, plain), "__tags"), F.lit(False))).drop("__source", "__tags")


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of ``after`` that are new or differ from ``before`` in any column."""
    cols = [c for c in after.columns if c != key]
    old = before.select(F.col(key).alias("__key"), F.struct(*cols).alias("__old"))
    joined = after.join(old, F.col(key) == F.col("__key"), "left")
    return joined.where(F.col("__key").isNull() | ~F.struct(*cols).eqNullSafe(F.col("__old"))).drop("__key", "__old")


def deleted(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of ``before`` that ``after`` lacks."""
    return before.select(key).join(after.select(key), key, "left_anti")
