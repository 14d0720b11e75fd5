"""Current state of a table from a feed of inserts, updates and deletes.

Column-wise last writer wins: each field takes the value of the latest change
that sets it, among the changes after the latest delete.  One aggregation with
map-side combine: for every field the greatest (order, value) pair, and the
greatest order of a delete; a field counts if its order is above the delete's.
Repeats and late arrivals need no sorting, a hot key is combined before the
shuffle, and no row is collected.

Defined cases: an operation without id, collection or revision cannot be ordered
and is left out; a null delete flag means false; a null field is not set by that
change; a revision may be repeated with equal content only, and where a feed
breaks that, each field takes the first arrival that sets it; a delete of an
absent record has no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalith.util import table


def apply_changes(changes: DataFrame, keys: list[str], fields: list[str], revision: str = "revision", arrival: str = "op_id", deleted: str = "_deleted") -> DataFrame:
    """Rows alive after all changes: keys, revision and fields."""
    spark = changes.sparkSession
    name = f"changes_{id(changes):x}"
    changes.createOrReplaceTempView(name)
    at = f"named_struct('r', `{revision}`, 'a', -`{arrival}`)"
    live, dead = f"NOT coalesce(`{deleted}`, false)", f"coalesce(`{deleted}`, false)"
    key_list = ", ".join(f"`{k}`" for k in keys)
    tops = ",\n  ".join(f"max(CASE WHEN {live} AND `{f}` IS NOT NULL THEN named_struct('at', {at}, 'value', `{f}`) END) AS `__{f}`" for f in fields)
    picks = ", ".join(f"CASE WHEN __deleted_at IS NULL OR `__{f}`.at > __deleted_at THEN `__{f}`.value END AS `{f}`" for f in fields)
    some_key = " AND ".join(f"`{k}` IS NOT NULL" for k in keys)
    out = spark.sql(f"""
WITH latest AS (
  SELECT {key_list},
  max(CASE WHEN {live} THEN {at} END) AS __changed_at,
  max(CASE WHEN {dead} THEN {at} END) AS __deleted_at,
  {tops}
  FROM {name}
  WHERE {some_key} AND `{revision}` IS NOT NULL AND `{arrival}` IS NOT NULL
  GROUP BY {key_list}
)
SELECT {key_list}, __changed_at.r AS `{revision}`, {picks}
FROM latest
WHERE __changed_at IS NOT NULL AND (__deleted_at IS NULL OR __changed_at > __deleted_at)
""")
    spark.catalog.dropTempView(name)
    return out


def current_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current records of every collection of browser_changes."""
    return apply_changes(table(spark, sf_dir, "browser_changes"), ["collection_name", "id"], ["title", "content", "url"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(collection_name, id, revision) of each record alive after all operations."""
    return current_records(spark, sf_dir).select("collection_name", "id", "revision")


P6_FOUND_SQL = """
WITH first_arrival AS (
  SELECT *, row_number() OVER (PARTITION BY collection_name, id ORDER BY revision DESC, op_id) AS n
  FROM browser_changes
  WHERE collection_name IS NOT NULL AND id IS NOT NULL AND revision IS NOT NULL
)
SELECT collection_name, id, revision FROM first_arrival WHERE n = 1 AND NOT coalesce(_deleted, false)
"""

P6_STATE_SQL = """
WITH ops AS (
  SELECT *, coalesce(_deleted, false) AS gone FROM browser_changes
  WHERE collection_name IS NOT NULL AND id IS NOT NULL AND revision IS NOT NULL
), last_delete AS (
  SELECT collection_name, id, max(revision) AS deleted_at FROM ops WHERE gone GROUP BY ALL
), live AS (
  SELECT o.* FROM ops o LEFT JOIN last_delete d USING (collection_name, id) WHERE NOT gone AND (deleted_at IS NULL OR revision > deleted_at)
)
SELECT collection_name, id, max(revision) AS revision, arg_max(title, revision) AS title, arg_max(content, revision) AS content, arg_max(url, revision) AS url
FROM live GROUP BY collection_name, id
"""
