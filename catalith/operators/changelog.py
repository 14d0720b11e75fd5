"""An append-only change log: positions, chunks, descriptors and replay.

Positions are global row numbers made without a single-task sort: rows are
range-partitioned, each range counts its rows, and the offsets (one row a range)
are broadcast.  Chunks are cut by the running number of bytes, which is a sum of
the same kind, so a log of any length stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.operators import merge
from catalith.util import Scratch


def positions(rows: DataFrame, order: list[str], size: Column | None = None) -> DataFrame:
    """``rows`` with ``position`` (from 0) and ``offset``, the sum of ``size`` before the row."""
    sized = rows.withColumn("__size", size if size is not None else F.lit(1).cast("long"))
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = Scratch(rows.sparkSession, "positions").keep(ranged, "ranged")
    totals = ranged.groupBy("__part").agg(F.count("*").alias("n"), F.sum("__size").alias("s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__s0"))
    own = Window.partitionBy("__part").orderBy(*order)
    local = ranged.withColumns({"__n": F.row_number().over(own) - 1, "__s": F.sum("__size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__size")})
    out = local.join(F.broadcast(starts), "__part").withColumns({"position": F.col("__n0") + F.col("__n"), "offset": F.col("__s0") + F.col("__s")})
    return out.drop("__part", "__size", "__n0", "__s0", "__n", "__s")


def operations(before: DataFrame, after: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The changes that turn ``before`` into ``after``: upserts in order, then deletes by key."""
    up = merge.changed(before, after, key).withColumn("_deleted", F.lit(False))
    down = merge.deleted(before, after, key).select(key, *[F.lit(None).cast(after.schema[c].dataType).alias(c) for c in after.columns if c != key], F.lit(True).alias("_deleted"))
    return positions(up.unionByName(down), ["_deleted", *order, key])


def chunked(rows: DataFrame, order: list[str], size: Column, target: int) -> DataFrame:
    """``rows`` with their position and chunk: a chunk holds about ``target`` bytes."""
    return positions(rows, order, size).withColumn("chunk", F.floor(F.col("offset") / target).cast("int"))


def descriptors(rows: DataFrame, time: str, size: Column, live: Column) -> DataFrame:
    """One row per chunk: operations, start, bytes, time span of live operations, sealed (all but the last)."""
    chunks = rows.groupBy("chunk").agg(
        F.count("*").alias("operations"), F.min("position").alias("start"), F.sum(size).alias("bytes"),
        F.min(F.when(live, F.col(time))).alias("first_time"), F.max(F.when(live, F.col(time))).alias("last_time"))
    last = rows.agg(F.max("chunk").alias("__last"))
    return chunks.crossJoin(F.broadcast(last)).withColumn("sealed", F.col("chunk") < F.col("__last")).drop("__last")


def replay(log: DataFrame, key: str, position: str = "position", deleted: str = "_deleted") -> DataFrame:
    """State after all operations: the last one of each key, unless it deletes."""
    cols = [c for c in log.columns if c not in (key, position)]
    last = log.groupBy(key).agg(F.max(F.struct(position, F.struct(*cols).alias("row"))).alias("l"))
    return last.where(~F.coalesce(F.col(f"l.row.{deleted}"), F.lit(False))).select(key, *[F.col(f"l.row.{c}").alias(c) for c in cols if c != deleted])
