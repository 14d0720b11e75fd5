"""Streaming variants: the same merges over arriving batches.

Batches are applied by ``foreachBatch`` and are idempotent: a change counts by
its (revision, arrival) order, so repeats and late batches do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from catalith.operators import changefeed


def latest_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows per key and tumbling window; rows later than ``late`` are left out by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("rows")).select("window.start", "window.end", key, "rows")


def compact_changes(changes: DataFrame, keys: list[str], fields: list[str], revision: str = "revision", arrival: str = "op_id", deleted: str = "_deleted") -> DataFrame:
    """The changes that can still matter for each key: for every field the latest that sets it, and the latest delete.

    Applying the compacted log gives the state of the whole log.
    """
    at = F.struct(F.col(revision), -F.col(arrival))
    dead = F.coalesce(deleted, F.lit(False))
    row = F.struct(*[F.col(c) for c in changes.columns])
    tops = [F.max(F.when(~dead & F.col(f).isNotNull(), F.struct(at.alias("at"), row.alias("row")))).alias(f"__{i}") for i, f in enumerate(fields)]
    tops += [F.max(F.when(dead, F.struct(at.alias("at"), row.alias("row")))).alias("__dead"), F.max(F.when(~dead, F.struct(at.alias("at"), row.alias("row")))).alias("__live")]
    named = [f"__{i}" for i in range(len(fields))] + ["__dead", "__live"]
    best = changes.groupBy(*keys).agg(*tops)
    return best.select(F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(n)["row"] for n in named])))).alias("r")).select("r.*")


#: Parts of a stream's log by a hash of the key; a batch rewrites only those that it touches.
BUCKETS = 64


def apply_stream(spark: SparkSession, changes: DataFrame, target: str, checkpoint: str, keys: list[str], fields: list[str]) -> StreamingQuery:
    """Keeps the compacted log of a change stream in buckets under ``target``.

    ``read_state`` gives the current records.  A batch writes the buckets of its keys
    in full, as one table that counts once it is complete, so a failed batch changes
    nothing and a batch may be repeated; the others stay as they are.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = [r[0] for r in placed.select("__bucket").distinct().collect()]  # at most BUCKETS
        name = f"log-{batch_id:012d}"
        before = {k: p for k, p in _newest(spark, target).items() if f"/{name}/" not in p}
        held = [before[k] for k in touched if k in before]
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(*held)) if held else batch
        compact = compact_changes(rows, keys, fields).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        compact.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{target}/{name}")
        # what an earlier batch had replaced; a reader may still hold the parts that this one replaces
        for path in _parts(spark, target):
            if f"/{name}/" not in path and before.get(_bucket(path)) != path:
                fs, jpath = _fs(spark, path)
                fs.delete(jpath, True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _bucket(path: str) -> int:
    return int(path.rsplit("=", 1)[1])


def _parts(spark: SparkSession, target: str) -> list[str]:
    """Folders of all buckets of all complete batches, in order of the batches."""
    fs, jpath = _fs(spark, target)
    if not fs.exists(jpath):
        return []
    logs = sorted(s.getPath().toString() for s in fs.listStatus(jpath) if "/log-" in s.getPath().toString())
    done = [n for n in logs if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(n + "/_SUCCESS"))]
    return [s.getPath().toString() for n in done for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(n)) if "__bucket=" in s.getPath().toString()]


def _newest(spark: SparkSession, target: str) -> dict[int, str]:
    """The newest folder of each bucket."""
    return {_bucket(p): p for p in _parts(spark, target)}


def read_state(spark: SparkSession, target: str, keys: list[str], fields: list[str]) -> DataFrame | None:
    """Current records of a stream's log."""
    paths = sorted(_newest(spark, target).values())
    return changefeed.apply_changes(spark.read.parquet(*paths), keys, fields) if paths else None


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
