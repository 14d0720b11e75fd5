"""A record store in hash buckets: a lookup reads one bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from catalith.functions.ids import bucket, digest


def with_bucket(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """``rows`` with the bucket of their key; rows without key are left out."""
    return rows.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("bucket", bucket(F.col(key), buckets))


def write(rows: DataFrame, key: str, buckets: int, path: str) -> None:
    """One directory per bucket, sorted by key; a key that comes twice is an error."""
    placed = with_bucket(rows, key, buckets)
    if not placed.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    placed.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value: str, buckets: int, schema: StructType | None = None) -> DataFrame:
    """The record of a key; only its bucket is read.  With a schema the store may be empty."""
    place = spark.range(1).select(bucket(F.lit(value), buckets)).first()[0]
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())]))
    return reader.parquet(path).where((F.col("bucket") == place) & (F.col(key) == value)).drop("bucket")


def manifest(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket, records, bytes, revision): what a store holds; a revision differs if any record of its bucket does.

    Records are hashed one by one and combined by sums, so a bucket never meets in a row.
    """
    placed = with_bucket(rows, key, buckets)
    text = F.to_json(F.struct(*rows.columns))
    parts = [F.sum(F.xxhash64(text, F.lit(i)).cast("decimal(38,0)")).cast("string") for i in (1, 2)]
    return placed.groupBy("bucket").agg(F.count("*").alias("records"), F.sum(F.octet_length(text)).alias("bytes"), digest(F.concat_ws(":", *parts)).alias("revision"))
