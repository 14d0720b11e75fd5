"""Streams over whole tables, with the SQL of what they must arrive at.

A table's files arrive as a stream; the query runs until all are processed and
returns what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.operators import changefeed
from catalith.plans.core_queries import query
from catalith.streaming import feeds
from catalith.util import Scratch, table


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parque[t]"  # a pattern may name a single file
    return feeds.read_stream(spark, path, table(spark, sf_dir, name).schema)


@query(changefeed.P6_STATE_SQL)
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that a stream of changes arrives at."""
    root = Scratch(spark, "stream").root
    keys, fields = ["collection_name", "id"], ["title", "content", "url"]
    feeds.apply_stream(spark, _stream(spark, sf_dir, "browser_changes"), f"{root}/state", f"{root}/checkpoint", keys, fields).awaitTermination()
    state = feeds.read_state(spark, f"{root}/state", keys, fields)
    return state if state is not None else changefeed.apply_changes(table(spark, sf_dir, "browser_changes").limit(0), keys, fields)


@query("""
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type FROM events), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT start, event_type, count(*) AS rows FROM w, m WHERE start + INTERVAL 6 HOUR <= mark GROUP BY start, event_type
""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and six hours, of all windows that the watermark has closed."""
    root = Scratch(spark, "stream").root
    counts = feeds.latest_counts(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "6 hours")
    sink = counts.writeStream.outputMode("append").format("parquet").option("path", f"{root}/windows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    sink.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{root}/windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "rows")
