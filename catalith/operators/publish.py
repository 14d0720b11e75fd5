"""Publishing tables: change detection, versions, corrections and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a published table."""
    fs, jpath = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath)]
    done = [n for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n[2:]) for n in done)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a published table."""
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def differs(before: DataFrame, after: DataFrame) -> bool:
    """Whether two tables hold different rows, counting repeats; nulls equal nulls."""
    if before.schema.simpleString() != after.schema.simpleString():
        return True
    signed = lambda df, n: df.select(F.xxhash64(*[F.to_json(F.struct(*df.columns))]).alias("h"), F.lit(n).alias("n"))
    return not signed(before, 1).unionByName(signed(after, -1)).groupBy("h").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()


def update(spark: SparkSession, rows: DataFrame, path: str, check: bool = False, keep: int = 2) -> bool:
    """Publishes ``rows`` as a new version if they differ; with ``check`` it only reports.

    A version counts once Spark has marked it complete, so readers never see half
    of one; older versions beyond ``keep`` are deleted afterwards.
    """
    before = current(spark, path)
    changed = before is None or differs(before, rows)
    if not changed or check:
        return changed
    number = (versions(spark, path) or [0])[-1] + 1
    rows.write.mode("overwrite").parquet(f"{path}/v={number}")
    for old in versions(spark, path)[:-keep]:
        fs, jpath = _fs(spark, f"{path}/v={old}")
        fs.delete(jpath, True)
    return True


def provenance(before: DataFrame | None, used: DataFrame, command: str) -> DataFrame:
    """(command, url, position, first_used): addresses in order of first use."""
    new = used.select(F.lit(command).alias("command"), "url", F.col("position").cast("long").alias("position"), F.current_date().alias("first_used"))
    rows = new if before is None else before.unionByName(new.withColumn("position", F.col("position") + F.lit(1 << 40)))
    return rows.groupBy("command", "url").agg(F.min("position").alias("position"), F.min("first_used").alias("first_used"))


def correct(packages: DataFrame, corrections: DataFrame, key: str, fields: list[str], lists: list[str]) -> DataFrame:
    """Packages with curated corrections (package, field, operation, value) applied in the order of ``position``.

    ``replace`` sets a field, ``remove`` clears it, ``add`` appends to a list what
    it lacks.  A correction of an absent package has no effect.
    """
    steps = corrections.groupBy(F.col("package").alias("__package")).agg(F.array_sort(F.collect_list(F.struct("position", "field", "operation", "value"))).alias("__steps"))
    rows = packages.join(steps, F.col(key) == F.col("__package"), "left")

    def corrected(name: str):
        mine = F.filter(F.coalesce("__steps", F.array().cast("array<struct<position:int,field:string,operation:string,value:string>>")), lambda s: s["field"] == name)
        if name in lists:
            none = F.lit(None).cast("array<string>")
            step = lambda a, s: F.when(s["operation"] == "remove", none).when(s["operation"] == "add", F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.array(s["value"])))).otherwise(F.array(s["value"]))
            return F.aggregate(mine, F.col(name), step)
        kind = packages.schema[name].dataType
        return F.aggregate(mine, F.col(name).cast("string"), lambda a, s: F.when(s["operation"] == "remove", F.lit(None).cast("string")).otherwise(s["value"])).cast(kind)

    return rows.withColumns({n: corrected(n) for n in [*fields, *lists]}).drop("__package", "__steps")


def exit_status(changed: bool, check: bool) -> int:
    """1 if a check found stale data, else 0."""
    return int(changed and check)
