"""Helpers shared by all operators: reading tables, checked broadcasts and
written intermediate tables that survive the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which ``broadcast_if_small`` broadcasts a lookup table.
BROADCAST_ROWS = 50_000
#: Spark's setting by which a query deletes its shuffle files when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows.

    The count stops after ``rows + 1`` rows.  A larger table comes back without
    a hint, so the planner joins it by shuffle.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    For work that costs far more than moving its rows: a table in fewer files
    than cores would leave most of them idle.  A large table is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local[") and conf.get("spark.master") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "path" not in _own_dir:
        _own_dir["path"] = tempfile.mkdtemp(prefix="catalith-")
        atexit.register(shutil.rmtree, _own_dir["path"], ignore_errors=True)
    return _own_dir["path"]


class Scratch:
    """Intermediate tables in the shared folder.

    ``keep`` writes a frame as Parquet and returns the frame that reads it, so
    lineage ends there and a lost executor costs no recomputation.  ``drop``
    deletes tables that later ones replace; what is left when the program ends is
    deleted then, as results read it until they are used.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """free: the shuffle files of the write are deleted as soon as it is done, not when the driver collects its garbage."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        was = self.spark.conf.get(FREE)
        self.spark.conf.set(FREE, free or was)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(FREE, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._catalith_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if path := getattr(df, "_catalith_path", None):
                self._delete(path)

    def clear(self) -> None:
        """Deletes all tables; does nothing if the session has ended."""
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jpath, True)


def clean_id(c: Column | str) -> Column:
    """An id without blanks at either end and in lower case."""
    return F.lower(F.trim(c if isinstance(c, Column) else F.col(c)))


def present(c: Column | str) -> Column:
    """Neither null nor blank."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (F.trim(c) != "")


def try_int(c: Column) -> Column:
    return c.try_cast("int")


def with_columns_of(df: DataFrame, schema) -> DataFrame:
    """``df`` cut to the columns of ``schema``, absent ones as nulls."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f"`{f.name}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
