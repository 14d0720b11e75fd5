"""Curated files at the edge: YAML tables with declared schemas, TOML settings, checks of keys."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions import names


def read_yaml(spark: SparkSession, path: str, schema: str, collection: str | None = None) -> DataFrame:
    """Rows of a curated YAML list (or of one list of a mapping); an absent file is an empty table.

    Meant for hand-kept files; convert anything larger to Parquet once.
    """
    import yaml

    file = Path(path)
    raw: Any = yaml.safe_load(file.read_text(encoding="utf-8")) if file.is_file() else []
    rows = (raw or {}).get(collection, []) if collection else raw or []
    if not isinstance(rows, list):
        raise ValueError(f"{path}: a list is expected")
    return spark.createDataFrame(rows, schema)


def union_unique(frames: list[DataFrame], key: str, hidden: str | None = "hidden") -> DataFrame:
    """All rows of several tables without hidden ones; a repeated or missing key is an error."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if hidden and hidden in out.columns:
        out = out.where(~F.coalesce(hidden, F.lit(False)))
    bad = out.groupBy(key).count().where((F.col("count") > 1) | (F.coalesce(F.col(key).cast("string"), F.lit("")) == "")).limit(5).collect()
    if bad:
        raise ValueError(f"{key} is missing or not unique: {[r[key] for r in bad]}")
    return out


@dataclass
class Settings:
    """Paths and limits of a run."""

    content: str = "content"
    output: str = "data"
    registries: list[str] = field(default_factory=lambda: ["bazel", "conan", "cppget", "hunter", "meson", "spack", "vcpkg", "xmake"])
    threshold: float = 0.82
    buckets: int = 256

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold lies between 0 and 1")


def load_settings(path: str, section: str = "catalith") -> Settings:
    """Settings of a TOML table, or of the root; relative paths start at the file; unknown keys are an error."""
    file = Path(path)
    raw = tomllib.loads(file.read_text(encoding="utf-8"))
    values = raw.get("tool", {}).get(section) or raw.get(section) or {k: v for k, v in raw.items() if not isinstance(v, dict)}
    if unknown := set(values) - {f.name for f in fields(Settings)}:
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    for key in ("content", "output"):
        if key in values:
            values[key] = str((file.parent / values[key]).resolve())
    return Settings(**values)


def isbns(rows: DataFrame) -> DataFrame:
    """(isbn) of curated books (isbn, hidden) that aren't hidden, without hyphens; a wrong or repeated one is an error."""
    plain = F.regexp_replace(F.col("isbn"), "-", "")
    shown = rows.where(~F.coalesce("hidden", F.lit(False)))
    checked = shown.select(F.when(names.valid_isbn(plain), plain).otherwise(F.raise_error(F.concat(F.lit("not an ISBN: "), F.coalesce("isbn", F.lit("null")))).cast("string")).alias("isbn"))
    if not checked.groupBy("isbn").count().where("count > 1").isEmpty():
        raise ValueError("isbn is not unique")
    return checked
