"""Every core query with SQL gives the rows of its oracle on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from catalith.plans import core_queries


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.astimezone(datetime.UTC).replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core_queries.ORACLES))
def test_oracle(spark, small, duck, name):
    df = core_queries.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(core_queries.ORACLES[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    expected = sorted((tuple(plain(r[have.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == expected


def test_entry_runs(spark, small):
    assert entry.entry(spark).limit(1).count() <= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_only_queries_run(spark, small):
    for name in ("text_similarity", "constrained_clusters", "entity_ids"):
        assert core_queries.QUERIES[name](spark, small).count() > 0, name


@pytest.fixture(scope="module")
def empty(small, tmp_path_factory):
    """The tables without rows, with columns that operators might use themselves."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = tmp_path_factory.mktemp("empty")
    for f in os.listdir(small):
        t = pq.read_table(f"{small}/{f}").slice(0, 0)
        for c in ("group", "key", "n", "bucket", "chunk"):
            t = t if c in t.column_names else t.append_column(c, pa.array([], pa.string()))
        pq.write_table(t, out / f)
    return str(out)


def test_empty_tables(spark, empty):
    made = {"override_unknown", "month_grid", "collection_log", "route_cover", "store_manifest"}  # rows of their own, or one total
    for name, q in core_queries.QUERIES.items():
        assert not q(spark, empty).collect() or name in made, name
