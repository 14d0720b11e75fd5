"""Every query of the training-data operators on tables without rows, and on tables with nulls, repeated rows and clashing columns."""

import os

import pytest

from catalith.llm import queries

CLASHES = ("group", "__g", "key", "n", "a", "b", "bucket", "chunk")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def edges(request, small, tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    out = tmp_path_factory.mktemp(request.param)
    for f in os.listdir(small):
        t = pq.read_table(f"{small}/{f}")
        schema = pa.schema([pa.field(c.name, c.type) for c in t.schema])
        t = t.cast(schema)
        none = pa.table({c.name: pa.nulls(3, c.type) for c in schema}, schema=schema)
        t = t.slice(0, 0) if request.param == "empty" else pa.concat_tables([t, none, t.slice(0, 5)])
        for c in CLASHES:
            t = t if c in t.column_names else t.append_column(c, pa.array(["x"] * len(t), pa.string()))
        pq.write_table(t, out / f)
    return request.param, str(out)


def test_edges(spark, edges, small):
    kind, folder = edges
    for name, q in queries.QUERIES.items():
        rows = q(spark, folder).collect()
        assert kind == "nulls" or rows == [], name
        if kind == "nulls" and name in ("p3_found", "p5_found", "p8_found"):
            plain = {tuple(r) for r in q(spark, small).collect()}
            assert {tuple(r) for r in rows} == plain, name  # null and repeated rows add nothing
