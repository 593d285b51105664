"""Every query with SQL gives what DuckDB gives on the same tables, column by column."""

import math
import os

import duckdb
import pytest

from cellplan import plans

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, duck):
    df = plans.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    if sql := plans.oracle_sql().get(name):
        cur = duck.execute(sql)
        names, want = rows([d[0] for d in cur.description], cur.fetchall())
        assert got[0] == names
        assert len(got[1]) == len(want)
        assert got[1] == want
        kinds = {d[0]: str(d[1]) for d in cur.description}
        for f in df.schema.fields:
            spark_kind, duck_kind = f.dataType.simpleString(), kinds[f.name]
            same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "array<bigint>": "BIGINT[]"}
            assert same.get(spark_kind) == duck_kind, (f.name, spark_kind, duck_kind)
