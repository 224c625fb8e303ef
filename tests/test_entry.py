"""The driver's functions, and a sample of queries against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SAMPLE = "q1 join_left group_by_aggs rank_over rolling cumulative strings lists p1_found p3_found p5_shop_orders p6_rolling p7_found".split()


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns[:2] == ["l_returnflag", "l_linestatus"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v if isinstance(v, (int, str, bool)) or v is None else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings trades trades_v2 people shop_orders timings raw_lines".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want
