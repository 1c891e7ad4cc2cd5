"""Each query against its DuckDB oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lattica import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [os.path.basename(p)[: -len(".parquet")] for p in glob.glob(f"{SF}/*.parquet")]


def oracle(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF)
    columns, want = oracle(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_stored_shards_with_many_columns(spark, tmp_path):
    """Columns beyond 16 bits leave the size of an entry as it is in the query."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT p.* REPLACE (i AS p_partkey) FROM (SELECT * FROM '{SF}/part.parquet' LIMIT 1) p, range(70000) g(i)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    for name in ("stored_shards", "read_shard"):
        for t in TABLES:
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        cur = con.execute(registry.ORACLES[name])
        columns, want = [c[0] for c in cur.description], cur.fetchall()
        assert sorted(map(repr, map(tuple, registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()))) == sorted(map(repr, want))


def test_stored_shards_with_lines_of_no_order(spark, tmp_path):
    """What a shard aims at counts all line items, also those whose order isn't there."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        more = " UNION ALL SELECT * REPLACE (l_orderkey + 1000000 AS l_orderkey) FROM lineitem WHERE l_orderkey % 3 = 0" if t == "lineitem" else ""
        con.execute(f"COPY (SELECT * FROM {t}{more}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for t in TABLES:
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("stored_shards", "read_shard", "iterate_shards"):
        cur = con.execute(registry.ORACLES[name])
        columns, want = [c[0] for c in cur.description], cur.fetchall()
        assert sorted(map(repr, map(tuple, registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()))) == sorted(map(repr, want))
